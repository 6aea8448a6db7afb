"""Encoding of a corpus with a public byte-level BPE tokenizer, by a contiguous rank array."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.core import spread

NO_RANK = 1 << 31
SHORT = 96  # bytes of a word up to which the array is scanned; longer words use a heap over the same merges
CACHE_WORDS = 1 << 17


def load_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks (and ids) of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word.

    ``starts`` holds the boundaries of the parts, ``pair[i]`` the rank of the join of part i with
    its right neighbour. The least rank is found by a scan of the contiguous array, the boundary
    between the two is deleted and the ranks of the joined part and its left neighbour renewed.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SHORT:
        return _encode_long(word, ranks)
    get = ranks.get
    starts = list(range(len(word) + 1))
    pair = [get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == NO_RANK:
            break
        i = pair.index(least)
        del starts[i + 1]
        del pair[i]
        if i < len(pair):
            pair[i] = get(word[starts[i] : starts[i + 2]], NO_RANK)
        if i:
            pair[i - 1] = get(word[starts[i - 1] : starts[i + 1]], NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As encode_word in n log n: a heap of (rank, place) over linked parts; outdated entries are skipped."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ranks.get(word[i : end[j]]) != r:
            continue
        end[i], alive[j], after[i] = end[j], False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (x := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (x, i))
        if before[i] >= 0 and (x := ranks.get(word[before[i] : end[i]])) is not None:
            heapq.heappush(heap, (x, before[i]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Splits texts into words by the tokenizer's pattern and encodes each word once while it is remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find, self.known = ranks, regex.compile(pattern).findall, {}

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for w in self.find(text):
            ids = known.get(w)
            if ids is None:
                ids = encode_word(w.encode("utf-8", "replace"), self.ranks)
                if len(known) >= CACHE_WORDS:
                    known.clear()
                known[w] = ids
            out += ids
        return out


def default_tokenizer() -> tuple[str, str]:
    """(rank file, pattern) of byte_bpe_50k, from the installed package of public tokenizers."""
    import public_tokenizers as P

    return str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN


def encode_corpus(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens; null and empty texts give [].

    The rank table (of the tokenizer, some 50,000 entries whatever the corpus) is broadcast; the
    texts are read, encoded and returned partition by partition, with no shuffle unless there are fewer partitions than cores. A text of any
    length is encoded whole.
    """
    if rank_file is None or pattern is None:
        rank_file, pattern = default_tokenizer()
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                ids = pa.array([enc.encode(t) if t else [] for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, "ids"])

    src = spread(docs.select(F.col(id_col), F.col(text_col)))
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids array<int>")
