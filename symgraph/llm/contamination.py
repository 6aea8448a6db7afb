"""Evaluation texts leaking into training text: broadcast test n-grams, scanned windows, verified hits."""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.core import spread
from symgraph.llm.canonical import LOOK_ALIKE

NGRAM = 5  # a passage of 15 words or more with one word in ten changed has six in a row unchanged
LEAST_WORDS = 15
ONE_IN = 10
BLOCK_CHARS = 8_000_000  # of evaluation text broadcast at once; more comes in further blocks

_FOLD = str.maketrans(LOOK_ALIKE)
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([nrt])")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_WORD = re.compile(r"[^\W_]+")
_DROP = {c: None for c in (0xAD, 0x34F, 0x61C, 0x5F, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0x300, 0x370))}


def _unescape(m: re.Match) -> str:
    return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " "


def words(text: str) -> list[str]:
    """The words of a text, however cased, wrapped, marked, escaped, spaced or punctuated.

    Entities and backslash escapes are resolved, tags dropped, widths and compositions folded,
    invisible characters, accents and underscores removed, look-alike letters mapped to Latin.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "\\" in text:
        text = _ESCAPED.sub(_unescape, text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if text.isascii():
        return _WORD.findall(text.lower().replace("_", ""))
    text = unicodedata.normalize("NFKD", text).translate(_DROP).translate(_FOLD)
    return _WORD.findall(unicodedata.normalize("NFKD", text).translate(_DROP).lower())


_CHUNK = re.compile(r"(?:</?[A-Za-z][^<>\n]{0,200}>|[^\s<]|<)+")


def words_at(text: str) -> list[tuple[str, int, int]]:
    """(word, begin, end): the words of a text as ``words`` gives them, with the raw characters they stand in.

    A text is read in chunks between its spaces (a tag is never cut), each read alone; where that
    gives other words than the whole text, in its lines, else as one chunk.
    """
    whole = words(text)
    for cut in (_CHUNK, re.compile(r"[^\n]+")):
        out = [(w, m.start(), m.end()) for m in cut.finditer(text) for w in words(m[0])]
        if [w for w, _, _ in out] == whole:
            return out
    return [(w, 0, len(text)) for w in whole]


class EvalIndex:
    """The n-grams of a block of evaluation items, and the check of a hit."""

    def __init__(self, items: list[tuple[int, str]], n: int = NGRAM):
        self.n, self.items, self.grams = n, {}, defaultdict(list)
        for item, text in items:
            w = words(text)
            if len(w) >= LEAST_WORDS:
                self.items[item] = w
                for k in range(len(w) - n + 1):
                    self.grams[" ".join(w[k : k + n])].append((item, k))
        self.firsts = {g.split(" ", 1)[0] for g in self.grams}

    def leaks(self, text: str, every: bool = False) -> list[tuple[int, int, int]]:
        """(item, first word, last word + 1) of each item of which the text holds a passage: the first found, or every one."""
        w, n = words(text), self.n
        if len(w) < LEAST_WORDS:
            return []
        hits: dict = defaultdict(list)
        firsts, grams = self.firsts, self.grams
        for k in range(len(w) - n + 1):
            if w[k] in firsts:
                for item, at in grams.get(" ".join(w[k : k + n]), ()):
                    hits[item].append((k, at))
        out = []
        for item, found in hits.items():
            for span in self._passages(w, self.items[item], found):
                out.append((item, *span))
                if not every:
                    break
        return out

    def _passages(self, doc: list[str], item: list[str], found: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """The places of passages of LEAST_WORDS or more words of the item with at most one in ONE_IN changed.

        First along each diagonal on which an n-gram was hit (words replaced); then, where words
        may be put in or left out, by an alignment in a band, anchored at runs of unchanged words.
        """
        by_shift: dict[int, list[int]] = defaultdict(list)
        for k, at in found:
            by_shift[k - at].append(k)
        taken: list[tuple[int, int]] = []
        for shift in by_shift:
            lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
            if hi - lo >= LEAST_WORDS:
                wrong = [doc[i + shift] != item[i] for i in range(lo, hi)]
                span = _window(wrong)
                if span:
                    begin, end = span
                    while wrong[begin]:
                        begin += 1
                    while wrong[end - 1]:
                        end -= 1
                    taken.append((lo + shift + begin, lo + shift + end))
                    yield taken[-1]
        # of a passage's L words L / 10 are changed, each spoiling n n-grams at most: n + 1 words stand
        # unchanged in a row, and LEAST_WORDS - 2 n + 1 n-grams or more are hit within the band
        band = max(2, len(item) // ONE_IN)
        near = {s: sum(len(ks) for t, ks in by_shift.items() if abs(t - s) <= band) for s in by_shift}
        runs = {s: ks for s, ks in by_shift.items() if near[s] > LEAST_WORDS - 2 * self.n and any(b - a == 1 for a, b in zip(ks, ks[1:]))}
        for shift in sorted(runs):
            for k in runs[shift]:
                if any(a <= k and k + self.n <= b for a, b in taken):
                    continue
                at = k - shift
                before = _extended(doc[max(0, k - at - band) : k][::-1], item[:at][::-1], band)
                after = _extended(doc[k + self.n : k + len(item) - at + band], item[at + self.n :], band)
                ops = [*before[::-1], *[1] * self.n, *after]
                begin = k - sum(h != 3 for h in before)
                taken.append((begin, begin + sum(h != 3 for h in ops)))
                span = _edited_window(ops)
                if span:
                    first = begin + sum(h != 3 for h in ops[: span[0]])
                    yield first, first + sum(h != 3 for h in ops[span[0] : span[1]])


def _extended(doc: list[str], item: list[str], band: int) -> bytes:
    """The edits (see ``_edited_window``) that extend an alignment from its start as far as it pays.

    Cells lie within ``band`` of the diagonal; a word unchanged counts two, an edit takes one, and
    the best prefix is read back. One unchanged word thus pays for two edits before it, more than
    any passage needs; far words that agree by chance do not.
    """
    n, m, none = len(item), len(doc), -(1 << 20)
    wide = 2 * band + 1
    prev = [band - c if c >= band and c - band <= m else none for c in range(wide)]
    ways = [bytearray(4 if c > band else 0 for c in range(wide))]
    best, end = 0, (0, band)
    for i in range(1, n + 1):
        now, way, word, base = [none] * wide, bytearray(wide), item[i - 1], i - band
        for c in range(max(0, -base), min(wide, m - base + 1)):
            j = base + c
            score, how = none, 0
            if j:
                score, how = (prev[c] + 2, 1) if doc[j - 1] == word else (prev[c] - 1, 2)
            if c + 1 < wide and prev[c + 1] - 1 > score:
                score, how = prev[c + 1] - 1, 3
            if c and now[c - 1] - 1 > score:
                score, how = now[c - 1] - 1, 4
            now[c], way[c] = score, how
            if score > best:
                best, end = score, (i, c)
        ways.append(way)
        prev = now
        if max(now) < best - 2 * band:  # more edits in a row than any passage has
            break
    (i, c), ops = end, bytearray()
    while i or c > band:
        how = ways[i][c]
        ops.append(how)
        if how < 3:
            i -= 1
        elif how == 3:
            i, c = i - 1, c + 1
        else:
            c -= 1
    ops.reverse()
    return bytes(ops)


def _edited_window(ops: list[int]) -> tuple[int, int] | None:
    """Bounds of the longest window of an edit sequence that begins and ends with a word unchanged, holds
    LEAST_WORDS or more of the item's words and at most one edit for ONE_IN of them.

    Edits: 1 unchanged, 2 replaced, 3 left out, 4 put in (no word of the item).
    """
    cost, words_, found = [0], [0], None
    for h in ops:
        cost.append(cost[-1] + (0 if h == 1 else ONE_IN) - (h != 4))
        words_.append(words_[-1] + (h != 4))
    # starts with falling need: only a start of higher cost[] than all before it can serve a later end better
    begin, best, at = 0, None, 0
    for j in range(1, len(cost)):
        while words_[j] - words_[begin] >= LEAST_WORDS and begin < j:
            if ops[begin] == 1 and (best is None or cost[begin] > best):
                best, at = cost[begin], begin
            begin += 1
        if best is not None and ops[j - 1] == 1 and cost[j] <= best and (found is None or j - at > found[1] - found[0]):
            found = (at, j)
    return found


def _window(wrong: list[bool]) -> tuple[int, int] | None:
    """Bounds of a window of LEAST_WORDS or more with at most one in ONE_IN wrong, by prefix sums."""
    sums = [0]
    for x in wrong:
        sums.append(sums[-1] + (ONE_IN - 1 if x else -1))
    # a window [i, j) is good if sums[j] <= sums[i]; keep the highest sums[i] with i <= j - LEAST_WORDS
    best, best_at, found = sums[0], 0, None
    for j in range(LEAST_WORDS, len(sums)):
        i = j - LEAST_WORDS
        if sums[i] > best:
            best, best_at = sums[i], i
        if sums[j] <= best:
            found = (best_at, j) if found is None or j - best_at > found[1] - found[0] else found
    return found


_indexes: dict[str, EvalIndex] = {}


def _index_of(name: str, shared) -> EvalIndex:
    """The index of a broadcast block, built once in each worker process."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = EvalIndex(shared.value)
    return _indexes[name]


def _blocks(items: DataFrame, item_col: str, item_text: str, block_chars: int) -> Iterator[tuple[str, object]]:
    """(name, broadcast items) of blocks of at most about ``block_chars`` characters of evaluation text."""
    it = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    total = it.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    for k in range(blocks):
        rows = it.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()
        yield uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in rows])


def leaked_passages(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, end_word): each document with the evaluation items it holds a passage of.

    The evaluation set is broadcast in blocks of at most ``block_chars`` characters (one block for
    a usual benchmark suite) and every block is scanned against all whole texts: no shuffle of the
    corpus, no pairs. Null texts hold nothing; items of fewer than 15 words and null items match
    nothing; a repeated document or item row counts once in the result.
    """
    src = spread(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("text is not null"))
    dk, ik = src.schema["doc"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {dk}, `{item_col}` {ik}, first_word int, end_word int"
    out = None
    for name, shared in _blocks(items, item_col, item_text, block_chars):

        def run(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index_of(name, shared)
            for b in batches:
                found = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in index.leaks(t)]
                if found:
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema[0].type), pa.array(cols[1]), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], [id_col, item_col, "first_word", "end_word"])

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The documents that hold no passage of any evaluation item, all columns kept."""
    return docs.join(leaked_passages(docs, items, id_col=id_col, **kw).select(id_col).distinct(), id_col, "left_anti")


def cut_spans(text: str, index: EvalIndex) -> str:
    """A text without the passages of the index's items; the words at the ends of a cut stay apart."""
    while True:
        found = index.leaks(text, every=True)
        if not found:
            return text
        at = words_at(text)
        keep, end = [], 0
        for first, last in sorted((a, b) for _, a, b in found):
            begin, stop = at[first][1], at[last - 1][2]
            if begin >= end:
                keep.append(text[end:begin])
            end = max(end, stop)
        text = " ".join(x for x in (*keep, text[end:]) if x.strip())


def without_spans(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """All documents with all columns, passages of evaluation items cut out of their texts.

    Texts without a passage stay as they are, null ones null; one that is all passage becomes
    empty. What is cut is the raw text from the first to the last word of a passage.
    """
    out = spread(docs)
    where = docs.columns.index(text_col)
    for name, shared in _blocks(items, item_col, item_text, block_chars):

        def run(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index_of(name, shared)
            for b in batches:
                texts = pa.array([t if t is None else cut_spans(t, index) for t in b.column(where).to_pylist()], b.schema[where].type)
                yield b.set_column(where, b.schema[where], texts)

        out = out.mapInArrow(run, docs.schema)
    return out
