"""Generated, minified and vendored source files and data in the form of source, by Re-Pair grammars and marks."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.core import cut_lineage, salted_join
from symgraph.llm.lexers import KEYWORDS

HEAD_LINES, TAIL_LINES = 20, 5  # where a mark of origin stands
MINIFIED_LINE, MINIFIED_REUSE = 120, 0.5
BLOB_SHARE, BLOB_UNITS, BLOB_RATIO = 0.5, 24, 0.9
GENERATED_STATEMENTS, GENERATED_ALONE, GENERATED_RATIO = 60, 1 / 7, 7.0
REPEATED_RUNS, REPEATED_REUSE, REPEATED_SIZE = 16, 0.85, 0.5
SHARED_STATEMENTS, SHARED_CHARS, SHARED_PART = 6, 240, 0.5
PROSE = 20
CHUNK = 4  # characters of a string literal that count as one unit

# File names by which tools mark what they write.
_NAMES = re.compile(
    r"\.min\.\w+$|\.(?:generated|gen|g|designer|pb|pb\.gw)\.\w+$|_pb2(?:_grpc)?\.pyi?$|(?:^|/)zz_generated[^/]*$|_generated\.\w+$|\.bundle\.\w+$|-min\.\w+$",
    re.I,
)
# Folders that hold other projects' code.
_FOLDERS = re.compile(
    r"(?:^|/)(?:_?vendor|vendored|node_modules|bower_components|jspm_packages|third[_-]?party|site-packages|dist-packages|godeps|pods|carthage)/(?:@[^/]+/)?([^/]+)", re.I
)
# Folders that may hold other projects' code or the project's own.
_MAYBE = re.compile(r"(?:^|/)(?:externals?|extern|deps)/([^/]+)/", re.I)
_VERSIONED = re.compile(r"/[A-Za-z][\w.]*-v?\d+\.\d+(?:\.\d+)+(?:[.-](?:min|bundle|prod))?\.\w+$")
# What tools state of the files they write. The file is named, or nothing is and the comment begins so.
_FILE = r"\b(?:file|code|source|module|document|stub|binding|header|script|stylesheet)s?\b"
_MARKS = re.compile(
    r"@generated\b|<auto-?generated|\bcode generated\b"
    rf"|(?:^\W*|{_FILE}\W+(?:(?:is|was|are|were|has been|have been)\W+)?)(?:auto(?:matically)?[- ]?)?generated (?:from|by|with|using|at|on)\b"
    rf"|{_FILE}\W+(?:is|was|has been)\W+auto(?:matically)?[- ]?generated\b|\bauto(?:matically)?[- ]?generated\W+(?:{_FILE}|do not\b)|^\W*auto(?:matically)?[- ]?generated\W*$"
    r"|\bdo not (?:edit|modify|change)\b(?:[^.\n]{0,60})\b(?:directly|by hand|manually)\b|\b(?:file|edit|modify)\b.{0,80}\b(?:rebuilt|regenerated) (?:from|by)\b"
    r"|\b(?:any|all|manual|local|hand|your)\b[^.\n]{0,20}\b(?:changes?|edits?|modifications?)\b[^.\n]{0,30}\b(?:lost|overwritten)\b"
    r"|\bautomatisch (?:erzeugt|generiert|erstellt)|\bg[ée]n[ée]r[ée]e? automatiquement|\bgenerad[oa] autom[áa]ticamente"
    r"|автоматически (?:создан|сгенерирован)|(?:создан|сгенерирован)\w* автоматически|自動生成|自动生成|^\W*source: \S+\.(?:proto|thrift|graphql|avsc|idl|fbs|yang|asn1?)\b",
    re.I | re.M,
)
# Of these, what speaks of a whole file wherever it stands ("generated by" inside code may speak of a value).
_STATED = re.compile(
    r"@generated\b|<auto-?generated|\bcode generated (?:by|from|with|using)\b|\bcode generated\b[^\n]{0,80}\bdo not (?:edit|modify|change)\b"
    r"|\bthis (?:file|code|source) (?:is|was|has been) (?:auto\w*[- ])?generated\b|\bauto(?:matically)?[- ]?generated\b[^\n]{0,80}\bdo not (?:edit|modify|change)\b",
    re.I,
)
_OPENING = re.compile(r"\A(?:\s+|\ufeff|<\?php\b|#![^\n]*|/\*[\s\S]*?(?:\*/|$)|//[^\n]*|#(?!\[|include)[^\n]*|--[^\n]*|<!--[\s\S]*?(?:-->|$)|[\"']use strict[\"'];?)*")
# Comments (the group) and, passed over, strings.
_TOLD = re.compile(
    r"((?m:^[ \t]*)(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})|/\*[\s\S]*?(?:\*/|$)|<!--[\s\S]*?(?:-->|$)|(?://|#|(?m:^[ \t]*)--)[^\n]*)"
    r"|\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`"
)
_COMPILED = re.compile(r"Object\.defineProperty\(exports, ?[\"']__esModule[\"']|__webpack_require__|_interopRequire(?:Default|Wildcard)\(|\bSystem\.register\(\[|\(0, _\w+\.default\)")
_COMPILED_PARTS = ("__esModule", "__webpack_require__", "_interopRequire", "System.register(", "(0, _")  # one of them is in whatever that pattern finds
_SOURCE_MAP = re.compile(r"[#@] ?source(?:Mapping)?URL=")
_LICENCE = re.compile(r"\blicen[sc]e[ds]?\b|\bcopyright\b|\(c\)|©|\ball rights reserved\b", re.I)
# A project with its version, in the head of a file; a holder of rights alone may be the repository's own.
_PROJECT = re.compile(r"^\W*([A-Za-z][\w.-]*?)(?:\.(?:js|css|ts|php|py|go|rs|scss))? v?\d+\.\d+[\w.]*\b|^\W*([A-Za-z][\w.-]*) - .*\n\W*version:", re.I | re.M)
_COMMENT_LINE = re.compile(r"^\s*(?://|#(?!\[|include|!)|/\*|\*|--|<!--|\"\"\"|''')")
_COMMENTS = re.compile(r"/\*[\s\S]*?(?:\*/|$)|(?m:^[ \t]*(?://|#(?![\[\w]))[^\n]*$)")
_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)[uUlLnfF]{0,3}"
_LITERAL = re.compile(
    r"\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}|<<[<~-]?[\"']?(?P<end>[A-Za-z_]\w*)[\"']?[^\n]*\n[\s\S]*?\n[ \t]*(?P=end)\b"
    rf"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|(?<![\w#.]){_NUMBER}(?![\w.])",
    re.S,
)
# Parts of a string of separate numbers or hexadecimal digits, whose spaces are no prose.
_CODE = re.compile(rf"{_NUMBER}|[\da-fA-F]{{2,8}}")
_BETWEEN = re.compile(r"[\s,;:]+")
_DATA_URI = re.compile(r"^data:[\w/+.-]*(?:;[\w=.-]+)*,")
_WORD = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$]*")
_TOKEN = re.compile(_LITERAL.pattern + r"|(?P<word>[A-Za-z_$\u0080-\U0010ffff][\w$]*)|(?P<sign>[^\s\w])", re.S)
_WORDS = frozenset().union(*KEYWORDS.values())
_BREAK = re.compile(r"(?<=[;{}])")


def re_pair(symbols: list[int]) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """(rules, rest): the Re-Pair grammar of a sequence; rules map a new symbol to the pair it stands for.

    Round by round the most frequent pair is replaced left to right, and with it the next frequent
    ones (at least half as frequent, twice at least) that have no symbol in common with those
    before, so that no pair breaks another's; a sequence of n symbols takes n log n.
    """
    rules: dict[int, tuple[int, int]] = {}
    new = max(symbols, default=0) + 1
    while len(symbols) > 2:
        count = Counter(zip(symbols, symbols[1:]))
        top = max(count.values())
        if top < 2:
            break
        least, names, taken = max(2, (top + 1) // 2), {}, set()
        for pair in sorted((p for p, c in count.items() if c >= least), key=lambda p: (-count[p], p)):
            if taken.isdisjoint(pair):
                taken.update(pair)
                names[pair] = new
                new += 1
        out, k, last, used = [], 0, len(symbols) - 1, Counter()
        while k <= last:
            s = names.get((symbols[k], symbols[k + 1])) if k < last else None
            if s is None:
                out.append(symbols[k])
                k += 1
            else:
                out.append(s)
                used[s] += 1
                k += 2
        # a pair that its neighbours left standing once is no rule
        back = {s: p for p, s in names.items()}
        if all(used[s] >= 2 for s in back):
            rules |= back
            symbols = out
            continue
        symbols = []
        for s in out:
            if s in back and used[s] < 2:
                symbols += back[s]
            else:
                symbols.append(s)
        kept = {s: p for s, p in back.items() if used[s] >= 2}
        if not kept:
            break
        rules |= kept
    return rules, symbols


def covered(rules: dict[int, tuple[int, int]], rest: list[int]) -> float:
    """The part of the original sequence that rules stand for."""
    size: dict[int, int] = {}
    for s in rules:  # a rule's parts are older than the rule
        a, b = rules[s]
        size[s] = size.get(a, 1) + size.get(b, 1)
    total = sum(size.get(s, 1) for s in rest)
    return sum(size[s] for s in rest if s in size) / total if total else 0.0


def statements(text: str) -> list[str]:
    """The statements of a text without comments: its lines, long ones cut after ; { and }."""
    return split_statements(_COMMENTS.sub("", text))


def split_statements(code: str) -> list[str]:
    out = []
    for line in code.split("\n"):
        line = line.strip()
        if len(line) > MINIFIED_LINE:
            out += [s for s in (x.strip() for x in _BREAK.split(line)) if s]
        elif line:
            out.append(line)
    return out


def literal_units(text: str) -> tuple[list[str], int]:
    """(units, characters) of the literals that are no prose: numbers whole, strings in chunks.

    Prose, such as a docstring or a message, is never compressible by rules and yet no data: a
    string with more than one space in ``PROSE`` characters is left out. The head of a data URI
    belongs to the literal, but says nothing and makes no unit.
    """
    units, chars = [], 0
    for m in _LITERAL.finditer(text):
        s = m[0]
        if s[0] in "\"'`<":
            if m["end"]:
                s = s[s.index("\n") + 1 : s.rindex("\n")]
            else:
                s = s[3:-3] if s[:3] in ('"' * 3, "'" * 3) and len(s) > 5 else s[1:-1]
            codes = _BETWEEN.split(s.strip(" \t\r\n,;:"))
            if len(codes) > 2 and all(_CODE.fullmatch(x) for x in codes):
                units += codes
                chars += sum(map(len, codes))
                continue
            if s.count(" ") * PROSE > len(s):
                continue
            s = "".join(s.split("\n"))
            chars += len(s)
            s = _DATA_URI.sub("", s)
            units += [s[k : k + CHUNK] for k in range(0, len(s), CHUNK)]
        else:
            units.append(s)
            chars += len(s)
    return units, chars


def incompressible(units: list[str]) -> bool:
    """Whether rules leave nearly as much of the units as of random ones, as many and of the same alphabet.

    Pairs of few symbols repeat by chance alone, the more the longer the text, so the rest counts
    against what chance leaves. One symbol says nothing.
    """
    ids = numbered(units)
    size = max(ids, default=0) + 1
    if size < 2:
        return False
    rest = len(re_pair(ids)[1])
    if rest >= BLOB_RATIO * len(ids):
        return True
    r = random.Random(size)
    return rest >= BLOB_RATIO * len(re_pair([r.randrange(size) for _ in ids])[1])


def numbered(items: list[str]) -> list[int]:
    ids: dict[str, int] = {}
    return [ids.setdefault(x, len(ids)) for x in items]


def token_symbols(text: str) -> list[int]:
    """The tokens of a text without comments as symbols: keywords and signs as they are, other words and literals as one each.

    The elements of a list (a token and its comma, again and again) count once, however many.
    """
    out: list[str] = []
    for m in _TOKEN.finditer(_COMMENTS.sub("", text)):
        g = m.lastgroup
        out.append((m[0] if m[0] in _WORDS else "w") if g == "word" else m[0] if g == "sign" else "0")
        if len(out) > 3 and out[-1] == out[-3] == "," and out[-2] == out[-4]:
            del out[-2:]
    return numbered(out)


def repetitive(text: str, shapes: list[int]) -> bool:
    """Whether rules stand for so much of a text that a tool must have written it.

    Of a text of ``GENERATED_STATEMENTS`` or more whose statements nearly all have a shape that
    comes again, the Re-Pair grammar of its tokens decides: it must be ``GENERATED_RATIO`` times
    shorter than the tokens. In a shorter text, runs of one shape (lists, tables of constants)
    count once, and what rules and rest of its statements take must be within what a repeated block
    takes, a bound that grows with the logarithm of the length and is never over half of the text.
    """
    n = len(shapes)
    if n >= GENERATED_STATEMENTS:
        count = Counter(shapes)
        if sum(c == 1 for c in count.values()) <= GENERATED_ALONE * n:
            symbols = token_symbols(text)
            rules, rest = re_pair(symbols)
            if len(symbols) >= GENERATED_RATIO * (2 * len(rules) + len(rest)):
                return True
    runs = [s for k, s in enumerate(shapes) if not k or s != shapes[k - 1]]
    n = len(runs)
    if n < REPEATED_RUNS:
        return False
    rules, rest = re_pair(runs)
    return 2 * len(rules) + len(rest) <= min(REPEATED_SIZE * n, 6 + 4 * math.log2(n)) and covered(rules, rest) >= REPEATED_REUSE


def by_grammar(text: str, parts: list[str] | None = None) -> str | None:
    """What grammars say of a text: data, minified, generated or, where they say nothing, null.

    Literals that take up most of a text and that no rule shortens are data, long lines whose
    statement shapes repeat are minified, a text that rules make short is generated.
    """
    if not text.strip():
        return None
    units, chars = literal_units(text)
    if len(units) >= BLOB_UNITS and chars >= BLOB_SHARE * (sum(map(len, text.split())) - text.count(",")) and incompressible(units):
        return "data"
    parts = statements(text) if parts is None else parts
    code = _COMMENTS.sub("", text)
    # a literal of several lines is part of one statement
    shapes = numbered(split_statements(_WORD.sub("w", _LITERAL.sub("0", code))))
    if max(map(len, text.split("\n"))) > MINIFIED_LINE:
        code_lines = max(1, sum(1 for x in code.split("\n") if x.strip()))
        if sum(map(len, parts)) / code_lines > MINIFIED_LINE and (len(parts) > code_lines * 6 or covered(*re_pair(shapes)) >= MINIFIED_REUSE):
            return "minified"
    return "generated" if repetitive(text, shapes) else None


def by_mark(path: str, text: str) -> str | None:
    """What folder, name and stated origin say of a file: vendored, generated, minified, compiled or null."""
    if _FOLDERS.search(path) or _VERSIONED.search(path):
        return "vendored"
    lines = text.split("\n")
    head = "\n".join(x for x in lines[:HEAD_LINES] if len(x) < 400 and (_COMMENT_LINE.match(x)))
    head += "\n" + _OPENING.match(text)[0]
    if head.strip():
        if _LICENCE.search(head) and named_project(path, head):
            return "vendored"
        if _MARKS.search(head):
            return "generated"
    if "generated" in text.lower() and _STATED.search(text) and any(m[1] and _STATED.search(m[1]) for m in _TOLD.finditer(text)):
        return "generated"
    if _NAMES.search(path):
        return "minified" if ".min." in path.lower() else "generated"
    if text.strip() and ((any(x in text for x in _COMPILED_PARTS) and _COMPILED.search(text)) or any(_SOURCE_MAP.search(x) for x in lines[-TAIL_LINES:] if len(x) < 4000 or "sourceMappingURL" in x)):
        return "compiled"
    return None


def named_project(path: str, head: str) -> str | None:
    """The project, other than the repository, that a file's head names with a version."""
    repo = path.split("/", 1)[0].lower()
    if re.search(rf"\b{re.escape(repo)}\b", head.lower()):
        return None
    return next((g.lower() for m in _PROJECT.finditer(head) for g in m.groups() if g), None)


def origin(path: str | None, text: str) -> str | None:
    """generated, compiled, minified, vendored or data for a file not written by hand here, else null: grammars first, then marks."""
    return by_grammar(text) or by_mark(path or "", text)


def projects(path: str, text: str) -> tuple[str | None, str | None]:
    """(sure, maybe): the other project that a file's folder or head names, and the one that a folder may name."""
    sure = _FOLDERS.search(path)
    name = sure[1].lower() if sure else named_project(path, _OPENING.match(text)[0])
    maybe = _MAYBE.search(path)
    return name, maybe[1].lower() if maybe and not sure else None


def shared_rules(parts: list[str]) -> list[tuple[int, int]]:
    """(rule, characters): rules of a grammar parsed alike in every file, for comparing across files.

    Statements are hashed with their words; a rule ends where a hash is a local minimum, so equal
    passages give equal rules wherever they stand (parsing that is locally consistent, where
    Re-Pair's own rules depend on the whole text). Short rules say nothing and are left out.
    """
    if len(parts) < SHARED_STATEMENTS:
        return []
    import xxhash

    marks = [xxhash.xxh64_intdigest(p) for p in parts]
    out, begin, size, n = [], 0, 0, len(parts)
    for k in range(n + 1):
        enough = k - begin >= SHARED_STATEMENTS and size >= SHARED_CHARS
        if enough and (k == n or (k < n - 1 and marks[k] < marks[k - 1] and marks[k] < marks[k + 1])):
            out.append((xxhash.xxh64_intdigest("\n".join(parts[begin:k])) - (1 << 63), size))
            begin, size = k, 0
        if k < n:
            size += len(parts[k])
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("rule", pa.int64()), ("chars", pa.int32())]))
    for b in batches:
        paths, texts = b.column(0).to_pylist(), b.column(2).to_pylist()
        cols: list[list] = [[], [], [], [], [], []]
        for path, text in zip(paths, texts):
            text = text or ""
            parts = statements(text)
            grammar = by_grammar(text, parts)
            # a mark says more of what a tool wrote than that it is repetitive
            mark = by_mark(path, text) if grammar in (None, "generated") else None
            found = shared_rules(parts)
            row = (mark or grammar, "grammar" if grammar else "mark" if mark else None, *projects(path, text), sum(map(len, parts)) if found else 0, [{"rule": r, "chars": c} for r, c in found])
            for col, x in zip(cols, row):
                col.append(x)
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), kind)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, cols, types)], ["file_path", "ingested_at", "origin", "decided_by", "project", "maybe", "chars", "rules"])


def file_origins(nodes: DataFrame) -> DataFrame:
    """(file_path, origin, decided_by): every file, with null for what was written by hand here.

    ``decided_by`` says what decided: the file's own ``grammar``, a ``mark``, the ``rules`` it
    shares with other repositories, or the ``project`` that its folder names. Texts are read where
    they lie; only rule hashes and names are shuffled. Files half of whose text is rules that other
    repositories' files have too are ``copied``; flagged files offer their rules too, so a copy
    without a mark meets its marked twin. A folder that may be the project's own (``deps``,
    ``external``) counts as ``vendored`` if another repository has the project it names, in any
    folder or head. A rule or name of many files is spread over tasks. A null or empty text is
    judged by its path alone; null paths give no row; of repeated deliveries the newest holds.
    """
    texts = nodes.filter("kind = 'file' and file_path is not null").select("file_path", "ingested_at", "source_text")
    schema = "file_path string, ingested_at timestamp, origin string, decided_by string, project string, maybe string, chars int, rules array<struct<rule: bigint, chars: int>>"
    read = cut_lineage(texts.mapInArrow(_read, schema))  # hashes that the branches below use
    newest = F.struct(F.col("ingested_at").isNotNull(), "ingested_at")
    read = read.groupBy("file_path").agg(F.max_by(F.struct("origin", "decided_by", "project", "maybe", "chars", "rules"), newest).alias("v")).select("file_path", "v.*")
    repo = F.substring_index("file_path", "/", 1)
    rows = read.filter("size(rules) > 0").select("file_path", repo.alias("repo"), "chars", F.explode("rules").alias("r")).select("file_path", "repo", "chars", F.col("r.rule").alias("rule"), F.col("r.chars").alias("part"))
    common = rows.groupBy("rule").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).filter("a <> b").select("rule")
    copied = salted_join(rows, common, ["rule"]).groupBy("file_path").agg(F.sum("part").alias("part"), F.max("chars").alias("all"))
    copied = copied.filter(F.col("part") >= SHARED_PART * F.col("all")).select("file_path", F.lit("copied").alias("by_rule"))
    named = read.select(F.coalesce("project", "maybe").alias("name"), repo.alias("repo")).filter("name is not null")
    far = named.groupBy("name").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).filter("a <> b").select("name")
    maybe = read.filter("maybe is not null and origin is null").select("file_path", F.col("maybe").alias("name"))
    maybe = salted_join(maybe, far, ["name"]).select("file_path", F.lit("vendored").alias("by_name"))
    out = read.join(copied, "file_path", "left").join(maybe, "file_path", "left")
    by = F.coalesce("decided_by", F.when(F.col("by_rule").isNotNull(), "rules"), F.when(F.col("by_name").isNotNull(), "project"))
    told = F.when((F.col("origin") == "generated") & (F.col("decided_by") == "grammar"), F.coalesce("by_rule", "origin")).otherwise(F.col("origin"))
    return out.select("file_path", F.coalesce(told, "by_rule", "by_name").alias("origin"), by.alias("decided_by"))


def not_by_hand(nodes: DataFrame) -> DataFrame:
    """(file_path, origin) of the generated, minified, compiled, vendored, copied and data files."""
    return file_origins(nodes).filter("origin is not null").select("file_path", "origin")
