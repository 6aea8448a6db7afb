"""Visually identical text with different characters: one form of each text, by DuckDB in Arrow partitions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.core import SMALL_BYTES, cut_lineage, salted_join, spread

# Letters of Cyrillic, Greek, Armenian, Cherokee, Lisu and extended Latin that look like a Latin letter.
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "І": "I", "Ѕ": "S", "Ј": "J", "Ԁ": "d", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
    "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "Ё": "Ë", "ё": "ë", "Ї": "Ï", "ї": "ï",
    "Ӏ": "I", "Ү": "Y", "ү": "y", "Ѵ": "V", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "α": "a", "ι": "i", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "υ": "u",
    "օ": "o", "ս": "u", "Օ": "O", "Ս": "U", "Տ": "S", "հ": "h", "ո": "n", "զ": "q", "ց": "g",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H",
    "Ꮐ": "G", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "ɡ": "g", "ɑ": "a",
}
# Signs that look like the hyphen.
HYPHENS = {"\u2010": "-", "\u2011": "-", "\u2212": "-"}
# Ranges of characters that show other characters in another width, joined or in another style.
COMPATIBLE = [(0xFF01, 0xFFEF), (0xFB00, 0xFB06), (0x1D400, 0x1D7FF), (0x3000, 0x3000), (0x2160, 0x217F), (0x2113, 0x2113)]
# Spaces that look like the space, as a class of regular expressions.
SPACES = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
# Characters that show nothing (control characters but for tab and line feed, format characters, variation selectors).
INVISIBLE = (
    r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}"
    r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}]"
)
CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}]"  # the ASCII part of these
PICTURE = r"[\x{1F000}-\x{1FAFF}\x{2190}-\x{2BFF}]"
JOIN = ""  # holds the place of a joiner between two pictures, which does show


@lru_cache(1)
def _maps() -> tuple[str, str, list[tuple[str, str]]]:
    """What translate() maps (one to one) and what replace() has to (one to several)."""
    one, many = LOOK_ALIKE | HYPHENS, {}
    for lo, hi in COMPATIBLE:
        for c in map(chr, range(lo, hi + 1)):
            to = unicodedata.normalize("NFKC", c)
            if to != c and unicodedata.category(c) != "Cn" and c != "ﾠ":
                to = "".join(LOOK_ALIKE.get(x, x) for x in to)
                (one if len(to) == 1 else many)[c] = to
    return "".join(one), "".join(one.values()), sorted(many.items())


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(text: str = "text") -> str:
    """DuckDB's expression for the consistent form of a text: the steps in order, one inside the other.

    Line ends become line feeds; a joiner between pictures is kept, everything else invisible is
    removed; then compositions (NFC), other widths, joined letters and look-alikes are mapped, and
    composed again; spaces of any kind become the space. Case, accents, superscripts, fractions
    and all visible signs stay; so do the number and place of spaces, except at the ends of lines.
    The steps that leave ASCII as it is are taken only for texts with other characters.
    """
    src, to, many = _maps()
    e = f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    plain = f"regexp_replace({e}, {quoted(CONTROL)}, '', 'g')"
    e = f"regexp_replace({e}, '({PICTURE}\\x{{FE0F}}?)\\x{{200D}}({PICTURE})', '\\1{JOIN}\\2', 'g')"
    e = f"regexp_replace({e}, '({PICTURE}\\x{{FE0F}}?)\\x{{200D}}({PICTURE})', '\\1{JOIN}\\2', 'g')"
    e = f"regexp_replace({e}, {quoted(INVISIBLE)}, '', 'g')"
    e = f"nfc_normalize({e})"
    for a, b in many:
        e = f"replace({e}, {quoted(a)}, {quoted(b)})"
    e = f"nfc_normalize(translate({e}, {quoted(src)}, {quoted(to)}))"
    e = f"regexp_replace({e}, {quoted(SPACES)}, ' ', 'g')"
    e = f"CASE WHEN strlen({text}) = length({text}) THEN {plain} ELSE {e} END"
    e = f"regexp_replace({e}, '[ \\t]+(\\n|$)', '\\1', 'g')"
    return f"rtrim({e}, chr(10))"


def _duckdb(sql: str, source: str = "part"):
    """Runs ``sql`` over each Arrow batch, in one DuckDB connection per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        try:
            for b in batches:
                con.register(source, pa.Table.from_batches([b]))
                out = con.sql(sql).to_arrow_table()
                con.unregister(source)
                yield from out.to_batches()
        finally:
            con.close()

    return run


def canonical_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, canonical): the consistent form of each text. A null text stays null, an empty one empty."""
    src = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = src.schema["id"].dataType.simpleString()
    sql = f"SELECT id, {canonical_sql()} AS canonical FROM part"
    return src.mapInArrow(_duckdb(sql), f"id {kind}, canonical string").withColumnRenamed("id", id_col)


def canonical_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, same, exact): digests (128 bits of SHA-256) of the consistent form and of the text itself.

    Only digests leave the partitions. Texts that are null or show nothing give no row.
    """
    src = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null"))
    kind = src.schema["id"].dataType.simpleString()
    digest = "unhex(left(sha256({}), 32))".format
    sql = f"SELECT id, {digest('c')} AS same, {digest('text')} AS exact FROM (SELECT id, text, {canonical_sql()} AS c FROM part) WHERE regexp_matches(c, '[^\\s]')"
    return src.mapInArrow(_duckdb(sql), f"id {kind}, same binary, exact binary").withColumnRenamed("id", id_col)


def _members(docs: DataFrame, id_col: str, text_col: str, small: int) -> DataFrame:
    """(id, same, exact) of the documents whose consistent form several different texts have."""
    keys = cut_lineage(canonical_keys(docs, id_col, text_col).withColumnRenamed(id_col, "id"))  # read by the branches below, the texts once
    several = keys.select("same", "exact").distinct().groupBy("same").agg(F.count("*").alias("forms")).filter("forms > 1")
    return salted_join(keys, several, ["same"], small=small)


def look_alike_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL_BYTES) -> DataFrame:
    """(id, class, size, forms): the documents that look like another with other characters, a row each.

    ``class`` is the least id of those that look the same, ``size`` their number, ``forms`` the
    number of different texts among them. Documents that only have equal copies are in no class.
    """
    m = cut_lineage(_members(docs, id_col, text_col, small))
    size = m.groupBy("same").agg(F.min("id").alias("class"), F.count("*").alias("size"))
    return salted_join(m, size, ["same"], small=small).select(F.col("id").alias(id_col), "class", "size", "forms")


def look_alike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL_BYTES) -> DataFrame:
    """(id_a, id_b), a < b: documents whose texts differ in characters but look the same.

    Every such pair is a row, as its definition asks; `look_alike_classes` says the same with a row
    a document. Only documents of forms that several texts have are paired; the members of a form
    that many documents have are dealt out to many tasks, each against all other members.
    """
    m = cut_lineage(_members(docs, id_col, text_col, small)).select("same", "id", "exact")
    other = m.select("same", F.col("id").alias("id_b"), F.col("exact").alias("exact_b"))
    out = salted_join(m, other, ["same"], small=small).filter("id < id_b and exact <> exact_b")
    return out.select(F.col("id").alias(f"{id_col}_a"), F.col("id_b").alias(f"{id_col}_b")).distinct()
