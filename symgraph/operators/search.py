"""Search: postings with BM25, exact vector search, hybrid ranking, grep."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from symgraph.core import cut_lineage, group_limit
from symgraph.sources.tables import VersionedTables

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; an identifier is one token."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(term, id, tf, doc_len): one row per term and document."""
    t = docs.select(F.col(id_col).alias("id"), tokens(text).alias("t")).withColumn("doc_len", F.size("t"))
    return t.select("id", "doc_len", F.explode("t").alias("term")).groupBy("term", "id", "doc_len").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, terms: list[str], n_docs: int, avg_len: float, prefix: bool = True) -> DataFrame:
    """(id, score): documents with any of the terms (as prefixes), scored by BM25.

    Each query term counts the documents of all index terms that begin with it. All terms are
    sought in one pass over the index, and their number of documents comes from the same rows; a
    frequent term's rows are only aggregated, never grouped in one task.
    """
    asked = list(dict.fromkeys(t.lower() for t in terms))
    match = [F.col("term").startswith(q) if prefix else F.col("term") == q for q in asked]
    hits = [F.when(m, F.lit(q)) for m, q in zip(match, asked)]
    # the filter on terms passes below the count of postings: only tokens that are sought are shuffled
    h = index.filter(reduce(lambda a, b: a | b, match, F.lit(False))).withColumn("q", F.explode(F.array_compact(F.array(*hits)))).groupBy("id", "doc_len", "q").agg(F.sum("tf").alias("tf"))
    df = F.broadcast(h.groupBy("q").agg(F.count("*").alias("df")))  # as many rows as query terms
    idf = F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    s = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / avg_len))
    return h.join(df, "q").groupBy("id").agg(F.sum(s).alias("score"))


def search(docs: DataFrame, id_col: str, text: Column, terms: list[str], limit: int = 20) -> DataFrame:
    """(id, score): the best documents; of equal scores the lower id."""
    index = postings(docs, id_col, text)
    stats = docs.select(F.size(tokens(text)).alias("n")).agg(F.count("*"), F.avg("n")).first()
    if not stats[0]:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    return _best(bm25(index, terms, stats[0], stats[1] or 1.0), limit)


def _best(scored: DataFrame, limit: int) -> DataFrame:
    return scored.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "id").limit(limit)


class TextIndex:
    """A stored index: postings and the lengths of documents, versioned in a shared folder and kept up by changes.

    A change set is read once: the rows of changed and deleted documents leave by an anti-join and
    the new ones are added; nothing else is tokenised again. Searches read the stored postings.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.tables = spark, VersionedTables(spark, path)

    def build(self, docs: DataFrame, id_col: str, text: Column) -> int:
        kept = docs.filter(F.col(id_col).isNotNull() & text.isNotNull())
        lengths = kept.select(F.col(id_col).alias("id"), F.size(tokens(text)).alias("doc_len"))
        return self.tables.commit(postings=postings(kept, id_col, text), lengths=lengths)

    def update(self, changed: DataFrame, id_col: str, text: Column, deleted: DataFrame | None = None) -> int:
        """Documents (id, text) added or changed, and ids deleted; a null text deletes its document."""
        base = self.tables.version()
        gone = changed.select(F.col(id_col).alias("id"))
        gone = (gone if deleted is None else gone.unionByName(deleted.select(F.col(id_col).alias("id")))).distinct()
        fresh = changed.filter(text.isNotNull())
        lengths = fresh.select(F.col(id_col).alias("id"), F.size(tokens(text)).alias("doc_len"))
        old = {n: self.tables.read(n, base).join(gone, "id", "left_anti") for n in ("postings", "lengths")}
        return self.tables.commit(base, postings=old["postings"].unionByName(postings(fresh, id_col, text)), lengths=old["lengths"].unionByName(lengths))

    def postings(self) -> DataFrame:
        return self.tables.read("postings")

    def search(self, terms: list[str], limit: int = 20, among: DataFrame | None = None) -> DataFrame:
        """(id, score): the best documents, of those in ``among`` (id) if given; scores count all documents."""
        n, mean = self.tables.read("lengths").agg(F.count("*"), F.avg("doc_len")).first()
        scored = bm25(self.postings(), terms, n or 1, mean or 1.0) if terms else self.spark.createDataFrame([], self.postings().select("id").schema.add("score", "double"))
        return _best(scored if among is None else scored.join(among.select("id").distinct(), "id", "left_semi"), limit)


def search_nodes(nodes: DataFrame, query: str, limit: int = 20, kind: str | None = None, language: str | None = None) -> DataFrame:
    """(id, score, tier): nodes by BM25 over name, qualified name and docblock (tier 0); if none is hit, by LIKE on the name.

    The kind is filtered before the limit, so a rare kind is not crowded out. A query whose terms
    hold signs that no term can hold goes to LIKE at once. There: tier 1 equal names, 2 names that
    begin so, 3 that hold it; then pagerank, then id.
    """
    terms = [t for t in re.split(r"[^\w]+", query.lower()) if t]
    n = nodes
    for c, v in (("kind", kind), ("language", language)):
        if v is not None:
            n = n.filter(F.lower(c) == v.lower())
    text = F.concat_ws(" ", "name", F.regexp_replace("qualified_name", r"[\\\\:./]+", " "), "docblock")
    none = nodes.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("tier")).limit(0)
    if terms and not re.search(r"[.\-*+,]", query):
        stats = nodes.select(F.size(tokens(text)).alias("n")).agg(F.count("*"), F.avg("n")).first()
        if not stats[0]:
            return none
        hits = cut_lineage(_best(bm25(postings(n, "id", text), terms, stats[0], stats[1] or 1.0), limit))
        if not hits.isEmpty():
            return hits.withColumn("tier", F.lit(0))
    sign = query.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    if not sign:
        return none
    like = n.filter(F.col("name").ilike(f"%{sign}%"))
    tier = F.when(F.lower("name") == query.strip().lower(), 1).when(F.col("name").ilike(f"{sign}%"), 2).otherwise(3)
    rank = F.when(~F.isnan("pagerank"), F.col("pagerank"))
    best = like.select("id", tier.alias("tier"), rank.alias("r")).orderBy("tier", F.col("r").desc_nulls_last(), "id").limit(limit)
    return best.select("id", F.lit(0.0).alias("score"), "tier")


def hybrid_search(docs: DataFrame, id_col: str, text: Column, vectors: DataFrame, terms: list[str], query: list[float], k: int = 10, alpha: float = 0.5, keep: Column | None = None, before: bool = False, fetch: int = 5) -> DataFrame:
    """(id, score): both sides searched for ``fetch`` times ``k`` each, their ranks fused, the best ``k`` kept.

    ``alpha`` is the weight of the vector side: 1 is semantic search alone, 0 full text alone; a
    side of weight 0 is not searched. ``keep`` (a condition on ``docs``) is applied to the best
    ``k``, which may leave fewer, or with ``before`` to both sides first. ``vectors``: (id, embedding).
    """
    d = docs.filter(keep) if keep is not None and before else docs
    rank = lambda df, by: df.select("id", F.row_number().over(Window.orderBy(F.col(by).desc(), "id")).alias("rank"))  # noqa: E731  (at most fetch * k rows)
    sides = []
    if alpha < 1:
        sides.append(rank(search(d, id_col, text, terms, fetch * k), "score").withColumn("part", (1 - alpha) / (F.col("rank") + 60)))
    if alpha > 0:
        v = vectors if d is docs else vectors.join(d.select(F.col(id_col).alias("id")), "id", "left_semi")
        sides.append(rank(vector_search(v, query, fetch * k, "id"), "similarity").withColumn("part", alpha / (F.col("rank") + 60)))
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    best = both.groupBy("id").agg(F.round(F.sum("part"), 9).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)
    if keep is not None and not before:
        best = best.join(docs.filter(keep).select(F.col(id_col).alias("id")), "id", "left_semi")
    return best


def resolve_symbol(nodes: DataFrame, symbol: str, limit: int = 10) -> DataFrame:
    """(id, place): the node that a symbol means (place 0) and others it may mean.

    Equal qualified name first, then equal names among the best hits of a search, then the other
    hits in their order; of equal ones higher pagerank, then lower id.
    """
    rank = F.coalesce(F.when(~F.isnan("pagerank"), F.col("pagerank")), F.lit(-1.0))
    exact = nodes.filter(F.col("qualified_name") == symbol).select("id", F.lit(0).alias("tier"), (-rank).alias("o")).orderBy("o", "id").limit(limit)
    hits = search_nodes(nodes, symbol, limit).join(nodes.select("id", "name"), "id")
    hits = hits.select("id", F.when(F.lower("name") == symbol.lower(), 1).otherwise(2 + F.col("tier")).alias("tier"), (-F.col("score")).alias("o"))
    one = exact.unionByName(hits).groupBy("id").agg(F.min(F.struct("tier", "o")).alias("v"))  # at most 2 * limit rows
    return one.select("id", (F.row_number().over(Window.orderBy("v.tier", "v.o", "id")) - 1).alias("place"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def vector_search(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(id, similarity): the k vectors most similar to one; every vector is compared, whatever k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = vectors.select(id_col, F.round(cosine(F.col(col), q), 6).alias("similarity")).filter("similarity is not null")
    return s.orderBy(F.col("similarity").desc(), id_col).limit(k)


def vector_search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", col: str = "embedding", block: int = 500) -> DataFrame:
    """(query_id, id, similarity): for each query (query_id, query) the k vectors most similar to it.

    Every vector is compared with every query, exactly, by one matrix product for each Arrow batch
    and block of queries, of which only each query's k best leave the batch. Blocks bound what is
    broadcast at once; a query's k best are found in two rounds.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    q = queries.filter("query is not null").withColumn("__b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    kinds = queries.schema["query_id"].dataType, vectors.schema[id_col].dataType
    schema = f"query_id {kinds[0].simpleString()}, `{id_col}` {kinds[1].simpleString()}, similarity double"
    out = None
    for b in range(blocks):
        rows = q.filter(F.col("__b") == b).select("query_id", "query").collect()  # at most about a block
        shared = vectors.sparkSession.sparkContext.broadcast([(r[0], list(r[1])) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by_size: dict[int, tuple[list, list]] = {}
            for i, v in shared.value:
                x = by_size.setdefault(len(v), ([], []))
                x[0].append(i)
                x[1].append(v)
            for batch in batches:
                ids, found = batch.column(0), ([], [], [])
                rows = batch.column(1).to_pylist()
                for size, (names, block_) in by_size.items():
                    at = [k for k, v in enumerate(rows) if v is not None and len(v) == size and None not in v]
                    if not at:
                        continue
                    m, qs = np.array([rows[k] for k in at], float), np.array(block_, float)
                    norm = np.linalg.norm(qs, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :]
                    sim = np.round(np.divide(qs @ m.T, norm, out=np.full(norm.shape, -np.inf), where=norm > 0), 6)
                    values = np.array(ids.take(pa.array(at)).to_pylist(), object)
                    for row, name in zip(sim, names):
                        bar = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                        for j in np.flatnonzero((row >= bar) & (row > -np.inf)):
                            found[0].append(name)
                            found[1].append(values[j])
                            found[2].append(row[j])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (to_arrow_type(kinds[0]), to_arrow_type(kinds[1]), pa.float64()))], ["query_id", id_col, "similarity"])

        s = vectors.select(id_col, col).mapInArrow(run, schema)
        best = group_limit(s, ["query_id"], [F.col("similarity").desc(), F.col(id_col)], k)
        out = best if out is None else out.unionByName(best)
    return out


def checked_vectors(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", size: int | None = None) -> DataFrame:
    """The vectors of an index to be: each id once with a vector of one size (the first id's, if none is named), else an error.

    One pass counts null ids or vectors, other sizes and repeated ids.
    """
    if size is None:
        first = vectors.filter(F.col(col).isNotNull()).agg(F.min_by(F.size(col), id_col)).first()
        size = first[0] if first[0] is not None else 0
    per_id = vectors.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if(F.col(col).isNull() | (F.size(col) != size)).alias("bad"))
    n = per_id.agg(F.count_if(F.col(id_col).isNull()), F.coalesce(F.sum("bad"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    if any(n):
        raise ValueError(f"{n[0]} null ids, {n[1]} vectors that are not of size {size}, {n[2]} repeated ids")
    return vectors.select(id_col, col)


def hybrid(fts: DataFrame, vectors: DataFrame, key: list[str], item: str, alpha: float = 0.5, k: int = 60) -> DataFrame:
    """(key, item, score): reciprocal rank fusion of two rank lists by a full outer join on (key, item)."""
    j = fts.select(*key, item, "fts_rank").join(vectors.select(*key, item, "vector_rank"), [*key, item], "full_outer")
    f = F.coalesce((1 - alpha) / (F.col("fts_rank") + k), F.lit(0.0))
    v = F.coalesce(alpha / (F.col("vector_rank") + k), F.lit(0.0))
    return j.select(*key, item, F.round(f + v, 9).alias("score"))


def upsert_vectors(old: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return old.join(new.select(id_col).distinct(), id_col, "left_anti").unionByName(new)


def grep(texts: DataFrame, id_col: str, text_col: str, pattern: str, regex: bool = False, context: int = 3) -> DataFrame:
    """(id, line, code, around): the first matching line of each text with the lines about it.

    A plain pattern ignores case, a regular expression does not. Lines stay arrays of their row.
    """
    lines = F.split(text_col, "\n")
    hit = (lambda x: x.rlike(pattern)) if regex else (lambda x: F.lower(x).contains(pattern.lower()))
    src = texts.filter(F.col(text_col).rlike(pattern) if regex else F.lower(text_col).contains(pattern.lower()))
    at = F.array_position(F.transform(lines, lambda x: F.coalesce(hit(x), F.lit(False))), True)
    s = src.select(id_col, lines.alias("lines"), at.cast("int").alias("line")).filter("line > 0")
    begin = F.greatest(F.col("line") - context, F.lit(1))
    return s.select(id_col, "line", F.element_at("lines", F.col("line")).alias("code"), F.array_join(F.slice("lines", begin, F.col("line") + context - begin + 1), "\n").alias("around"))


def ranks(df: DataFrame, key: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
