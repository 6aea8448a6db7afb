"""Joins with priorities: reference resolution, cross-language matching, interval, nearest and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.core import salted_join
from symgraph.functions import scalars as S

# The confidence of each tier of reference resolution.
TIERS = {"exact": 1.0, "suffix": 0.85, "short": 0.7, "placeholder": 0.3}
# The confidence of each way in which a call can match an endpoint.
MATCHES = {"exact": 0.95, "parameterized": 0.85, "prefix": 0.60, "fuzzy": 0.40}


def symbol_tables(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exact, suffix, short): lookups by qualified name, by unique suffix and by unique short name.

    Of equal qualified names the last id in order holds; suffixes and short names with more than
    one owner are left out. Every lookup has one row per key.
    """
    n = nodes.filter("qualified_name <> ''").select("id", F.regexp_replace("qualified_name", r"^\\+", "").alias("q"))
    exact = n.groupBy(F.col("q").alias("key")).agg(F.max("id").alias("exact_id"))
    suffix = n.select("id", F.explode(S.name_suffixes(F.col("q"))).alias("key")).groupBy("key").agg(F.min("id").alias("suffix_id"), F.max("id").alias("b"))
    short = n.select("id", S.short_name(F.col("q")).alias("key")).groupBy("key").agg(F.min("id").alias("short_id"), F.max("id").alias("b"))
    one = lambda df, c: df.filter(f"{c} = b").drop("b")
    return exact, one(suffix, "suffix_id"), one(short, "short_id")


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, name, kind, target_id, confidence, tier): every reference with the target of its best tier.

    Exact qualified name, unique suffix, unique short name, else a placeholder. Names are reduced
    to distinct ones before the lookups, so a name that a third of all references carry is looked
    up once; the answer goes back to the references by a salted join. Empty names are dropped.
    """
    name = F.regexp_replace("name", r"^\\+|\\+$", "")
    r = refs.withColumn("key", name).filter("key <> ''")
    exact, suffix, short = symbol_tables(nodes)
    names = r.select("key").distinct().withColumn("last", S.short_name(F.col("key")))
    found = names.join(exact, "key", "left").join(suffix, "key", "left").join(short.withColumnRenamed("key", "last"), "last", "left")
    tier = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("suffix_id").isNotNull(), "suffix").when(F.col("short_id").isNotNull(), "short").otherwise("placeholder")
    target = F.coalesce("exact_id", "suffix_id", "short_id", S.placeholder_id(F.col("key")))
    answer = found.select("key", target.alias("target_id"), tier.alias("tier"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt"))
    conf = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])[F.col("tier")]
    salted = r.withColumn("salt", F.pmod(F.xxhash64("source_id", "kind"), F.lit(8)).cast("int"))
    return salted.join(answer, ["key", "salt"]).select("source_id", F.col("key").alias("name"), "kind", "target_id", conf.alias("confidence"), "tier")


def placeholders(resolved: DataFrame) -> DataFrame:
    """(id, name): a node for every placeholder, once."""
    return resolved.filter("tier = 'placeholder'").groupBy(F.col("target_id").alias("id")).agg(F.min("name").alias("name"))


def match_calls(calls: DataFrame, endpoints: DataFrame, max_distance: int = 3, prefix_segments: int = 2) -> DataFrame:
    """(call_id, endpoint_id, confidence, strategy): the best endpoint of every call that has one.

    Equal paths; equal paths with parameters folded; the same first segments; and paths within
    ``max_distance`` edits and 30 % of the longer. Methods must agree or be unknown. The first
    three are equi-joins over distinct paths. Near paths are found by deletion neighbourhoods'
    coarser form, equal pieces: within d edits one of d + 1 pieces of a path stands unchanged,
    moved by at most d, so candidates meet on (piece, place) and never in a cross product.
    """
    c = calls.select("call_id", F.upper("method").alias("cm"), S.without_query(S.clean_template(F.col("url"))).alias("u"), F.col("confidence").alias("cc")).withColumn("cp", S.url_path(F.col("u")))
    e = endpoints.select("endpoint_id", F.upper("method").alias("em"), F.col("path").alias("ep"))
    cp, ep = c.select("cp").distinct(), e.select("ep").distinct()
    norm = S.normalise_url
    exact = cp.join(ep, F.col("cp") == F.col("ep")).select("cp", "ep", F.lit("exact").alias("strategy"), F.lit(MATCHES["exact"]).alias("base"))
    par = cp.withColumn("k", norm(F.col("cp"))).join(ep.withColumn("k", norm(F.col("ep"))), "k").select("cp", "ep", F.lit("parameterized").alias("strategy"), F.lit(MATCHES["parameterized"]).alias("base"))
    first = lambda p: F.array_join(F.slice(S.segments(norm(p)), 1, prefix_segments), "/")
    long_enough = lambda p: F.size(S.segments(p)) >= prefix_segments
    a = cp.filter(long_enough(F.col("cp"))).withColumn("k", first(F.col("cp")))
    b = ep.filter(long_enough(F.col("ep"))).withColumn("k", first(F.col("ep")))
    is_prefix = lambda x, y: F.slice(S.segments(norm(y)), 1, F.size(S.segments(norm(x)))) == S.segments(norm(x))
    pre = a.join(b, "k").filter(is_prefix(F.col("cp"), F.col("ep")) | is_prefix(F.col("ep"), F.col("cp"))).select("cp", "ep", F.lit("prefix").alias("strategy"), F.lit(MATCHES["prefix"]).alias("base"))
    near = near_texts(cp.select(F.col("cp").alias("x")), ep.select(F.col("ep").alias("y")), max_distance).filter(F.col("dist") < 0.3 * F.greatest(F.length("x"), F.length("y")))
    fuzzy = near.select(F.col("x").alias("cp"), F.col("y").alias("ep"), F.lit("fuzzy").alias("strategy"), (MATCHES["fuzzy"] * (1 - F.col("dist") / F.greatest(F.length("x"), F.length("y")))).alias("base"))
    paths = exact.unionByName(par).unionByName(pre).unionByName(fuzzy).groupBy("cp", "ep").agg(F.max(F.struct("base", "strategy")).alias("m"))
    pairs = c.join(paths, "cp").join(e, "ep").filter((F.col("cm") == "UNKNOWN") | (F.col("em") == "ANY") | (F.col("cm") == F.col("em")))
    conf = F.round(F.col("m.base") * F.col("cc"), 6)
    best = pairs.select("call_id", F.struct(conf.alias("confidence"), F.col("m.strategy").alias("strategy")).alias("v"), "endpoint_id")
    return best.groupBy("call_id").agg(F.max(F.struct(F.col("v.confidence").alias("c"), (-F.xxhash64("endpoint_id")).alias("h"), "endpoint_id", F.col("v.strategy").alias("strategy"))).alias("b")).select(
        "call_id", F.col("b.endpoint_id").alias("endpoint_id"), F.col("b.c").alias("confidence"), F.col("b.strategy").alias("strategy")
    )


def near_texts(xs: DataFrame, ys: DataFrame, d: int) -> DataFrame:
    """(x, y, dist): all pairs of distinct texts within ``d`` edits, none lost.

    y is cut into d + 1 pieces by its length; x offers each of its substrings that could be such a
    piece of a text of nearly its length. Of the pieces that a near text keeps whole, one lies so
    that at most i edits stand before piece i and d - i after it (counted from 0), so its place in
    x is bound by both. A piece that is empty (texts shorter than d + 1) meets by length alone,
    which is exact for those few short texts. The pieces are joined by merging: a text has many,
    and the planner, which sees only how many texts there are, would broadcast them all. Pairs are
    compared where they meet, so only near ones are shuffled.
    """
    k = d + 1
    n = F.length("y")
    begin = lambda i: F.floor(n * i / k)
    pieces = F.array(*[F.struct(F.lit(i).alias("i"), n.alias("len"), F.substr(F.col("y"), (begin(i) + 1).cast("int"), (begin(i + 1) - begin(i)).cast("int")).alias("piece")) for i in range(k)])
    right = ys.distinct().select("y", F.explode(pieces).alias("p")).select("y", "p.*")
    m = F.length("x")
    lens = F.explode(F.sequence(F.greatest(m - d, F.lit(0)), m + d)).alias("len")
    left = xs.distinct().select("x", lens).select("x", "len", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("i"))
    start = F.floor(F.col("len") * F.col("i") / k)
    size = F.floor(F.col("len") * (F.col("i") + 1) / k) - start
    left = left.select("x", "len", "i", start.cast("int").alias("s"), size.cast("int").alias("z"))
    shift, after = m - F.col("len"), F.lit(d) - F.col("i")
    first = F.greatest(F.lit(0), F.col("s") - F.col("i"), F.col("s") + shift - after)
    last = F.least(m - F.col("z"), F.col("s") + F.col("i"), F.col("s") + shift + after)
    left = left.select("x", "len", "i", "z", first.alias("first"), last.alias("last")).filter("first <= last")
    cut = F.array_distinct(F.transform(F.sequence("first", "last"), lambda at: F.substr("x", at + 1, F.col("z"))))
    left = left.select("x", "len", "i", F.explode(cut).alias("piece"))
    pairs = left.join(right.hint("merge"), ["len", "i", "piece"])
    return pairs.select("x", "y", F.levenshtein("x", "y", d).alias("dist")).filter("dist >= 0").distinct()


def enclosing(points: DataFrame, intervals: DataFrame, group: str, at: str = "line", width: int = 64) -> DataFrame:
    """Points with the narrowest interval (start, end, owner) of their group that holds them, else null.

    Intervals and points meet on (group, block of lines), so a group of any size is spread over
    its blocks; an interval is offered to every block it touches.
    """
    blocks = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("start"), F.col("end")) / width))).alias("block")
    iv = intervals.select(group, "start", "end", "owner", blocks)
    p = points.withColumn("block", F.floor(F.col(at) / width))
    keys = [c for c in points.columns]
    hits = p.join(iv, [group, "block"]).filter(F.col(at).between(F.col("start"), F.col("end")))
    best = hits.groupBy(*keys).agg(F.min(F.struct((F.col("end") - F.col("start")).alias("span"), F.col("start").alias("s"), "owner"))["owner"].alias("owner"))
    return points.distinct().join(best, keys, "left")


def all_enclosing(points: DataFrame, intervals: DataFrame, group: str, at: str = "line", width: int = 64) -> DataFrame:
    """Every (point, owner) where the owner's interval holds the point."""
    blocks = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("start"), F.col("end")) / width))).alias("block")
    return points.withColumn("block", F.floor(F.col(at) / width)).join(intervals.select(group, "start", "end", "owner", blocks), [group, "block"]).filter(F.col(at).between(F.col("start"), F.col("end"))).drop("block", "start", "end")


def nearest(points: DataFrame, marks: DataFrame, group: str, at: str, mark: str, before: int, after: int) -> DataFrame:
    """Points with the nearest mark of their group within [at - before, at + after]; of equal ones the first.

    Points are offered to the few blocks their window touches.
    """
    width = before + after + 1
    blocks = F.explode(F.sequence(F.floor((F.col(at) - before) / width), F.floor((F.col(at) + after) / width))).alias("block")
    m = marks.select(group, F.col(mark).alias("m_at"), F.col("owner"), F.floor(F.col(mark) / width).alias("block"))
    hits = points.select("*", blocks).join(m, [group, "block"]).filter((F.col("m_at") >= F.col(at) - before) & (F.col("m_at") <= F.col(at) + after))
    best = hits.groupBy(*points.columns).agg(F.min(F.struct(F.abs(F.col("m_at") - F.col(at)).alias("gap"), "m_at", "owner"))["owner"].alias("owner"))
    return points.distinct().join(best, points.columns, "left")


def as_of(points: DataFrame, marks: DataFrame, group: str, at: str, mark: str, value: str) -> DataFrame:
    """Points with the value of the last mark of their group at or before them (a backward as-of join).

    Both are sorted together once and the last mark carried forward: no pair of a point and an
    earlier mark is ever formed.
    """
    tag = points.select("*", F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(marks.schema[value].dataType).alias("__v"))
    m = marks.select(group, F.col(mark).alias("__t"), F.lit(0).alias("__kind"), F.col(value).alias("__v"))
    w = Window.partitionBy(group).orderBy("__t", "__kind", "__v").rowsBetween(Window.unboundedPreceding, 0)
    both = tag.unionByName(m, allowMissingColumns=True).withColumn("found", F.last("__v", ignorenulls=True).over(w))
    return both.filter("__kind = 1").select(*points.columns, F.col("found").alias(value))


def by_name(users: DataFrame, owners: DataFrame, name: str, priority: Column | None = None) -> DataFrame:
    """Users with the owner of their name: the one of least priority, then least id."""
    p = priority if priority is not None else F.lit(0)
    best = owners.groupBy(name).agg(F.min(F.struct(p.alias("p"), "id"))["id"].alias("owner"))
    return users.join(best, name)


def class_uses(sources: DataFrame, classes: DataFrame, confidence: float = 0.7) -> DataFrame:
    """(file_path, class_id, confidence, line): the CSS classes that sources name in class and className attributes, once a file."""
    lines = sources.select("file_path", F.posexplode(F.split("text", "\n")).alias("line", "code"))
    hit = F.regexp_extract_all("code", F.lit(r"(?:className|class)\s*=\s*[{]?\s*[\"'`]([^\"'`]+)[\"'`]"), F.lit(1))
    tokens = lines.select("file_path", (F.col("line") + 1).alias("line"), F.explode(hit).alias("names")).select("file_path", "line", F.explode(F.split("names", r"\s+")).alias("name"))
    tokens = tokens.filter("name <> ''").groupBy("file_path", "name").agg(F.min("line").alias("line"))
    owners = classes.select(F.regexp_replace("name", r"^\.+", "").alias("name"), F.col("id").alias("class_id"))
    return tokens.join(owners, "name").groupBy("file_path", "class_id").agg(F.min("line").alias("line")).select("file_path", "class_id", F.lit(confidence).alias("confidence"), "line")


def variable_bridge(sources: DataFrame, variables: DataFrame) -> DataFrame:
    """(file_path, variable_id, kind): custom properties that scripts set or read, by name."""
    sets = F.regexp_extract_all("text", F.lit(r"setProperty\s*\(\s*[\"'](--[\w-]+)[\"']"), F.lit(1))
    gets = F.regexp_extract_all("text", F.lit(r"getPropertyValue\s*\(\s*[\"'](--[\w-]+)[\"']"), F.lit(1))
    use = sources.select("file_path", F.explode(F.concat(F.transform(sets, lambda x: F.struct(x.alias("name"), F.lit("js_sets_css_variable").alias("kind"))), F.transform(gets, lambda x: F.struct(x.alias("name"), F.lit("js_reads_css_variable").alias("kind"))))).alias("u")).select("file_path", "u.name", "u.kind")
    return use.distinct().join(variables.select("name", F.col("id").alias("variable_id")), "name").select("file_path", "variable_id", "kind").distinct()


def utility_tokens(names: DataFrame, tokens: DataFrame) -> DataFrame:
    """(name, token_id): utility class names (prefix-value) with the theme token of their prefix's namespace.

    The prefix ends at the first or second dash; a known longer prefix wins. A token is named
    --namespace-value; a value of any namespace is the fallback.
    """
    parts = F.split("name", "-")
    two = F.concat_ws("-", parts[0], parts[1])
    n = names.select("name", parts.alias("p"), two.alias("two")).filter(F.size("p") > 1)
    ns2, ns1 = S.utility_namespace(F.col("two")), S.utility_namespace(F.col("p")[0])
    ns = F.coalesce(ns2, ns1)
    value = F.when(ns2.isNotNull(), F.array_join(F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0))), "-")).otherwise(F.array_join(F.slice("p", 2, F.size("p") - 1), "-"))
    u = n.select("name", ns.alias("ns"), value.alias("value")).filter("ns is not null and value <> ''")
    t = tokens.select(F.regexp_replace("name", "^--", "").alias("key"), "id").groupBy("key").agg(F.min("id").alias("token_id"))
    return u.withColumn("key", F.concat_ws("-", "ns", "value")).join(t, "key").select("name", "token_id")


# The kinds of nodes that a link to another file may mean, best first.
FAR_KINDS = {
    "hook": "hook function", "component": "component class function", "provider": "provider variable constant", "service": "provider class", "model": "model class",
    "view": "controller class function", "controller": "controller class", "event": "event class", "listener": "listener class", "router": "module variable", "blueprint": "module variable",
    "dependency": "function class", "store": "module function", "module": "module class", "utility": "tailwind_utility css_class", "context": "provider constant",
}


def link_far(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose end is ``__unresolved__:kind:name`` with that end found by name, best kind and least id first.

    A name ``Class@method`` is looked up by its class. Ends that no node answers stay as they are,
    so dangling links can be counted. Edges between known nodes are kept and take no part in the
    joins; a name that many edges point at is salted.
    """
    order = [F.struct(F.lit(k).alias("far"), F.lit(kind).alias("kind"), F.lit(p).alias("p")) for k, v in FAR_KINDS.items() for p, kind in enumerate(v.split())]
    dim = nodes.sparkSession.range(1).select(F.explode(F.array(*order)).alias("o")).select("o.*")
    owners = nodes.join(F.broadcast(dim), "kind").groupBy("far", "name").agg(F.min(F.struct("p", "id"))["id"].alias("owner"))  # dim: a fixed table
    open_ = F.col("source_id").startswith("__unresolved__:") | F.col("target_id").startswith("__unresolved__:")
    known, out = edges.filter(~F.coalesce(open_, F.lit(False))), edges.filter(open_)
    for end in ("source_id", "target_id"):
        parts = F.split(end, ":", 3)
        is_far = F.col(end).startswith("__unresolved__:")
        name = F.substring_index(F.element_at(parts, 3), "@", 1)
        near, far = out.filter(~is_far | F.col(end).isNull()), out.filter(is_far).withColumn("far", F.element_at(parts, 2)).withColumn("name", name)
        far = salted_join(far, owners, ["far", "name"], "left").withColumn(end, F.coalesce("owner", end))
        out = near.select(*edges.columns).unionByName(far.select(*edges.columns))
    return known.unionByName(out)
