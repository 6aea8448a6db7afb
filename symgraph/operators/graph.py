"""Graph operators over (src, dst) edges: traversals, ranks, components, communities, paths, cycles.

Loops run on the driver, but each round is one distributed plan; its result is checkpointed, so
lineage stays short and a lost executor costs one round at most. Only counts, single booleans and,
up to ``LABEL_NODES`` nodes, labels come to the driver. Hub nodes are combined on the map side or spread over salts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.core import cut_lineage, free_shuffles, hot_buckets, numbered, salted_join

SALTS = 16
WORKER_EDGES = 1_000_000  # pairs of ids that one Python worker labels, some 300 bytes each
SOURCE_BLOCKS = 24
WORKER_PAIRS = 8_000_000  # pairs that a Python worker holds, some 100 bytes each
BLOCK_PAIRS = 1_000_000
LABEL_NODES = 16_000_000  # nodes whose labels the driver and every worker hold, 4 bytes each


def reach(seeds: DataFrame, edges: DataFrame, max_depth: int, both: bool = False) -> DataFrame:
    """(id, depth): what the seeds (id) reach over (src, dst) in at most ``max_depth`` steps; seeds have depth 0.

    Each round joins only the frontier; nodes already met leave by an anti-join. A hub's edges are
    spread by a salt of the far end, so no task reads them alone.
    """
    e = edges.select("src", "dst")
    if both:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = e.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    seen = cut_lineage(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        near = e.join(frontier.select(F.col("id").alias("src"), salts), ["src", "salt"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut_lineage(near.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    return seen


def blast_radius(seeds: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """(id, depth): what depends on the seeds: reach over reversed edges, without the seeds."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(seeds, back, max_depth).filter("depth > 0")


def neighbours(seeds: DataFrame, edges: DataFrame, max_depth: int = 1, direction: str = "both") -> DataFrame:
    """(id, depth) of the nodes around the seeds, by outgoing, incoming or both kinds of edges."""
    if direction == "incoming":
        return blast_radius(seeds, edges, max_depth)
    return reach(seeds, edges, max_depth, direction == "both").filter("depth > 0")


def connecting_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth, kind, via, outgoing): for each found node one edge to a node one step nearer.

    Outgoing edges come first, then kind and id order; the choice is a partial aggregate.
    """
    near = found.select(F.col("id").alias("near"), (F.col("depth") + 1).alias("depth"))
    out = edges.select(F.col("source_id").alias("near"), F.col("target_id").alias("id"), "kind", F.lit(0).alias("way"))
    back = edges.select(F.col("target_id").alias("near"), F.col("source_id").alias("id"), "kind", F.lit(1).alias("way"))
    links = out.unionByName(back).join(near, "near").join(found.filter("depth > 0").select("id", "depth"), ["id", "depth"])
    first = links.groupBy("id", "depth").agg(F.min(F.struct("way", "kind", "near")).alias("f"))
    return first.select("id", "depth", F.col("f.kind").alias("kind"), F.col("f.near").alias("via"), (F.col("f.way") == 0).alias("outgoing"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6, personal: DataFrame | None = None, retry: bool = True, in_worker: int = WORKER_EDGES) -> DataFrame:
    """(id, rank): PageRank over distinct pairs.

    The mass of nodes without outgoing edges, and the jumps, go to all nodes alike or, with
    ``personal`` (id, weight), in proportion to the weights. ``tol`` 0 runs ``max_iter`` rounds;
    else a round that moves the ranks by less than ``tol`` a node in sum is the last. If there is
    none in time, ``retry`` goes on for twice as many rounds with a tolerance of 1e-4.

    A graph of at most ``in_worker`` nodes and pairs is ranked in one Python worker. Of a larger
    one each round is one plan: the sums per target are combined on the map side, so a hub target
    is cheap, a hub source's pairs meet its rank by a salted join, and the result is written, so
    that no plan grows. Both give the same ranks.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id").withColumn("rank", F.lit(0.0))
    if personal is None:
        base = nodes.select("id", F.lit(1.0 / n).alias("jump"))
    else:
        p = personal.filter("weight > 0").groupBy("id").agg(F.sum("weight").alias("weight"))
        total = p.join(nodes.select("id"), "id", "left_semi").agg(F.sum("weight")).first()[0]
        if not total:
            raise ValueError("no node has a positive weight")
        base = nodes.select("id").join(p, "id", "left").select("id", F.coalesce(F.col("weight") / F.lit(total), F.lit(0.0)).alias("jump"))
    e = cut_lineage(edges.select(F.col("src").alias("id"), "dst"))
    last, loose = max_iter * (3 if retry and tol else 1), max_iter
    if n <= in_worker and e.count() <= in_worker:
        return _ranks_in_worker(base, e, alpha, last, loose, tol)
    deg = e.groupBy("id").agg(F.count("*").alias("deg"))
    base = cut_lineage(base.join(deg, "id", "left").fillna(0, ["deg"]))
    hot = hot_buckets(e, ["id"])
    ranks = base.withColumn("rank", F.lit(1.0 / n))
    for k in range(1, last + 1):
        parts = ranks.filter("deg > 0").select("id", (F.col("rank") / F.col("deg")).alias("part"))
        sums = salted_join(e, parts, ["id"], hot=hot).groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
        lost = F.broadcast(ranks.agg(F.coalesce(F.sum(F.when(F.col("deg") == 0, F.col("rank"))), F.lit(0.0)).alias("lost")))  # one row
        new = ranks.withColumnRenamed("rank", "old").join(sums, "id", "left").crossJoin(lost)
        new = cut_lineage(new.select("id", "jump", "deg", "old", ((1 - alpha) * F.col("jump") + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("jump"))).alias("rank")))
        ranks = new.drop("old")
        if tol and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < n * (tol if k <= loose else 1e-4):
            break
    return ranks.select("id", "rank")


def _ranks_in_worker(base: DataFrame, e: DataFrame, alpha: float, last: int, loose: int, tol: float) -> DataFrame:
    rows = base.select("id", F.lit(None).cast("string").alias("dst"), "jump").unionByName(e.select("id", "dst", F.lit(None).cast("double").alias("jump")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("id", pa.string()), ("dst", pa.string()), ("jump", pa.float64())]))
        is_node = pc.is_valid(t["jump"])
        ids, pairs = t.filter(is_node), t.filter(pc.invert(is_node))
        names = ids["id"].combine_chunks()
        jump, n = ids["jump"].to_numpy(), len(names)
        a, b = (pc.index_in(pairs[c].combine_chunks(), names) for c in ("id", "dst"))
        known = pc.and_(pc.is_valid(a), pc.is_valid(b))
        a, b = (x.filter(known).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
        deg = np.bincount(a, minlength=n)
        rank = np.full(n, 1.0 / n)
        for k in range(1, last + 1):
            got = np.bincount(b, rank[a] / deg[a], n)
            new = (1 - alpha) * jump + alpha * (got + rank[deg == 0].sum() * jump)
            moved, rank = np.abs(new - rank).sum(), new
            if tol and moved < n * (tol if k <= loose else 1e-4):
                break
        yield pa.RecordBatch.from_arrays([names, pa.array(rank)], ["id", "rank"])

    return rows.coalesce(1).mapInArrow(run, "id string, rank double")


def _in_worker(nodes: DataFrame, e: DataFrame, label) -> DataFrame:
    """(id, component) from a graph of bounded size, labelled in one Python worker; nodes without pairs stand alone."""
    of = e.schema["src"].dataType.simpleString()  # string or bigint
    kind = pa.string() if of == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = pa.schema([("src", kind), ("dst", kind)])
        t = pa.Table.from_batches([pa.RecordBatch.from_arrays(x.columns, schema=s) for x in batches], s)  # batches of numbers may be not null
        names = pc.unique(pa.concat_arrays([pa.array([], kind), *t["src"].chunks, *t["dst"].chunks])).sort()  # numbers in the order of the ids
        a, b = (pc.index_in(t[c].combine_chunks(), names).to_numpy(zero_copy_only=False) for c in ("src", "dst"))
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label(len(names), a, b), pa.int64()))], ["id", "component"])

    got = e.select("src", "dst").coalesce(1).mapInArrow(run, f"id {of}, component {of}")
    return nodes.select("id").distinct().join(got, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _weak_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's weak component, by minima over pairs and pointer jumping."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for x in (a, b, before[a], before[b]):
            np.minimum.at(label, x, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _by_tail(n: int, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """(first, heads): the pairs sorted by tail; node k's heads are heads[first[k]:first[k + 1]]."""
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).tolist(), b[np.argsort(a, kind="stable")].tolist()


def _strong_labels(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """The least node of each node's strong component (Tarjan's algorithm with a stack of its own)."""
    first, heads = _by_tail(n, a, b)
    place, low, label, path, count = [-1] * n, [0] * n, [-1] * n, [], 0
    for root in range(n):
        if place[root] >= 0:
            continue
        place[root] = low[root] = count
        count += 1
        path.append(root)
        work = [(root, first[root])]
        while work:
            v, k = work.pop()
            if k < first[v + 1]:
                work.append((v, k + 1))
                w = heads[k]
                if place[w] < 0:
                    place[w] = low[w] = count
                    count += 1
                    path.append(w)
                    work.append((w, first[w]))
                elif label[w] < 0:
                    low[v] = min(low[v], place[w])
                continue
            if low[v] == place[v]:
                members = []
                while True:
                    w = path.pop()
                    members.append(w)
                    if w == v:
                        break
                least = min(members)
                for w in members:
                    label[w] = least
            if work:
                u = work[-1][0]
                low[u] = min(low[u], low[v])
    return label


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200, in_worker: int = WORKER_EDGES) -> DataFrame:
    """(id, component): weakly connected components, named by their least id.

    Up to ``in_worker`` pairs are labelled in one Python worker. More go through alternating
    large-star and small-star rounds: pairs shrink towards stars at the least id in a number of
    rounds that is logarithmic in a component's diameter. Each star is a minimum per node,
    combined on the map side and joined back to the node's pairs, a centre's by a salted join. A
    round writes its pairs once; it is the last if their number and hash sums stay as they were.
    More than ``max_rounds`` rounds are an error, never an unfinished answer.
    """
    pairs = cut_lineage(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    if pairs.count() <= in_worker:
        return _in_worker(nodes, pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), _weak_labels)
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    mark = print_of(pairs)
    for _ in range(max_rounds):
        sym = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(sym.filter("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = cut_lineage(large.filter("b < a"))
        m = low.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(low, m, ["a"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        pairs, before = cut_lineage(small), mark
        mark = print_of(pairs)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components are not finished after {max_rounds} rounds")
    return nodes.select("id").distinct().join(pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strong_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200, in_worker: int = WORKER_EDGES) -> DataFrame:
    """(id, component): strongly connected components, named by their least id.

    Up to ``in_worker`` pairs are labelled in one Python worker. Of more, only the cyclic core can
    hold components of several nodes: each round gives every node of the core the least id that
    reaches it (its colour); the nodes of a colour that reach its root back are one component and
    leave, then the core shrinks again. All other nodes stand alone.
    """
    pairs, done = cut_lineage(edges.filter("src <> dst").select("src", "dst").distinct()), None
    if pairs.count() <= in_worker:
        return _in_worker(nodes, pairs, _strong_labels)
    for _ in range(max_rounds):
        core = cyclic_core(pairs)
        ids = core.select(F.col("src").alias("id")).distinct()
        colour = cut_lineage(ids.select("id", F.col("id").alias("c")))
        if colour.isEmpty():
            break
        while True:
            got = core.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("g"))
            new = cut_lineage(colour.join(got, "id", "left").select("id", F.least("c", F.coalesce("g", "c")).alias("c"), (F.col("g") < F.col("c")).alias("moved")))
            if new.filter("moved").isEmpty():
                break
            colour = new.drop("moved")
        found = cut_lineage(colour.filter("id = c"))
        near = found
        while True:
            back = core.join(near.select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c").distinct()
            near = cut_lineage(back.join(colour, ["id", "c"], "left_semi").join(found, ["id", "c"], "left_anti"))
            if near.isEmpty():
                break
            found = cut_lineage(found.unionByName(near))
        done = found if done is None else done.unionByName(found)
        pairs = core.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
    else:
        raise RuntimeError(f"more than {max_rounds} rounds")
    n = nodes.select("id").distinct()
    return n.select("id", F.col("id").alias("component")) if done is None else n.join(done, "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def is_dag(nodes: DataFrame, edges: DataFrame, in_worker: int = WORKER_EDGES) -> bool:
    """Whether no path leads back to where it began (a loop is such a path)."""
    e = cut_lineage(edges.select("src", "dst").distinct())
    if not e.filter("src = dst").isEmpty():
        return False
    if e.count() > in_worker:
        return cyclic_core(e).isEmpty()
    return strong_components(nodes, e, in_worker=in_worker).filter("id <> component").isEmpty()


def cyclic_core(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """The edges left when nodes without an incoming edge are peeled again and again; none: the graph is acyclic."""
    e = cut_lineage(edges.select("src", "dst").distinct())
    size = e.count()
    for _ in range(max_rounds):
        kept = cut_lineage(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        n = kept.count()
        if n == size or n == 0:
            return kept
        e, size = kept, n
    raise RuntimeError(f"more than {max_rounds} rounds")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 100, in_worker: int = WORKER_EDGES) -> DataFrame:
    """(id, community, size): communities of the undirected graph, largest first (numbered from 0); isolated nodes have none.

    Up to ``in_worker`` pairs: moves of single nodes that raise the modularity, refined so that
    every community is connected, then the same on the graph of communities, until nothing moves
    (Leiden's scheme, nodes in the order of their ids, so the answer is always the same). More
    pairs: ``label_propagation``.
    """
    e = cut_lineage(edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    if e.count() <= in_worker:
        on = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        labels = _in_worker(on, e, _modular_labels).withColumnRenamed("component", "label")
    else:
        labels = label_propagation(e, rounds)
    labels = cut_lineage(labels)
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    # one row a community, ordered by range partitions, numbered by their counts before
    ordered = cut_lineage(sizes.repartitionByRange(F.col("size").desc(), "label").sortWithinPartitions(F.col("size").desc(), "label").withColumn("p", F.spark_partition_id()))
    before = ordered.groupBy("p").agg(F.count("*").alias("k")).select("p", F.coalesce(F.sum("k").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row a partition
    numbered = ordered.join(F.broadcast(before), "p").select("label", "size", (F.col("base") + F.row_number().over(Window.partitionBy("p").orderBy(F.col("size").desc(), "label")) - 1).alias("community"))
    return salted_join(labels, numbered, ["label"]).select("id", "community", "size")


def _modular_labels(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """A community of each node (its least node) by local moves of modularity, refined and repeated on the communities."""
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for x, y in zip(a.tolist(), b.tolist()):
        links[x][y] = links[x].get(y, 0.0) + 1.0
        links[y][x] = links[y].get(x, 0.0) + 1.0
    total = 2.0 * len(a)
    top = list(range(n))  # the node of the present graph that each node of the first one belongs to
    own = [0.0] * n  # twice the weight inside
    while True:
        m = len(links)
        degree = [sum(v.values()) + w for v, w in zip(links, own)]
        label, weight = list(range(m)), degree[:]
        queue, queued = deque(range(m)), [True] * m
        while queue:
            v = queue.popleft()
            queued[v] = False
            near: dict[int, float] = {}
            for w, x in links[v].items():
                near[label[w]] = near.get(label[w], 0.0) + x
            old, d = label[v], degree[v]
            weight[old] -= d
            best, gain = old, near.get(old, 0.0) - weight[old] * d / total
            for c in sorted(near):
                g = near[c] - weight[c] * d / total
                if g > gain + 1e-12:
                    best, gain = c, g
            weight[best] += d
            if best != old:
                label[v] = best
                for w in links[v]:
                    if not queued[w] and label[w] != best:
                        queued[w] = True
                        queue.append(w)
        # a community that its moves left in several pieces is parted into them
        piece, found = [-1] * m, 0
        for v in range(m):
            if piece[v] < 0:
                piece[v], work = found, [v]
                while work:
                    u = work.pop()
                    for w in links[u]:
                        if piece[w] < 0 and label[w] == label[v]:
                            piece[w] = found
                            work.append(w)
                found += 1
        if found == m:
            break
        merged: list[dict[int, float]] = [{} for _ in range(found)]
        inside = [0.0] * found
        for v in range(m):
            p = piece[v]
            inside[p] += own[v]
            for w, x in links[v].items():
                if piece[w] == p:
                    inside[p] += x
                else:
                    merged[p][piece[w]] = merged[p].get(piece[w], 0.0) + x
        top, links, own = [piece[t] for t in top], merged, inside
    least: dict[int, int] = {}
    for v, t in enumerate(top):
        least.setdefault(t, v)
    return [least[t] for t in top]


def label_propagation(edges: DataFrame, rounds: int = 100, most: int = LABEL_NODES, in_block: int = WORKER_PAIRS) -> DataFrame:
    """(id, label): label propagation over undirected distinct pairs until no label moves or ``rounds`` are done.

    Synchronous rounds; each node takes the most frequent label around it, its own one counted too,
    the least of equals. Two states may swing for ever: once a round repeats the last but one, the
    state after ``rounds`` rounds is known. Ids are numbered first. Up to ``most`` nodes, and if no
    block holds over ``in_block`` pairs, each worker counts the votes of its block of nodes and only
    labels that moved leave it, so a round shuffles and writes nothing; beyond, rounds are joins.
    """
    ids = numbered(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    to = lambda c: ids.select(F.col("id").alias(c), F.col("number").alias(f"n_{c}"))
    e = edges.select("src", "dst").join(to("src"), "src").select("n_src", "dst").join(to("dst"), "dst")
    sym = cut_lineage(e.select(F.explode(F.array(F.struct(F.col("n_src").alias("a"), F.col("n_dst").alias("id")), F.struct(F.col("n_dst").alias("a"), F.col("n_src").alias("id")))).alias("x")).select("x.*"))
    n, pairs = ids.count(), sym.count()
    blocks = max(sym.sparkSession.sparkContext.defaultParallelism, -(-pairs // BLOCK_PAIRS))
    largest = sym.groupBy(F.pmod(F.hash("id"), F.lit(blocks))).count().agg(F.max("count")).first()[0] or 0
    labels = _labels_in_blocks(sym, n, blocks, rounds) if n <= most and largest <= in_block else _labels_in_tables(sym, rounds)
    named = labels.join(ids.select(F.col("number").alias("k"), F.col("id").alias("name")), F.col("id") == F.col("k")).select("name", F.col("label").alias("k"))
    return named.join(ids.select(F.col("number").alias("k"), "id"), "k").select(F.col("name").alias("id"), F.col("id").alias("label"))


def _labels_in_blocks(sym: DataFrame, n: int, blocks: int, rounds: int) -> DataFrame:
    """(id, label) over numbers: the pairs of a block of nodes stay in one row; the driver holds the labels, 4 bytes a node, and sends them to the workers."""
    sc = sym.sparkSession.sparkContext

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, i = [], []
        for x in batches:
            a.append(x["a"].to_numpy(zero_copy_only=False).astype(np.int32))
            i.append(x["id"].to_numpy(zero_copy_only=False).astype(np.int32))
        if sum(map(len, a)):
            a, i = np.concatenate(a), np.concatenate(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a.tobytes()], pa.binary()), "id": pa.array([i.tobytes()], pa.binary())})

    packed = cut_lineage(sym.repartition(blocks, "id").select("a", "id").mapInArrow(pack, "a binary, id binary"))

    def each(x: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, i in zip(x["a"], x["id"]):
            yield np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(i.as_buffer(), np.int32)

    def vote(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, i in (y for x in batches for y in each(x)):
                own, new = _votes(sent.value, a, i)
                moved = new != sent.value[own]
                if moved.any():
                    yield pa.RecordBatch.from_pydict({"id": pa.array([own[moved].tobytes()], pa.binary()), "label": pa.array([new[moved].tobytes()], pa.binary())})

        return packed.mapInArrow(run, "id binary, label binary")

    labels, before = np.arange(n, dtype=np.int32), None
    for k in range(1, rounds + 1):
        sent = sc.broadcast(labels)
        new = labels.copy()
        for r in vote(sent).collect():
            new[np.frombuffer(r["id"], np.int32)] = np.frombuffer(r["label"], np.int32)
        sent.destroy()
        if np.array_equal(new, labels):
            break
        if before is not None and np.array_equal(new, before):
            labels = labels if (rounds - k) % 2 else new
            break
        before, labels = labels, new
    sent = sc.broadcast(labels)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i in (y for x in batches for y in each(x)):
            own = np.unique(i)
            yield pa.RecordBatch.from_pydict({"id": own.astype(np.int64), "label": sent.value[own].astype(np.int64)})

    out = cut_lineage(packed.mapInArrow(unpack, "id bigint, label bigint"))
    sent.destroy()
    return out


def _votes(labels: np.ndarray, a: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of ``i`` and the most frequent label of each over its ``a`` and itself, the least of equals."""
    own, at = np.unique(i, return_inverse=True)
    key = np.concatenate([at, np.arange(len(own))]).astype(np.int64) * len(labels) + np.concatenate([labels[a], labels[own]])
    key, count = np.unique(key, return_counts=True)
    node, label = np.divmod(key, len(labels))
    most = np.maximum.reduceat(count, np.searchsorted(node, np.arange(len(own))))
    best = np.flatnonzero(count == most[node])
    return own, label[best[np.searchsorted(node[best], np.arange(len(own)))]].astype(np.int32)


def _labels_in_tables(sym: DataFrame, rounds: int) -> DataFrame:
    """(id, label) over numbers, a join a round: counts per (node, label) are combined on the map side; a hub's label goes to its pairs by a salted join."""
    hot = hot_buckets(sym, ["id"])

    def after(state: DataFrame) -> DataFrame:
        votes = salted_join(sym, state.select("id", "label"), ["id"], hot=hot).select(F.col("a").alias("id"), "label").unionByName(state.select("id", "label"))
        counts = votes.groupBy("id", "label").agg(F.count("*").alias("n"))
        new = counts.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label"))
        return cut_lineage(new.join(state.select("id", F.col("label").alias("old"), F.col("old").alias("older")), "id"))

    state = cut_lineage(sym.select("id").distinct().select("id", F.col("id").alias("label"), F.lit(None).cast("long").alias("old")))
    for k in range(1, rounds + 1):
        state = after(state)
        free_shuffles(sym.sparkSession)
        if state.filter("label <> old").isEmpty():
            break
        if state.filter("older is null or label <> older").isEmpty():
            return state.select("id", F.col("old" if (rounds - k) % 2 else "label").alias("label"))
    return state.select("id", "label")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity): of a partition over the undirected distinct pairs."""
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    x = e.join(labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    inside = x.filter("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("inside"))
    deg = x.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("deg"))
    m = F.broadcast(x.agg(F.count("*").alias("m")))  # one row
    y = deg.join(inside, "c", "left").fillna(0, ["inside"]).crossJoin(m)
    return y.agg(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)).alias("modularity"))


def shortest_path(edges: DataFrame, src: str, dst: str, in_worker: int = WORKER_EDGES) -> list[str] | None:
    """The nodes of a shortest directed path (of equal ones by least parents), or null if there is none, however long.

    Breadth first with a parent per node, up to ``in_worker`` pairs in one Python worker, else level
    by level in tables; only the path itself, one node a level, comes to the driver.
    """
    if src == dst:
        return [src]
    e = cut_lineage(edges.select("src", "dst").distinct())
    if e.count() <= in_worker:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near: dict[str, list[str]] = {}
            for b in batches:
                for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    near.setdefault(x, []).append(y)
            parent, level = {src: None}, [src]
            while level and dst not in parent:
                step: dict[str, str] = {}
                for v in sorted(level):
                    for w in near.get(v, ()):
                        if w not in parent:
                            step.setdefault(w, v)
                parent |= step
                level = list(step)
            path, at = [], dst if dst in parent else None
            while at is not None:
                path.append(at)
                at = parent[at]
            yield pa.RecordBatch.from_arrays([pa.array([path[::-1]], pa.list_(pa.string()))], ["path"])

        rows = e.coalesce(1).mapInArrow(run, "path array<string>").collect()  # one row
        return (list(rows[0]["path"]) or None) if rows else None
    seen = cut_lineage(edges.sparkSession.createDataFrame([(src, None, 0)], "id string, parent string, depth int"))
    frontier, depth = seen, 0
    while frontier.filter(F.col("id") == dst).isEmpty():
        depth += 1
        step = e.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = cut_lineage(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return None
        seen = cut_lineage(seen.unionByName(frontier))
    path, at = [dst], dst
    while at != src:
        at = seen.filter(F.col("id") == at).select("parent").first()[0]
        path.append(at)
    return path[::-1]


def simple_cycles(edges: DataFrame, max_length: int = 10, limit: int | None = 100) -> DataFrame:
    """(cycle, length): simple cycles as arrays that begin at their least id, shortest first.

    Paths are extended one edge a round inside the cyclic core, only to nodes greater than the
    root, so every cycle is met once. A limit stops the rounds once enough cycles are closed.
    """
    e = cyclic_core(edges)
    paths = e.filter("dst >= src").select(F.array("src").alias("path"), "dst")
    out, n = None, 0
    for length in range(1, max_length + 1):
        paths = cut_lineage(paths)
        closed = cut_lineage(paths.filter(F.col("dst") == F.col("path")[0]).select(F.col("path").alias("cycle"), F.lit(length).alias("length")))
        out = closed if out is None else out.unionByName(closed)
        n += closed.count()
        grown = paths.filter((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src"))
        paths = grown.join(e.withColumnRenamed("dst", "next"), "src").select("path", F.col("next").alias("dst"))
        paths = paths.filter(F.col("dst") >= F.col("path")[0])
        if (limit is not None and n >= limit) or grown.isEmpty():
            break
    out = out.orderBy("length", "cycle")
    return out.limit(limit) if limit is not None else out


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) over distinct pairs; isolated nodes have 0."""
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    return nodes.select("id").join(i, "id", "left").join(o, "id", "left").fillna(0, ["in_degree", "out_degree"])


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean and greatest degrees, isolated nodes."""
    d = degrees(nodes, edges)
    n, m = F.count("*"), F.sum("out_degree")
    density: Column = F.when(n > 1, m / (n * (n - 1))).otherwise(0.0)
    return d.agg(
        n.alias("n"), m.alias("m"), F.round(density, 9).alias("density"), F.round(F.avg("in_degree"), 6).alias("avg_degree"), F.max("in_degree").alias("max_in"),
        F.max("out_degree").alias("max_out"), F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("isolates"),
    )


def induced(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges between the nodes of ``ids``."""
    i = ids.select("id").distinct()
    return edges.join(i.withColumnRenamed("id", "src"), "src", "left_semi").join(i.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame, in_worker: int = WORKER_PAIRS) -> DataFrame:
    """(id, betweenness): Brandes' dependencies summed over all shortest paths from ``sources``, unnormalised.

    Paths have any length. A graph of at most ``in_worker`` pairs is shuffled to blocks of sources,
    which are walked one by one in a Python worker; a larger one is walked for all sources at once
    in tables, one row per (source, reached node). Both give the same scores.
    """
    e = cut_lineage(edges.filter("src <> dst").select("src", "dst").distinct())
    if e.count() <= in_worker:
        scores = _dependencies_in_blocks(nodes, e, sources)
    else:
        scores = _dependencies_in_tables(e, sources)
    return nodes.select("id").join(scores, "id", "left").fillna(0.0, ["betweenness"])


def _dependencies_in_blocks(nodes: DataFrame, e: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, betweenness) of nodes on paths: each block of sources with the whole graph, as numbers, in one task."""
    ids = cut_lineage(nodes.select("id").distinct().withColumn("n", F.monotonically_increasing_id()))
    pairs = e.join(ids.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst").select("a", "b")
    pairs = pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(SOURCE_BLOCKS - 1))))
    blocks = sources.select("id").join(ids, "id").select("n", F.pmod(F.xxhash64("n"), F.lit(SOURCE_BLOCKS)).cast("int").alias("block"))
    parts = blocks.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(_block_dependencies, "n bigint, dep double")
    return parts.groupBy("n").agg(F.sum("dep").alias("betweenness")).join(ids, "n").select("id", "betweenness")


def _block_dependencies(sources: pa.Table, pairs: pa.Table) -> pa.Table:
    """(n, dep): Brandes' dependencies of the nodes (n) of pairs (a, b), summed over a block of sources (n)."""
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    tail, head = ends[: len(a)], ends[len(a) :]
    head = head[np.argsort(tail, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=len(names)))])
    total, stamp = np.zeros(len(names)), np.zeros(len(names), np.int64)
    for s in np.flatnonzero(np.isin(names, sources["n"].to_numpy())):
        met, paths, dep = np.zeros(len(names), bool), np.zeros(len(names)), np.zeros(len(names))
        met[s], paths[s], levels, near = True, 1.0, [], np.array([s])
        while len(near):
            n = first[near + 1] - first[near]
            u = np.repeat(near, n)
            v = head[np.repeat(first[near] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            new = ~met[v]
            u, v = u[new], v[new]
            np.add.at(paths, v, paths[u])
            levels.append((u, v))
            stamp[v] = k = np.arange(len(v))
            near = v[stamp[v] == k]
            met[near] = True
        for u, v in reversed(levels):
            np.add.at(dep, u, paths[u] / paths[v] * (1 + dep[v]))
        dep[s] = 0
        total += dep
    on = np.flatnonzero(total)
    return pa.table({"n": names[on], "dep": total[on]})


def _dependencies_in_tables(e: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, betweenness) of nodes on paths: levels with path counts, then dependencies level by level back."""
    level = cut_lineage(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))
    seen, levels = level, [level]
    while True:
        step = level.join(e.withColumnRenamed("src", "v"), "v").groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        level = cut_lineage(step.join(seen.select("s", "v"), ["s", "v"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level)
    deeper = levels[-1].select("s", "v", "paths", F.lit(0.0).alias("dep"))
    total = deeper.limit(0).select("v", "dep")
    for level in reversed(levels[:-1]):
        share = e.withColumnRenamed("dst", "v").join(deeper, "v").select("s", F.col("src").alias("u"), ((1 + F.col("dep")) / F.col("paths")).alias("q"))
        share = share.groupBy("s", F.col("u").alias("v")).agg(F.sum("q").alias("q"))
        deeper = cut_lineage(level.join(share, ["s", "v"], "left").select("s", "v", "paths", F.coalesce(F.col("paths") * F.col("q"), F.lit(0.0)).alias("dep")))
        total = total.unionByName(deeper.filter("s <> v").select("v", "dep"))
    return total.groupBy(F.col("v").alias("id")).agg(F.sum("dep").alias("betweenness"))
