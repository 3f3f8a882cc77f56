"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

Nearness is the inner product. The graph is built on lifted vectors: one more component makes all lengths equal, so the nearest
by inner product are the nearest by angle too, whatever the vectors' lengths. Lifted distances are worked out from the vectors and
their lengths in double precision, without the lift's own cancellation, so one very long vector does not make all others alike.

Method. Equal vectors are folded into one node, and nodes are dealt by hash to shards that a task can hold. A shard's first graph comes from
random projection trees. Then, in each round, a node gathers the nodes around it (its neighbours, and nodes whose neighbour it is),
scores those that are neighbours of neighbours with each other, and offers each the best that it met; offers and the old graph are merged
to the DEGREE nearest. Rounds end when few links change. Each query searches the graph of every shard: it begins at some random nodes, the
longest ones and its own; each round opens its EXPAND best nodes that are not open yet, scores their neighbours in double precision and keeps
the POOL best, until it has no closed node among its best. For the search, rings through random orders of the nodes add long links, so that
tight groups of vectors, which only link among themselves, are left again.
Rows without any structure need wider searches: the recall of PROBES queries is measured against all nodes, and pools grow for
these until it reaches GOAL; then all queries search once, with that pool. A pool that holds a whole shard is an exact search.

Scale. There are SHARDS shards until these reach SHARD nodes or VALUES components each; then there are more, and none grows. A task meets one shard
and at most QUERIES queries, and is done with a few of these at a time, so its memory is bounded. What is moved is each shard once for the graph
and once for each QUERIES queries, and each query once for each shard. As queries are a share of the rows and each meets every shard, the work of the
search grows faster than the table once there are more than SHARDS shards; within a shard it follows the pool, not the shard's size.
Members of a node beyond TOP + 1 can never be among the TOP nearest of anyone (ties go to smaller ids), so that many are kept for
each node, and a query meets members only of nodes that can reach its TOP. Recall is measured against brute force in the tests.

Defined results. Vectors that are null, zero, or hold null or non-finite components take no part, as queries either; so do
rows without an id. Rows that repeat an id are all candidates; of their vectors the smallest is the query, and its own row alone is
left out. Vectors have one length, that of most rows' arrays (the shorter on ties); others take no part. With TOP or fewer
candidates all are found. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

TOP = 20
EVERY = 20
DEGREE = 24
OFFERS = 6
BATCH = 64
ROUNDS, ENOUGH = 8, 0.02
PLANES, GROUP = 4, 64
POOL, EXPAND, RINGS, ENTRIES, LONGEST = 48, 12, 2, 48, 8
SHARDS, LEAST, SHARD, VALUES = 8, 4096, 1 << 16, 1 << 23
QUERIES, PAIRS = 1 << 14, 1 << 18
PROBES, GOAL = 64, 0.95
SEED = 42


def vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part; v is an array of doubles."""
    v = F.col(embedding).cast("array<double>")
    usable = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    usable = usable.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    width = usable.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    usable = usable.filter(F.size("v") == (width["w"] if width else 0))
    return usable


def nodes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, v, x) with one node for each distinct vector, and (node, members); x: v over the greatest length. Nodes are numbered by hash."""
    slot = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    # the smallest TOP + 1 ids: sorted within parts of a vector's rows first, then over the parts
    hashed = found.withColumn("h", F.xxhash64("v")).withColumn("slot", slot)
    ranked = hashed.select("vec_id", "h", "slot", "v", F.row_number().over(Window.partitionBy("h", "slot", "v").orderBy("vec_id")).alias("n")).filter(f"n <= {TOP + 1}")
    folded = ranked.groupBy("h", "v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, TOP + 1).alias("members"))
    # two vectors may share a hash, and two an id: the smaller vector of a hash keeps it, others go on from there
    again = F.row_number().over(Window.partitionBy("h").orderBy("v")) - 1
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    folded = materialize(folded.withColumn("node", F.xxhash64("h", again)).withColumn("norm", norm), "nodes")
    most = folded.agg(F.max("norm")).first()[0] or 1.0
    return folded.select("node", "v", F.transform("v", lambda x: (x / F.lit(most**0.5)).cast("float")).alias("x")), folded.select("node", "members")


def _offers(ids: np.ndarray, x: np.ndarray, there: np.ndarray, offers: int) -> pd.DataFrame:
    """For each of the nodes ids[g, m] that meet in gathering g, the nearest `offers` that it meets; s: minus the squared lifted distance."""
    n = (x * x).sum(axis=2)
    lift = np.sqrt(np.maximum(0.0, 1.0 - n))
    both = lift[:, :, None] + lift[:, None, :]
    # the difference of two lifts, from the difference of their squares
    gap = np.divide(n[:, :, None] - n[:, None, :], both, out=np.zeros_like(both), where=both > 0)
    s = 2 * (x @ x.transpose(0, 2, 1)) - n[:, :, None] - n[:, None, :] - gap * gap
    s[~(there[:, :, None] & there[:, None, :]) | np.eye(ids.shape[1], dtype=bool)] = -np.inf
    k = min(offers, ids.shape[1] - 1)
    if k < 1:
        return pd.DataFrame({"a": [], "b": [], "s": []})
    best = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
    near = np.take_along_axis(s, best, 2)
    kept = np.isfinite(near)
    a, b = np.broadcast_to(ids[:, :, None], near.shape), np.take_along_axis(np.broadcast_to(ids[:, None, :], s.shape), best, 2)
    return pd.DataFrame({"a": a[kept], "b": b[kept], "s": near[kept].astype(np.float32)})


def _rank(sorted_ids: np.ndarray) -> np.ndarray:
    """The place of each entry within its run of equal ids."""
    first = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]]) if len(sorted_ids) else np.zeros(0, np.int64)
    return np.arange(len(sorted_ids)) - np.repeat(first, np.diff(np.r_[first, len(sorted_ids)]))


def _merged(links: list[pd.DataFrame], n: int) -> pd.DataFrame:
    """The DEGREE nearest distinct b of each a, nearest first."""
    every = pd.concat(links, ignore_index=True).astype({"a": np.int64, "b": np.int64, "s": np.float32})
    every = every.iloc[np.unique((every["a"] * n + every["b"]).to_numpy(), return_index=True)[1]]
    every = every.iloc[np.lexsort((every["b"], -every["s"], every["a"]))]
    return every[_rank(every["a"].to_numpy()) < DEGREE].reset_index(drop=True)


def _leaves(x: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Groups of at most GROUP nodes: halves of halves along random directions."""
    todo = [np.arange(len(x))]
    while todo:
        group = todo.pop()
        if len(group) <= GROUP:
            yield group
            continue
        order = group[np.argsort(x[group] @ rng.normal(size=x.shape[1]), kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]


def _around(links: pd.DataFrame, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """ids[a, m] and there[a, m]: the nodes around each node; of those whose neighbour it is, DEGREE at random."""
    a, b = links["a"].to_numpy(), links["b"].to_numpy()
    order = np.lexsort((rng.random(len(b)), b))
    few = order[_rank(b[order]) < DEGREE]
    pairs = np.unique(np.r_[a * n + b, b[few] * n + a[few]])
    own, other = pairs // n, pairs % n
    place = _rank(own)
    ids, there = np.zeros((n, place.max(initial=0) + 1), np.int64), np.zeros((n, place.max(initial=0) + 1), bool)
    ids[own, place], there[own, place] = other, True
    return ids, there


def _descended(x: np.ndarray, rng: np.random.Generator) -> pd.DataFrame:
    """Links (a, b, s) among a shard's nodes, after NN-descent."""
    n = len(x)
    met = [_offers(g[None], x[g][None], np.ones((1, len(g)), bool), DEGREE // 2) for _ in range(PLANES) for g in _leaves(x, rng)]
    links = _merged(met, n)
    for _ in range(ROUNDS):
        ids, there = _around(links, n, rng)
        # an offer must be nearer than the farthest neighbour that a node has, once it has enough
        worst = np.full(n, -np.inf)
        full = links[_rank(links["a"].to_numpy()) == DEGREE - 1]
        worst[full["a"]] = full["s"]
        met = [links]
        for k in range(0, n, BATCH):
            found = _offers(ids[k : k + BATCH], x[ids[k : k + BATCH]], there[k : k + BATCH], OFFERS)
            met.append(found[found["s"].to_numpy() > worst[found["a"].to_numpy(np.int64)]])
        new = _merged(met, n)
        changed = np.count_nonzero(~np.isin(new["a"] * n + new["b"], links["a"] * n + links["b"]))
        links = new
        if changed <= ENOUGH * len(links):
            break
    return links


def _followed(links: pd.DataFrame, n: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The nodes that a search goes on to from each node: links both ways, and long links. A long vector that is nobody's neighbour on the lifted sphere
    is met by its own links only; of the links to a node the nearest of each of DEGREE random slots are followed back."""
    a, b, s = (links[c].to_numpy() for c in "abs")
    slot = rng.integers(0, DEGREE, len(a))
    order = np.lexsort((-s, slot, b))
    back = order[_rank((b * DEGREE + slot)[order]) == 0]
    ways = [a * n + b, b[back] * n + a[back]]
    for _ in range(RINGS):
        ring = rng.permutation(n)
        ways += [ring * n + np.roll(ring, 1), np.roll(ring, 1) * n + ring]
    pairs = np.unique(np.concatenate(ways))
    pairs = pairs[pairs // n != pairs % n]
    return np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))


def _indexed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """A shard's nodes in the order of their numbers, with the places in that order that a search goes on to."""
    group = group.sort_values("node", kind="stable")
    rng = np.random.default_rng([SEED, int(key[0])])
    x = np.stack(group["x"].to_numpy()).astype(np.float64)
    near = _followed(_descended(x, rng), len(x), rng)
    return pd.DataFrame({"shard": key[0], "node": group["node"], "v": group["v"], "near": [r.astype(np.int32) for r in near]})


def neighbour_graph(points: DataFrame) -> DataFrame:
    """(shard, node, v, near) of points (node, v, x): every shard with its graph. near: places among the shard's nodes in the order of their numbers."""
    n, width = points.count(), points.select(F.size("x")).first()
    most = min(SHARD, max(1, VALUES // width[0])) if width else SHARD
    shards = max(1, -(-n // min(most, max(LEAST, -(-n // SHARDS)))))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(shards)).cast("int"))
    made = dealt.repartition(4 * shards, "shard").groupBy("shard").applyInPandas(_indexed, "shard int, node long, v array<double>, near array<int>")
    return materialize(made, "graph")


def probes(asked: DataFrame, points: DataFrame, top: int) -> DataFrame:
    """(q, k, least): of PROBES queries (q, qv), how many nodes are among the `top` nearest of all nodes, and the least score of these."""
    chosen = asked.orderBy(F.xxhash64("q"), "q").limit(PROBES).collect()
    if not chosen:
        return asked.selectExpr("q", "1 AS k", "0D AS least")
    ids, x = np.array([r["q"] for r in chosen]), np.array([r["qv"] for r in chosen])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                s = x @ np.stack(batch["v"].to_numpy()).T
                s = -np.sort(-s, axis=1)[:, :top]
                yield pd.DataFrame({"q": np.repeat(ids, s.shape[1]), "s": s.ravel()})

    each = points.select("v").mapInPandas(best, "q long, s double")
    nearest_ = each.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).filter(f"n <= {top}")
    return materialize(nearest_.groupBy("q").agg(F.count(F.lit(1)).alias("k"), F.min("s").alias("least")), "probes")


def probed_recall(pool: DataFrame, limits: DataFrame) -> float:
    """The share of the probes' nearest nodes that their pools hold; scores are the same but for the order of their sums."""
    near = limits.join(pool, "q", "left").groupBy("q").agg(F.max("k").alias("k"), F.count_if(F.col("s") >= F.col("least") - 1e-9 * F.abs("least")).alias("hit"))
    share = near.agg(F.sum(F.least("hit", "k")).alias("hit"), F.sum("k").alias("k")).first()
    return share["hit"] / share["k"] if share["k"] else 1.0


def _explored(q: np.ndarray, x: np.ndarray, near: np.ndarray, first: np.ndarray, own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, node, score): the pools of queries q once their `size` best nodes are open. near[a]: nodes after a, filled up with -1;
    first: where all begin; own: each query's own node, or -1."""
    n, expand = len(x), max(1, EXPAND * size // POOL)
    seen = np.zeros(len(q) * n, bool)
    at, c, s, opened = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
    mine = np.flatnonzero(own >= 0)
    fresh = np.unique(np.r_[(np.arange(len(q))[:, None] * n + first).ravel(), mine * n + own[mine]])
    while len(fresh):  # the best only get better, and each round opens some, so it ends
        seen[fresh] = True
        more, node = fresh // n, fresh % n
        at, c, opened = np.r_[at, more], np.r_[c, node], np.r_[opened, np.zeros(len(fresh), bool)]
        s = np.r_[s, np.einsum("ij,ij->i", x[node], q[more])]
        fresh = fresh[:0]
        while not len(fresh):
            order = np.lexsort((-s, at))
            order = order[_rank(at[order]) < size]
            at, c, s, opened = at[order], c[order], s[order], opened[order]
            closed = np.flatnonzero(~opened)
            now = closed[_rank(at[closed]) < expand]
            if not len(now):
                break
            opened[now] = True
            to = near[c[now]]
            fresh = np.unique((at[now][:, None] * n + to)[to >= 0])
            fresh = fresh[~seen[fresh]]
    return at, c, s


def _searched(nodes_: pd.DataFrame, asked: pd.DataFrame, size: int, top: int) -> pd.DataFrame:
    """(q, c, s): the nodes of one shard that may be among the `top` nearest of the queries (q, qv)."""
    if not len(nodes_) or not len(asked):
        return pd.DataFrame({"q": [], "c": [], "s": []})
    nodes_ = nodes_.sort_values("node", kind="stable")
    ids, x, n = nodes_["node"].to_numpy(), np.stack(nodes_["v"].to_numpy()).astype(np.float64), len(nodes_)
    lists = nodes_["near"].to_numpy()
    near = np.full((n, max(1, max(len(r) for r in lists))), -1, np.int64)
    for k, r in enumerate(lists):
        near[k, : len(r)] = r
    longest = np.argsort(-np.einsum("ij,ij->i", x, x), kind="stable")[:LONGEST]
    first = np.unique(np.r_[np.random.default_rng(SEED).permutation(n)[:ENTRIES], longest])
    names, q = asked["q"].to_numpy(), np.stack(asked["qv"].to_numpy()).astype(np.float64)
    place = np.minimum(np.searchsorted(ids, names), n - 1)
    own = np.where(ids[place] == names, place, -1)
    # pools as large as the shard hold it whole, however many nodes a round opens
    at_once, out = max(1, min(64, PAIRS // (near.shape[1] * max(1, EXPAND * min(size, n) // POOL)))), []
    for k in range(0, len(q), at_once):
        at, c, s = _explored(q[k : k + at_once], x, near, first, own[k : k + at_once], min(size, n))
        # all that are level with the last of the `top`, but for the order of a sum
        last = np.full(len(q[k : k + at_once]), -np.inf)
        full = np.flatnonzero(_rank(at) == top - 1)
        last[at[full]] = s[full]
        kept = s >= last[at] - 1e-9 * np.abs(np.where(np.isfinite(last), last, 0))[at]
        out.append(pd.DataFrame({"q": names[k + at[kept]], "c": ids[c[kept]], "s": s[kept]}))
    return pd.concat(out, ignore_index=True)


def _pools(asked: DataFrame, index: DataFrame, n: int, shards: int, size: int, top: int) -> DataFrame:
    """(q, c, s) of n queries (q, qv) in all shards."""
    batches = max(1, -(-n // QUERIES))
    dealt = asked.select("q", "qv", F.pmod(F.xxhash64("q", F.lit(SEED)), F.lit(batches)).cast("int").alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = index.select("node", "v", "near", "shard", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    parts = 4 * shards * batches
    groups = [d.repartition(parts, "shard", "batch").groupBy("shard", "batch") for d in (held, dealt)]
    return groups[0].cogroup(groups[1]).applyInPandas(lambda a, b: _searched(a, b, size, top), "q long, c long, s double")


def search(queries: DataFrame, points: DataFrame, index: DataFrame, members: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (query_id, node, v) that are rows of the index themselves."""
    asked = materialize(queries.select(F.col("node").alias("q"), F.col("v").alias("qv")).dropDuplicates(["q"]), "asked")
    sizes = index.groupBy("shard").count().agg(F.max("shard").alias("last"), F.max("count").alias("most")).first()
    shards, most = (sizes["last"] or 0) + 1, sizes["most"] or 0
    limits = probes(asked, points, top + 1)
    probing = asked.join(F.broadcast(limits.select("q")), "q", "left_semi")
    size = POOL
    while size < most:
        found = probed_recall(_pools(probing, index, PROBES, shards, size, top + 1), limits)
        if found >= GOAL:
            break
        size *= 2 if found > 0.8 else 4
    near = materialize(_pools(asked, index, asked.count(), shards, size, top + 1), "pool")
    score = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    # of all shards' finds, those that can be among the nearest; their scores are summed in the order of the components
    order = Window.partitionBy("q").orderBy(F.desc("s"))
    last = F.coalesce(F.min(F.when(F.col("n") == top + 1, F.col("s"))).over(Window.partitionBy("q")), F.lit(float("-inf")))
    best = near.withColumn("n", F.row_number().over(order)).withColumn("last", last).filter("s >= last - 1e-9 * abs(last) OR n <= " + str(top + 1)).select("q", "c")
    pool = best.join(points.select(F.col("node").alias("c"), "v"), "c").join(asked, "q").select("q", "c", score.alias("s"))
    held = pool.join(members, F.col("c") == F.col("node")).select("q", "c", "s", "members", F.size("members").alias("k"))
    # members of nearer nodes; a node matters only where these are at most `top`, the query's own row included
    nearer = F.sum("k").over(Window.partitionBy("q").orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, 0)) - F.sum("k").over(Window.partitionBy("q", "s"))
    hits = held.withColumn("nearer", nearer).filter(F.col("nearer") <= top)
    ids = queries.select(F.col("node").alias("q"), "query_id")
    each = ids.join(hits, "q").withColumn("own", F.when(F.col("q") == F.col("c"), F.array_position("members", F.col("query_id"))).otherwise(0))
    found = each.select("query_id", "s", "own", F.posexplode("members").alias("at", "vec_id")).filter("at + 1 <> own")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", F.col("s").alias("score")).filter(f"rank <= {top}")


def nearest(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by `every`, the TOP nearest other rows."""
    found = materialize(vectors(rows, vec_id, embedding), "vectors")
    points, members = nodes(found)
    points = materialize(points, "points")
    graph = neighbour_graph(points)
    asked = found.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = asked.join(points.select("node", "v"), "v").select("query_id", "node", "v")
    return search(asked, points, graph, members)


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
