"""Mixing sources to target weights by cube-method balanced sampling.

Targets. Sources in code-point order, null last, weigh 3, 1, 2, repeating. They share 150 % of all sizes by weight; a
target stops at MOST_TIMES times its source's size and the excess is shared again by weight, until none is above.

Method. A document of a source with rate r = target / source size is taken floor(r) times for certain and once
more with inclusion probability r - floor(r). Which documents these are is chosen by the cube method: the vector of
probabilities moves through the null space of the balancing constraints (total tokens, total documents), so both
totals stay what they are, until each move has fixed one document at 0 or 1. Documents are dealt to blocks of
a source by a hash of their ids; each block runs its flight in one pass and leaves at most two documents undecided.
The undecided of all blocks meet again in larger blocks, and so on, until one block per source is left; its last
documents are the landing problem: they are rounded one by one, and single documents of that block change places, so that taken words come
nearest to the target.

Scale. The text is read once for its size; everything else works on (source, id, size). A block holds at most about
BLOCK documents whatever its source's share; each round leaves 2 in BLOCK of them. Sources are never collected.

Reruns agree: all draws are hashes of ids. Defined results: null, empty and blank texts have size 0 and are never
taken. A null doc_id is mixed like any other value. Rows that repeat an id are units of their own, told apart by
size alone; equal ones share their draws' hash, and which of them is taken makes no difference. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2
BLOCK = 4_096
SEED = 42


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", more: Sequence[Column] = ()) -> DataFrame:
    return docs.select(*more, F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def ranked_sources(units: DataFrame) -> DataFrame:
    """(source, source_size, weight): ranks come from a range partitioning, so no single task orders all sources."""
    totals = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = materialize(totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each partition
    first, before = {}, 0
    for p in sorted(counts):
        first[p], before = before, before + counts[p]
    offsets = F.create_map(*[F.lit(int(x)) for kv in first.items() for x in kv]) if first else F.create_map(F.lit(0), F.lit(0))
    rank = F.element_at(offsets, part.cast("int")) + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int")).alias("weight"))


def targets(units: DataFrame, share: float = SHARE, most_times: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target). Each round stops the sources that are above their limit and shares what is left among the others."""
    sources = materialize(ranked_sources(units), "ranked")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    # a source stops at a limit: its target is limit exactly once size * most_times <= weight * level
    level, stopped = 0.0, None
    while True:
        cut = F.lit(False) if stopped is None else F.col("source_size") * most_times < F.col("weight") * F.lit(level)
        row = sources.select(cut.alias("c"), "source_size", "weight").agg(F.sum(F.when(F.col("c"), F.col("source_size") * most_times)), F.sum(F.when(~F.col("c"), F.col("weight"))), F.count_if("c")).first()
        left, weight, n = share * total - (row[0] or 0), row[1] or 0, row[2]
        if n == stopped or not weight:
            break
        level, stopped = left / weight, n
    limit = (F.col("source_size") * most_times).cast("double")
    return sources.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(float(level))).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Moves p, document by document, until at most two entries lie strictly between 0 and 1.

    Three undecided documents and two constraints leave one direction in which neither the expected tokens nor the
    expected documents change. The step goes to the first wall on either side, each with the probability that keeps
    the expectation; at least one document is decided by each step.
    """
    p, eps = p.astype(np.float64).copy(), 1e-9
    live: list[int] = []
    q, s, d = p.tolist(), size.astype(float).tolist(), draw.tolist()
    for i in range(len(q)):
        if q[i] <= eps or q[i] >= 1 - eps:
            q[i] = float(round(q[i]))
            continue
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])  # sums to 0, and so does u * size
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)  # equal sizes: any exchange keeps both totals
        up = down = float("inf")
        for k, v in zip(live, u):
            if v > 0:
                up, down = min(up, (1 - q[k]) / v), min(down, q[k] / v)
            elif v < 0:
                up, down = min(up, -q[k] / v), min(down, -(1 - q[k]) / v)
        step = up if d[i] * (up + down) < down else -down
        for k, v in zip(live, u):
            q[k] += step * v
        rest = []
        for k in live:
            if q[k] <= eps or q[k] >= 1 - eps:
                q[k] = float(q[k] > 0.5)
            else:
                rest.append(k)
        live = rest[:2]
    return np.array(q)


def landing(p: np.ndarray, size: np.ndarray, draw: np.ndarray, gap: float) -> np.ndarray:
    """Decides what the last flight of a source left, so that the words come nearest to the target.

    gap: words that are still missing if all undecided documents were left out. These are decided largest first. What is missing or too much
    then is made good without the number of documents changing: a document that is taken and one that is not change places, the pair that
    fits best, as long as that helps.
    """
    out = p.copy()
    undecided = np.flatnonzero((p > 0) & (p < 1))
    for i in undecided[np.lexsort((draw[undecided], -size[undecided]))]:
        out[i] = float(abs(gap - size[i]) < abs(gap))
        gap -= out[i] * size[i]
    while gap:
        taken, free = (np.flatnonzero(out == x) for x in (1.0, 0.0))
        if not len(taken) or not len(free):
            break
        free = free[np.lexsort((draw[free], size[free]))]
        wanted = size[taken] + gap
        place = np.searchsorted(size[free], wanted)
        sides = np.stack([np.maximum(place - 1, 0), np.minimum(place, len(free) - 1)])
        miss = np.abs(size[free][sides] - wanted)
        side, best = np.unravel_index(miss.argmin(), miss.shape)
        if miss[side, best] >= abs(gap):
            break
        out[taken[best]], out[free[sides[side, best]]] = 0.0, 1.0
        gap -= size[free[sides[side, best]]] - size[taken[best]]
    return out


def _flights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by source and block; each block flies when its last row has come. A block is never over a few times BLOCK rows."""
    held: list[pa.Table] = []

    def fly(rows: pa.Table) -> pa.Table:
        p, size, draw = (np.asarray(rows.column(n).combine_chunks()) for n in ("p", "size", "draw"))
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(flight(p, size, draw)))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column("block"))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            piece = pa.Table.from_batches([batch.slice(a, b - a)])
            if held and held[0].column("block")[0].as_py() != int(keys[a]):
                yield from fly(pa.concat_tables(held)).to_batches()
                held = []
            held.append(piece)
    if held:
        yield from fly(pa.concat_tables(held)).to_batches()


def _land(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            p, size, draw = (np.array([u[n] for u in row["units"]], float) for n in ("p", "size", "draw"))
            order = np.lexsort((draw, -size))  # the smallest stay undecided longest
            p, size, draw = p[order], size[order], draw[order]
            flown = flight(p, size, draw)
            # words that these units should bring in expectation, less what the flight has already taken
            last = landing(flown, size, draw, float((p * size).sum() - size[flown == 1.0].sum()))
            done += [{"key": row["units"][k]["key"], "p": float(x)} for k, x in zip(order, last)]
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("key", pa.int64()), ("p", pa.float64())]))


SCHEMA = "key long, source string, size long, draw double, n long, block long, p double"


def choose(units: DataFrame) -> DataFrame:
    """(key, p in {0, 1}) for units (key, source, size, draw, p): the cube method over each source."""
    decided, left = [], units
    while True:
        # blocks: as many of each source as it has undecided units for
        n = left.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        most = n.agg(F.max("n")).first()[0] or 0
        if most <= BLOCK // 8:
            break
        dealt = left.join(n.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("block", F.xxhash64("source", F.floor(F.col("draw") * F.ceil(F.col("n") / BLOCK))))
        flown = dealt.select("key", "source", "size", "draw", "n", "block", "p").repartition("block").sortWithinPartitions("block", "draw", "size", "key").mapInArrow(_flights, SCHEMA)
        flown = materialize(flown.select("key", "source", "size", "draw", "p"), "flight")
        decided.append(flown.filter("p <= 0 OR p >= 1").select("key", "p"))
        # fresh draws, so that units that sat together part
        left = flown.filter("p > 0 AND p < 1").withColumn("draw", _draw(F.col("draw"), F.lit(len(decided))))
    last = left.groupBy("source").agg(F.collect_list(F.struct("key", "size", "draw", "p")).alias("units")).mapInArrow(_land, "key long, p double")
    for d in decided:
        last = last.union(d)
    return last


def _draw(*of: Column) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *of), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) for every row of docs."""
    return _mix(materialize(sizes(docs, doc_id, text, source).withColumn("key", F.monotonically_increasing_id()), "sizes")).drop("key")


def _mix(units: DataFrame) -> DataFrame:
    """The mix of materialized units (key, doc_id, source, size), one row for each key."""
    goal = targets(units).withColumnRenamed("source", "_source")
    rated = units.join(goal, units["source"].eqNullSafe(goal["_source"])).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = materialize(rated.withColumn("sure", F.floor(rate)).withColumn("p", rate - F.floor(rate)), "rated")
    open_units = rated.filter("size > 0 AND p > 0").select("key", "source", "size", _draw(F.col("doc_id"), F.col("size")).alias("draw"), "p")
    chosen = choose(open_units).withColumnRenamed("p", "more").withColumnRenamed("key", "_key")
    out = rated.join(chosen, rated["key"] == chosen["_key"], "left")
    times = F.when(F.col("size") > 0, F.col("sure") + F.coalesce("more", F.lit(0.0))).otherwise(0).cast("long")
    return out.withColumn("times", times).select("key", "doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; rows of size 0 are not in a mix.

    Decisions meet their rows by a key of the row, so that rows without an id and rows that repeat one have their own.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("key"))
    keyed = materialize(held, "keyed")
    units = materialize(sizes(keyed, "row.doc_id", "row.text", "row.source", more=[F.col("key")]), "sizes")
    times = _mix(units).filter("times > 0").select("key", F.col("times").cast("int").alias("times"))
    taken = keyed.join(times, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
