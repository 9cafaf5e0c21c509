"""Mini-batches of large districts, sampled by joins over the whole cluster.

Nodes of a district above a size are dealt to batches, and frontier joins keyed by batch
take their sampled in-edges, all batches of an epoch at once.  No task holds a district:
a batch is a group of its own, of at most its seeds times the product of the fan-outs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators import spatial
from terrafold.plans.lineage import cut

BATCH = ["district_id", "batch"]
#: The modulus of the arithmetic keys, and what an epoch adds to their factor.
PRIME, STRIDE = 1_000_003, 104_729


def factor(number: int) -> int:
    """The factor of epoch ``number``: another one each epoch, so that other nodes and edges meet."""
    return (7919 + STRIDE * number) % (PRIME - 1) + 1


def _key(column: str, number: int, seed: int) -> Column:
    return F.pmod(F.col(column), F.lit(PRIME)) * factor(number) + seed


def dealt(nodes: DataFrame, plan: DataFrame, seed: int = 42, number: int = 0) -> DataFrame:
    """(district_id, batch, building_id): the seeds of each batch.  ``plan`` has
    district_id and n_batches; a node's batch comes from an arithmetic key, so batches
    have about the same size and no district is put in order."""
    place = F.pmod(F.pmod(_key("building_id", number, seed), F.lit(PRIME)), F.col("n_batches"))
    return nodes.select("district_id", "building_id").join(plan.select("district_id", "n_batches"), "district_id").select("district_id", place.alias("batch"), "building_id")


#: Edges that a task gathers before it leaves only the foremost of them.
GATHERED = 1_000_000


def foremost(edges: DataFrame, most: int, seed: int = 42, number: int = 0, gathered: int = GATHERED) -> DataFrame:
    """Edges without loops, of which each task leaves out what can't be among the ``most``
    in-edges of a node: so few are put in order that any number of edges may come."""

    def first(d: np.ndarray, src: np.ndarray, dst: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, ...]:
        key = (src % PRIME * factor(number) + seed + dst % PRIME * STRIDE) % PRIME
        order = np.lexsort((src, key, dst, d))
        d, src, dst, distance = d[order], src[order], dst[order], distance[order]
        start = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (dst[1:] != dst[:-1])])
        place = np.arange(len(d)) - np.repeat(start, np.diff(np.r_[start, len(d)]))
        return tuple(v[place < most] for v in (d, src, dst, distance))

    names = ("district_id", "src", "dst", "distance")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, limit = [], 0, gathered
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch[c].to_numpy(zero_copy_only=False) for c in names))
            n += batch.num_rows
            if n >= limit:
                held = [first(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                limit = n + gathered
                if n > gathered:  # nodes enough for a task: these go on
                    yield pa.RecordBatch.from_pydict(dict(zip(names, held[0], strict=True)))
                    held, n, limit = [], 0, gathered
        if n:
            yield pa.RecordBatch.from_pydict(dict(zip(names, first(*map(np.concatenate, zip(*held, strict=True))), strict=True)))

    return edges.where((F.col("src") != F.col("dst")) & F.col("district_id").isNotNull()).select(*names).mapInArrow(run, "district_id long, src long, dst long, distance double")


def ranked(edges: DataFrame, most: int, seed: int = 42, number: int = 0) -> DataFrame:
    """(district_id, src, dst, distance, place): at most ``most`` in-edges of each node, in
    the order of an arithmetic key.  The limit is known before the exchange, so that a
    node with any number of in-edges sends only so many from each task."""
    key = F.pmod(_key("src", number, seed) + F.pmod(F.col("dst"), F.lit(PRIME)) * STRIDE, F.lit(PRIME))
    place = F.row_number().over(Window.partitionBy("district_id", "dst").orderBy(key, "src"))
    return foremost(edges, most, seed, number).select("district_id", "src", "dst", "distance", place.alias("place")).where(F.col("place") <= most)


def sampled(nodes: DataFrame, edges: DataFrame, plan: DataFrame, fan_out: tuple[int, ...] = (15, 10), seed: int = 42, number: int = 0) -> tuple[DataFrame, DataFrame]:
    """Members (district_id, batch, building_id, is_seed) and links (district_id, batch,
    src, dst, distance) of the batches of epoch ``number``.  Each hop takes at most so many
    in-edges of each node that the hop before reached; an edge met twice stays once.
    A node without edges is a member of its batch; districts that ``plan`` lacks give no rows."""
    own = cut(dealt(nodes, plan, seed, number))
    kept = cut(ranked(edges.join(plan.select("district_id"), "district_id", "left_semi"), max(fan_out, default=0), seed, number))
    frontier, taken = own, kept.select("district_id", F.lit(0).cast("long").alias("batch"), "src", "dst", "distance").limit(0)
    for limit in fan_out:
        reached = frontier.withColumnRenamed("building_id", "dst").join(kept.where(F.col("place") <= limit), ["district_id", "dst"])
        hop = cut(reached.select(*BATCH, "src", "dst", "distance"))
        taken = taken.unionByName(hop)
        frontier = hop.select(*BATCH, F.col("src").alias("building_id")).distinct()
    links = taken.groupBy(*BATCH, "src", "dst").agg(F.min("distance").alias("distance"))
    ends = taken.select(*BATCH, F.explode(F.array("src", "dst")).alias("building_id"), F.lit(False).alias("is_seed"))
    members = own.withColumn("is_seed", F.lit(True)).unionByName(ends).groupBy(*BATCH, "building_id").agg(F.max("is_seed").alias("is_seed"))
    return members, links


def numbered_batches(plan: DataFrame) -> DataFrame:
    """(district_id, batch, step): every batch of a plan, numbered from 0."""
    every = plan.select("district_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_batches") - 1)).alias("batch"))
    return spatial.numbered(every.withColumn("_key", F.struct(*BATCH)), "_key", "step").drop("_key")


def stepped(nodes: DataFrame, edges: DataFrame, plan: DataFrame, steps: DataFrame, fan_out: tuple[int, ...], seed: int, number: int) -> DataFrame:
    """The batches of an epoch, a row each (step, district_id, members, links), with the
    columns of their nodes; a step has a folder of its own, so that reading it takes one
    task and no exchange."""
    members, links = sampled(nodes, edges, plan, fan_out, seed, number)
    pack = lambda rows, name, columns: rows.groupBy(*BATCH).agg(F.collect_list(F.struct(*columns)).alias(name))
    own = pack(members.join(nodes.hint("merge"), ["district_id", "building_id"]), "members", ["building_id", "is_seed", "y", "features"])
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = own.join(pack(links, "links", ["src", "dst", "distance"]).hint("merge"), BATCH, "left").join(steps.hint("merge"), BATCH)
    return cut(both.where(F.exists("members", lambda m: m["is_seed"])).select("step", "district_id", "members", "links").repartition(n, "step"), by="step")
