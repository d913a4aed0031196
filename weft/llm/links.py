"""Links found block by block: splitting hot buckets, streaming groups, local forests, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

BLOCK = 2048  # rows of a bucket that meet in one block
SENT = 1 << 17  # large buckets that may go to every task: some MB


def in_blocks(rows: DataFrame, sizes: DataFrame, bucket: list[str], identity: str, block: int = BLOCK) -> DataFrame:
    """Rows with the pair of blocks (bi <= bj, own) in which they meet the rows of their bucket.

    sizes: rows of each bucket (bucket_n). A bucket of up to ``block`` rows is one block. A larger one is cut
    into blocks by a hash, and each pair of blocks is a group of its own, so no bucket has to fit into one
    task. The large buckets go to every task where there are at most SENT of them; more are joined.
    """
    large = durable(sizes.where(F.col("bucket_n") > block))
    n = large.count()
    zero = F.lit(0)
    if not n:
        return rows.select("*", zero.alias("bi"), zero.alias("bj"), zero.alias("own"))
    sized = rows.join(F.broadcast(large) if n <= SENT else large, bucket, "left")
    sized = sized.withColumn("blocks", F.ceil(F.coalesce("bucket_n", F.lit(1)) / block).cast("int")).withColumn("own", F.pmod(F.xxhash64(identity), F.col("blocks")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(F.col("own"), other).alias("bi"), F.greatest(F.col("own"), other).alias("bj")))
    return sized.withColumn("met", F.explode(met)).select(*[c for c in rows.columns], F.col("met.bi").alias("bi"), F.col("met.bj").alias("bj"), "own")


def groups(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 1 << 14) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a sorted stream, several at a time, with the starts of the groups (and the end)."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(table: pa.Table, last: bool):
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in key:
            x = table.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = np.append(np.flatnonzero(new), table.num_rows)
        return starts if last else starts[:-1]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = cut(table, False)
            if starts[-1]:
                yield table.slice(0, starts[-1]), starts
            rest = table.slice(starts[-1])
            held, n = rest.to_batches(), 0  # look again when as many rows more have come
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table, cut(table, True)


def pairs(starts: np.ndarray, sides: np.ndarray, cross: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs to compare within the groups: all of a group, or, where cross, those of different sides."""
    size = np.diff(starts)
    first = np.arange(starts[-1])
    group = np.repeat(np.arange(len(size)), size)
    left = starts[1:][group] - first - 1  # rows of its group after each
    done = 0
    upto = np.append(0, np.cumsum(left))
    while done < len(first):
        end = max(done + 1, int(np.searchsorted(upto, upto[done] + most, "right")) - 1)
        k = left[done:end]
        a = np.repeat(first[done:end], k)
        b = a + 1 + np.arange(len(a)) - np.repeat(upto[done:end] - upto[done], k)
        apart = ~cross[group[a]] | (sides[a] != sides[b])
        if not apart.all():
            a, b = a[apart], b[apart]
        if len(a):
            yield a, b
        done = end


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of the links a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the least node of its component, for the nodes of ``edges`` (a, b).

    Each round hooks every node to its least neighbour, follows the hooks to their ends by doubling, and
    contracts; edges that fall together go. A path of n nodes takes some log n joins, whatever its order.
    """
    left = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    label = None
    while True:
        # either end knows the other; the least of a node's neighbours and itself
        hook = left.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(left.select(F.col("b"), F.col("a"))).groupBy("node").agg(F.least("node", F.min("to")).alias("to"))
        hook = durable(hook)
        while True:
            further = hook.join(hook.select(F.col("node").alias("to"), F.col("to").alias("end")), "to")
            if further.where(F.col("end") != F.col("to")).isEmpty():
                break
            hook = durable(further.select("node", F.col("end").alias("to")))
        if label is None:
            label = hook.select("node", F.col("to").alias("component"))
        else:
            label = durable(label.join(hook.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        up = left.join(hook.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a").join(hook.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b")
        left = durable(up.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
        if left.isEmpty():
            return label
