"""Operator 2, embedding near-dedup with randomised-rotation binary codes.

A unit vector is rotated at random; its code is the signs, and its correction factor the inner product
of the vector with its own code. A code's inner product with another rotated vector, divided by the
factor, is an unbiased estimate of the vectors' inner product, with a bound on its error. Pairs whose
estimate plus the bound reaches the threshold are computed again exactly, in double precision.

Search: vectors of one label meet where ``width`` successive signs agree, in as many tables as make it
sure (up to MISS) that a pair at the threshold meets. ``width`` grows with the logarithm of the rows.

Scale: equal vectors are folded first; buckets are the keys of one shuffle, those that are too long for
one block are split into pairs of blocks; a pair counts only in the first table where it meets, so
links are counted without being written.

Defined cases: vectors that are null, empty, zero or hold null or non-finite parts link with nothing,
nor do those of a null label or of another length; repeated rows link to each other; no rows give no rows.
"""

from __future__ import annotations

from functools import lru_cache
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, links

COSINE = 0.98
MISS = 1e-5  # chance that a pair at the threshold meets in no table
BUCKET = 128  # wanted rows of a label's bucket, were there some ten labels
SURE = 5.0  # of the error bound, in standard deviations


@lru_cache
def rotation(size: int, number: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([2, size, number]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def plan(rows: int, cosine: float) -> tuple[int, int]:
    """Signs of a key, and tables."""
    width = int(min(40, max(3, round(log2(max(rows, 2) / 10 / BUCKET) + 4))))
    agree = (1 - acos(min(1.0, cosine)) / pi) ** width
    return width, ceil(log(MISS) / log(1 - agree)) if agree < 1 else 1


def rotated(unit: np.ndarray, signs: int) -> np.ndarray:
    """At least ``signs`` coordinates of each vector under successive rotations."""
    size = unit.shape[1]
    return np.concatenate([unit @ rotation(size, k) for k in range(-(-signs // size))], axis=1)


def keys(unit: np.ndarray, width: int, tables: int) -> np.ndarray:
    bits = rotated(unit, width * tables)[:, : width * tables] > 0
    return bits.reshape(len(unit), tables, width) @ (1 << np.arange(width))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _by_size(table, column: str = "embedding"):
    """Rows of each length of vector, as (rows, matrix)."""
    own = table.column(column)
    sizes = pc.list_value_length(own).to_numpy(zero_copy_only=False) if not isinstance(own, pa.ChunkedArray) else pc.list_value_length(own).to_numpy()
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        yield own, _matrix(table.column(column).take(pa.array(own)), size)


def near_pairs(x: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Whether each pair (a, b) of rows of x reaches the cosine: estimated from codes, near ones exactly."""
    size = x.shape[1]
    norm = np.sqrt((x * x).sum(axis=1))
    turned = (x / norm[:, None]) @ rotation(size, 1000)
    code = np.where(turned > 0, 1.0, -1.0) / np.sqrt(size)
    factor = (code * turned).sum(axis=1)
    out = np.zeros(len(a), bool)
    for s in range(0, len(a), 1 << 14):
        i, j = a[s : s + (1 << 14)], b[s : s + (1 << 14)]
        estimate = (code[i] * turned[j]).sum(axis=1) / factor[i]
        bound = np.sqrt(np.maximum(1 - factor[i] ** 2, 0)) / factor[i] * SURE / np.sqrt(max(size - 1, 1))
        ask = np.flatnonzero(estimate + bound >= cosine)
        u, v = x[i[ask]], x[j[ask]]
        out[s + ask] = (u * v).sum(axis=1) / (norm[i[ask]] * norm[j[ask]]) >= cosine
    return out


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    sound = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    marked = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = common.durable(marked.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies")))
    width, tables = plan(classes.count(), cosine)
    label_type, vector_type = (embeddings.schema[c].dataType.simpleString() for c in ("label", "embedding"))

    def spread(batches):
        for batch in batches:
            for own, x in _by_size(batch):
                key = keys(x / np.sqrt((x * x).sum(axis=1))[:, None], width, tables)
                part = batch.take(pa.array(own))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int64)), pa.array(np.full(len(own), x.shape[1], np.int64)), pa.array(key[:, t]), *part.columns], ["place", "size", "key", *batch.schema.names])

    spreaded = classes.mapInArrow(spread, f"place long, size long, key long, label {label_type}, embedding {vector_type}, class_id long, copies long")
    bucket = F.xxhash64("place", "size", "key", "label")

    def compare(batches):
        for table, starts in links.groups(batches, ["bucket", "bi", "bj"], 1 << 12):
            ids, copies, side, place = (table.column(c).to_numpy() for c in ("class_id", "copies", "own", "place"))
            label = table.column("label").to_pandas().to_numpy()
            cross = (table.column("bi").to_numpy() != table.column("bj").to_numpy())[starts[:-1]]
            parts = list(_by_size(table))
            where, which = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for k, (own, x) in enumerate(parts):
                where[own], which[own] = np.arange(len(own)), k
            meet = [keys(x / np.sqrt((x * x).sum(axis=1))[:, None], width, tables) for _, x in parts]
            found = []
            for a, b in links.pairs(starts, side, cross):
                for k, (own, x) in enumerate(parts):
                    mine = (which[a] == k) & (which[b] == k) & (label[a] == label[b])
                    u, v = a[mine], b[mine]
                    near = near_pairs(x, where[u], where[v], cosine)
                    u, v = u[near], v[near]
                    first = np.argmax(meet[k][where[u]] == meet[k][where[v]], axis=1) if len(u) else u
                    found.append((u[first == place[u]], v[first == place[u]]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                if len(a):
                    degree = np.zeros(len(ids), np.int64)
                    np.add.at(degree, a, copies[b])
                    np.add.at(degree, b, copies[a])
                    node, root = links.forest(ids[a], ids[b])
                    linked = np.flatnonzero(degree)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(root[np.searchsorted(node, ids[linked])]), pa.array(degree[linked])], ["class_id", "root", "degree"])

    filed = spreaded.withColumn("bucket", bucket)
    met = links.in_blocks(filed, filed.groupBy("bucket").agg(F.count("*").alias("bucket_n")), ["bucket"], "class_id", 1024)
    found = met.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj").mapInArrow(compare, "class_id long, root long, degree long")
    found = common.durable(found.groupBy("class_id", "root").agg(F.sum("degree").alias("degree")))
    component = links.components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("class_id").agg(F.sum("degree").alias("degree"))
    whole = classes.join(degree, "class_id", "left").join(component.withColumnRenamed("node", "class_id"), "class_id", "left")
    whole = whole.select(F.col("label").alias("class_label"), F.col("embedding").alias("class_embedding"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    linked = marked.where("sound").join(whole, (F.col("label") == F.col("class_label")) & (F.col("embedding") == F.col("class_embedding"))).select("vec_id", "n_links", "component_id")
    alone = marked.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


OP2_SQL = """
with recursive sound as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), n as (
  select *, sqrt(list_dot_product(e, e)) as norm from sound
), link as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach as (
  select vec_id as v, vec_id as r from embeddings
  union
  select reach.v, link.b from reach join link on link.a = reach.r
)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e left join (select a, count(*) as n from link group by a) d on d.a = e.vec_id
join (select v, min(r) as component_id from reach group by v) c on c.v = e.vec_id
"""
