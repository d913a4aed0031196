"""Operator 10, quality classifier: importance resampling with hashed n-gram generative models.

Two bag-of-n-grams models over one hashed feature space, of the target text (documents labelled good
and not toxic) and of the raw text (every document), give each passage the log of its density ratio.
A document weighs what its worst passage weighs, so a long clean document can't pay for one bad
sentence. Gumbel top-k then samples documents without replacement in proportion to their weight.

Scale: the counts of all documents travel as compressed blocks of a table of fixed size, one table a
task, and are summed as a stream by a tree of tasks; scoring is a map. No text is shuffled and nothing unbounded reaches
the driver: it holds the table (2 ** BITS buckets), at most ``label_bound`` labels and histograms.

Defined cases: a null or empty text, or one shorter than an n-gram, weighs 0 (no evidence against it)
and is kept; equal texts weigh the same; exactly k rows are kept, where there are as many: rows tied in key
and id (repeated rows, null ids) go in any order, as they are equal; a null id has no label; no documents give no rows; without usable labels everything weighs 0 and all is kept; contradicting labels of a document
count as bad; columns other than ``doc_id`` and ``text`` are passed over, or through, untouched.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

N = 5  # bytes of an n-gram
BITS = 20  # log2 of the buckets
BLOCK = 1 << 12  # buckets that travel together
FAN = 64  # tables that one task adds up
WINDOW = 32  # n-grams of a passage
UNIT = 1024  # weights are whole multiples of 1 / UNIT nat, so that sums don't depend on their order
LABEL_BOUND = 1 << 16  # labelled documents that the target model and the cut are fitted on, at most
SHARPNESS = 8.0  # factor on log weights before the Gumbel noise is added; 1 is plain resampling
BINS = 4096
NO_ID = -(2**63)  # stands for a null doc_id


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and whether it lies within one text."""
    low, m = common.LOWER[data], len(data)
    key = np.zeros(m, np.uint64)
    for j in range(N):
        key[: m - j] |= low[j:].astype(np.uint64) << np.uint64(8 * j)
    whole = np.ones(m, bool)
    for j in range(1, N):
        at = offsets[1:] - j
        whole[at[at >= offsets[:-1]]] = False
    return (common.mix(key) >> np.uint64(64 - BITS)).astype(np.int64), whole


def score(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Weight of the worst passage of each text, in units; table: units by bucket."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b in common.spans(offsets):
        at = offsets[a : b + 1]
        part, at = data[at[0] : at[-1]], at - at[0]
        if not len(part):
            continue
        bucket, whole = grams(part, at)
        total = np.zeros(len(part) + 1, np.int64)
        np.cumsum(table[bucket] * whole, out=total[1:])
        stop = np.arange(WINDOW, len(part) + WINDOW)
        np.minimum(stop, np.repeat(at[1:], np.diff(at)), out=stop)
        passage = total[stop] - total[:-1]
        full = np.flatnonzero(np.diff(at) > 0)
        out[a + full] = np.minimum.reduceat(passage, at[full])
    return out


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    h = common.mix(common.mix(ids.astype(np.int64).view(np.uint64)) + np.uint64(seed))
    return -np.log(-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53))


@dataclass
class Model:
    """The table of units, the cut on weights, and what the last of the top k has: key and id, and how many of
    the rows that have both equal belong to the top (-1: all)."""

    table: np.ndarray
    cut: float
    key: float
    last_id: int
    k: int
    seed: int
    ties: int = -1

    def keys(self, ids: np.ndarray, units: np.ndarray) -> np.ndarray:
        return units / UNIT * SHARPNESS + gumbel(ids, self.seed)

    def kept(self, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rows of the top, and those tied with its last."""
        return (keys > self.key) | ((keys == self.key) & (ids <= self.last_id))

    def tied(self, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return (keys == self.key) & (ids == self.last_id)


def _labelled(labels: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``bound`` labelled ids, chosen by hash, sorted; and which of them are target."""
    one = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.min("quality") > 0).alias("fine"), (F.max(F.coalesce("toxic", F.lit(0))) > 0).alias("toxic"))
        .select("doc_id", (F.col("fine") & ~F.col("toxic")).alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
        .toPandas()
        .sort_values("doc_id")
    )
    return one["doc_id"].to_numpy(np.int64), one["good"].to_numpy(bool)


def _is_in(sorted_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if not len(sorted_ids):
        return np.zeros(len(ids), bool)
    at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
    return sorted_ids[at] == ids


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _counts(documents: DataFrame, target_ids: np.ndarray) -> np.ndarray:
    """Counts by bucket: of all documents, and of the target documents."""

    def count(batches):
        total = None
        for batch in batches:
            data, offsets = common.utf8(batch.column("text"))
            target = _is_in(target_ids, _ids(batch))
            if total is None:
                total = np.zeros((2, 1 << BITS), np.int64)
            for a, b in common.spans(offsets):
                at = offsets[a : b + 1]
                bucket, whole = grams(data[at[0] : at[-1]], at - at[0])
                total[0] += np.bincount(bucket[whole], minlength=1 << BITS)
                if target[a:b].any():
                    total[1] += np.bincount(bucket[whole & np.repeat(target[a:b], np.diff(at))], minlength=1 << BITS)
        if total is not None:
            parts = total.reshape(2, -1, BLOCK)
            packed = [zlib.compress(np.ascontiguousarray(parts[:, k]).tobytes(), 1) for k in range(parts.shape[1])]
            from pyspark import TaskContext

            own = np.full(len(packed), TaskContext.get().partitionId() // FAN, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(packed)), pa.int64()), pa.array(own), pa.array(packed, pa.binary())], ["block", "part", "counts"])

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, part, packed in zip(*(batch.column(c).to_pylist() for c in range(3))):
                own = np.frombuffer(zlib.decompress(packed), np.int64)
                sums[k, part] = sums[k, part] + own if (k, part) in sums else own
        if sums:
            packed = [zlib.compress(x.tobytes(), 1) for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int64()), pa.array([p // FAN for _, p in sums], pa.int64()), pa.array(packed, pa.binary())], ["block", "part", "counts"])

    schema = "block long, part long, counts binary"
    read = documents.select("doc_id", "text")
    sums, tasks = read.mapInArrow(count, schema), read.rdd.getNumPartitions()
    while tasks > 1:  # a tree: each task adds the tables of up to FAN others
        tasks = -(-tasks // FAN)
        sums = sums.repartition(min(tasks * 16, 4096), "block", "part").mapInArrow(add, schema)
    blocks = sums.collect()
    total = np.zeros((2, (1 << BITS) // BLOCK, BLOCK), np.int64)
    for row in blocks:
        total[:, row["block"]] += np.frombuffer(zlib.decompress(row["counts"]), np.int64).reshape(2, BLOCK)
    return total.reshape(2, -1)


def _weights(documents: DataFrame, table: np.ndarray) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(table)  # 2 ** BITS numbers whatever the input

    def weigh(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score(shared.value, data, offsets))], ["doc_id", "units"])

    return documents.select("doc_id", "text").mapInArrow(weigh, "doc_id long, units long")


def _cut(weights: DataFrame, ids: np.ndarray, good: np.ndarray) -> float:
    """The weight that parts labelled good from bad best (balanced), in the middle of its plateau."""
    if not good.any() or good.all():
        return -np.inf

    def only(batches):
        for batch in batches:
            own = _ids(batch)
            yield batch.append_column("at", pa.array(np.searchsorted(ids, own))).filter(pa.array(_is_in(ids, own)))

    # one a label, so bounded: documents that share an id speak by the least weight
    rows = weights.mapInArrow(only, "doc_id long, units long, at long").groupBy("at").agg(F.min("units").alias("units")).toPandas()
    is_good = good[rows["at"].to_numpy(np.int64)]
    units = rows["units"].to_numpy(np.int64)
    if not is_good.any() or is_good.all():
        return -np.inf
    values = np.unique(units)
    lost = np.searchsorted(np.sort(units[is_good]), values, "left") / is_good.sum()
    caught = np.searchsorted(np.sort(units[~is_good]), values, "left") / (~is_good).sum()
    gain = caught - lost
    best = int(np.argmax(gain))
    # values[best] is the least weight kept; the plateau reaches down to the next lower weight seen
    low = values[best - 1] if best else values[best] - UNIT
    return float(low + values[best]) / 2 / UNIT


def _nth(values: DataFrame, column: str, n: int) -> tuple[int, int, int]:
    """The n-th least of a column of longs, how many are less, and how many equal; by histograms that narrow."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    below = 0
    while True:
        width = -(-(high - low + 1) // BINS)
        at = F.expr(f"cast(floor((cast(`{column}` as decimal(38, 0)) - {low}) / {width}) as int)")
        for row in values.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect():
            if below + row["n"] >= n:
                break
            below += row["n"]
        low, high = low + row["bin"] * width, min(high, low + (row["bin"] + 1) * width - 1)
        if width == 1:
            return low, below, row["n"]


def _ordered(keys: np.ndarray) -> np.ndarray:
    """Longs in the opposite order of doubles."""
    raw = (keys + 0.0).view(np.int64)
    return -1 - np.where(raw < 0, raw ^ np.int64(2**63 - 1), raw)


def _kth(keys: DataFrame, k: int) -> tuple[int, int, int]:
    """Place (as of :func:`_ordered`) and id of the k-th of the rows (place, id), both ascending; and how many of those
    that equal it belong to the first k (-1: all)."""
    place, below, n = _nth(keys, "place", k)
    if below + n == k:
        return place, 2**63 - 1, -1
    tied = keys.where(F.col("place") == F.lit(place))
    last, less, equal = _nth(tied, "id", k - below)
    return place, last, -1 if below + less + equal == k else k - below - less


def fit(documents: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, label_bound: int = LABEL_BOUND) -> tuple[Model, DataFrame]:
    """The model, and (doc_id, units) of every document.

    k: documents to sample; None takes as many as weigh at least the cut that parts the labelled
    documents best, which makes the sampler a classifier.
    """
    ids, good = _labelled(labels, label_bound)
    raw, target = _counts(documents, ids[good])
    size = float(1 << BITS)
    if target.sum():
        ratio = np.log((target + 1.0) / (target.sum() + size)) - np.log((raw + 1.0) / (raw.sum() + size))
    else:
        ratio = np.zeros(1 << BITS)
    table = np.round(ratio * UNIT).astype(np.int64)
    weights = common.durable(_weights(documents, table))
    model = Model(table, _cut(weights, ids, good), -np.inf, np.iinfo(np.int64).max, 0, seed)
    model.k = weights.where(F.col("units") >= F.lit(float(model.cut * UNIT))).count() if k is None else k

    plain = Model(np.zeros(0), 0.0, 0.0, 0, 0, seed)

    def add_key(batches):
        for batch in batches:
            own = _ids(batch)
            place = _ordered(plain.keys(own, batch.column("units").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(place)], ["id", "place"])

    n = weights.count()
    if model.k <= 0:
        model.key = np.inf
    elif model.k < n:
        place, model.last_id, model.ties = _kth(weights.mapInArrow(add_key, "id long, place long"), model.k)
        raw = np.array([-1 - place], np.int64)
        model.key = float(np.where(raw < 0, raw ^ np.int64(2**63 - 1), raw).view(np.float64)[0])
    return model, weights


def _choose(rows: DataFrame, judged, ties: int) -> DataFrame:
    """Rows by judged(batch) -> (kept, tied); of the tied ones only ``ties`` (all, if negative)."""

    def choose(batches, only: bool):
        for batch in batches:
            kept, tied = judged(batch)
            yield batch.filter(pa.array(tied if only else kept & ~tied if ties >= 0 else kept))

    above = rows.mapInArrow(lambda batches: choose(batches, False), rows.schema)
    return above if ties < 0 else above.unionAll(rows.mapInArrow(lambda batches: choose(batches, True), rows.schema).limit(ties))


def classify(documents: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, label_bound: int = LABEL_BOUND) -> DataFrame:
    """(doc_id, log_weight, sample_key, kept) of every document."""
    model, weights = fit(documents, labels, k, seed, label_bound)
    plain = Model(np.zeros(0), model.cut, model.key, model.last_id, model.k, seed, model.ties)
    last = None
    if plain.ties >= 0:  # rows that equal the last of the top in key and id: the first of them by place
        weights = common.durable(weights.withColumn("row", F.monotonically_increasing_id()))

        def tied(batches):
            for batch in batches:
                own = _ids(batch)
                yield batch.filter(pa.array(plain.tied(own, plain.keys(own, batch.column("units").to_numpy()))))

        last = _nth(weights.mapInArrow(tied, weights.schema), "row", max(1, plain.ties))[0]

    def judge(batches):
        for batch in batches:
            own, units = _ids(batch), batch.column("units").to_numpy()
            keys = plain.keys(own, units)
            kept = plain.kept(own, keys)
            if last is not None:
                kept &= ~plain.tied(own, keys) | (batch.column("row").to_numpy() <= last)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(units / UNIT), pa.array(keys), pa.array(kept)], ["doc_id", "log_weight", "sample_key", "kept"])

    return weights.mapInArrow(judge, "doc_id long, log_weight double, sample_key double, kept boolean")


def keep(documents: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, label_bound: int = LABEL_BOUND) -> DataFrame:
    """The rows of ``documents`` that :func:`classify` keeps, with all their columns; the texts are weighed again rather than joined."""
    model, _ = fit(documents, labels, k, seed, label_bound)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judged(batch):
        own = _ids(batch)
        keys = shared.value.keys(own, score(shared.value.table, *common.utf8(batch.column("text"))))
        return shared.value.kept(own, keys), shared.value.tied(own, keys)

    return _choose(documents, judged, model.ties)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
