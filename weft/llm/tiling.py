"""Operator 3, benchmark decontamination by greedy string tiling.

Runs of SEED words that a document shares with a test item are the seeds. Where the item's words under
seeds reach the wanted share, which bounds what tiles can cover from above, the pair is tiled: running
Karp-Rabin finds the longest matches of unmarked words, they are marked on both sides, longest first,
and the search length falls until no match of SEED words is left. The share of the item's words under
tiles decides, so passages count in any order and with other text between them.

Scale: with a benchmark of at most BROADCAST_WORDS words, its seeds go to every task and documents are
only scanned. A larger one is joined by seed, with the seeds of a document folded before the shuffle,
and only the pairs that reach the share by seeds fetch their texts.

Defined cases: null texts count as empty; items of fewer than SEED words are never found; a repeated
document or item gives its rows again; ties of equal length go to the earlier place in the item, then in
the document; no documents or no items give no rows; other columns are ignored, or kept by the stage.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 4  # words; the least tile
SHARE = 0.5  # of an item's words under tiles, from which a document counts as contaminated
START = 20  # first search length
BROADCAST_WORDS = 2_000_000
_B = np.uint64(0xA24BAED4963EE407)
FOUND = "doc_id long, item_id long, item_words int, covered_words int, coverage double, tiles int"


def seeds(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every run of SEED words within one text."""
    n = len(words) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = words[:n].copy()
    for k in range(1, SEED):
        total *= _B
        total += words[k : n + k]
    whole = np.ones(n, bool)
    for k in range(1, SEED):
        at = first[1:] - k
        at = at[(at >= 0) & (at < n)]
        whole[at] = False
    at = np.flatnonzero(whole)
    return common.mix(total[at]), at


def _alike(a, b, ha, hb, item, text, free_a, free_b, most: int = 1 << 20):
    """Pairs of places with equal hashes that no match one word before continues, in order of the text's place."""
    order = np.argsort(ha, kind="stable")
    sorted_ = ha[order]
    low, high = np.searchsorted(sorted_, hb, "left"), np.searchsorted(sorted_, hb, "right")
    near = np.flatnonzero(high > low)
    size = (high - low)[near]
    upto, done = np.append(0, np.cumsum(size)), 0
    while done < len(near):
        end = max(done + 1, int(np.searchsorted(upto, upto[done] + most, "right")) - 1)
        own = np.repeat(np.arange(done, end), size[done:end])
        i = a[order[low[near[own]] + np.arange(len(own)) - (upto[own] - upto[done])]]
        j = b[near[own]]
        inner = (i > 0) & (j > 0)
        goes_on = inner & free_a[i - 1] & free_b[j - 1] & (item[i - 1] == text[j - 1])
        yield from zip(i[~goes_on].tolist(), j[~goes_on].tolist())
        done = end


def _common(item, text, free_a, free_b, i: int, j: int) -> int:
    """Words from i and j on that agree and are unmarked."""
    k, step = 0, 32
    while True:
        n = min(step, len(item) - i - k, len(text) - j - k)
        if n <= 0:
            return k
        x, y = slice(i + k, i + k + n), slice(j + k, j + k + n)
        same = (item[x] == text[y]) & free_a[x] & free_b[y]
        if not same.all():
            return k + int(same.argmin())
        k, step = k + n, step * 2


def tile(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, words), of at least ``least`` words."""
    free_a, free_b = np.isin(item, text), np.isin(text, item)
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(max(len(item), len(text)), _B, np.uint64)))
    inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(max(len(item), len(text)), np.uint64(pow(int(_B), -1, 1 << 64)), np.uint64)))
    sums = [np.append(np.uint64(0), np.cumsum(x * power[: len(x)])) for x in (item, text)]
    out: list[tuple[int, int, int]] = []
    s = max(least, min(START, len(item)))
    while True:
        starts = []
        for free in (free_a, free_b):
            run = np.append(0, np.cumsum(~free))
            starts.append(np.flatnonzero(run[s:] == run[:-s]) if len(free) >= s else np.zeros(0, np.int64))
        a, b = starts
        ha, hb = ((z[x + s] - z[x]) * inverse[x] for z, x in zip(sums, starts))
        queue, longest = [], 0
        for i, j in _alike(a, b, ha, hb, item, text, free_a, free_b):
            k = _common(item, text, free_a, free_b, i, j)
            if k >= s:
                queue.append((-k, i, j))
                longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        heapq.heapify(queue)
        while queue:
            k, i, j = heapq.heappop(queue)
            k = -k
            # what an earlier tile took from either end is cut off
            while k and not (free_a[i] and free_b[j]):
                i, j, k = i + 1, j + 1, k - 1
            taken = ~(free_a[i : i + k] & free_b[j : j + k])
            left = int(np.argmax(taken)) if taken.any() else k
            if left < k or not (k and left == k):
                if left >= s:
                    heapq.heappush(queue, (-left, i, j))
                if k - left > s:
                    heapq.heappush(queue, (-(k - left - 1), i + left + 1, j + left + 1))
                continue
            if k < s:
                continue
            if queue and -queue[0][0] > k:
                heapq.heappush(queue, (-k, i, j))
                continue
            free_a[i : i + k] = False
            free_b[j : j + k] = False
            out.append((i, j, k))
        if s > 2 * least:
            s //= 2
        elif s > least:
            s = least
        else:
            return out


class Index:
    """Words and seeds of the test items."""

    def __init__(self, ids: list, data: np.ndarray, offsets: np.ndarray):
        self.ids = ids
        self.words, _, _, self.first = common.words(data, offsets)
        hashes, at = seeds(self.words, self.first)
        item = np.searchsorted(self.first, at, "right") - 1
        order = np.argsort(hashes, kind="stable")
        self.seeds, begin = np.unique(hashes[order], return_index=True)
        self.begin = np.append(begin, len(order))
        self.item, self.place = item[order], (at - self.first[item])[order]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.seeds >> np.uint64(48)] = True
        self.size = np.diff(self.first)

    def judge(self, data: np.ndarray, offsets: np.ndarray, share: float) -> list[tuple[int, int, int, int]]:
        """(text, item, covered words, tiles) of every pair that reaches the share."""
        found = []
        for a, b in common.spans(offsets):
            at = offsets[a : b + 1]
            words, _, _, first = common.words(data[at[0] : at[-1]], at - at[0])
            hashes, where = seeds(words, first)
            maybe = self.sieve[hashes >> np.uint64(48)]
            hashes, where = hashes[maybe], where[maybe]
            if not len(hashes) or not len(self.seeds):
                continue
            k = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
            hit = self.seeds[k] == hashes
            k, where = k[hit], where[hit]
            count = self.begin[k + 1] - self.begin[k]
            text = np.repeat(np.searchsorted(first, where, "right") - 1, count)
            entry = np.repeat(self.begin[k], count) + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            pair = np.unique(np.stack([text, self.item[entry], self.place[entry]]), axis=1)
            if not pair.shape[1]:
                continue
            new = np.append(True, (pair[0, 1:] != pair[0, :-1]) | (pair[1, 1:] != pair[1, :-1]))
            step = np.minimum(SEED, np.append(np.diff(pair[2]), SEED))
            step[np.append(new[1:], True)] = SEED
            covered = np.add.reduceat(step, np.flatnonzero(new))
            for t, i, most in zip(pair[0, new].tolist(), pair[1, new].tolist(), covered.tolist()):
                if most >= share * self.size[i]:
                    tiles = tile(self.words[self.first[i] : self.first[i + 1]], words[first[t] : first[t + 1]])
                    under = sum(x[2] for x in tiles)
                    if under >= share * self.size[i]:
                        found.append((a + t, i, under, len(tiles)))
        return found

    def batch(self, ids: list, found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        rows = [(ids[t], self.ids[i], int(self.size[i]), under, under / int(self.size[i]), n) for t, i, under, n in found]
        columns = zip(*rows) if rows else ([] for _ in range(6))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["doc_id", "item_id", "item_words", "covered_words", "coverage", "tiles"])


def _index(benchmark: DataFrame, most: int) -> Index | None:
    """The benchmark's index, or None if it is too large to send to every task."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    # a word has a byte at least, and a byte between it and the next
    if (items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0) / 2 > most:
        return None
    table = items.toArrow().combine_chunks()
    return Index(table.column("item_id").to_pylist(), *common.utf8(table.column("text")))


def contamination(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, tiles) of every pair that reaches the share."""
    index = _index(benchmark, broadcast_words)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if index is None:
        return _joined(docs.withColumn("weft_key", F.monotonically_increasing_id()), benchmark, share).drop("weft_key")
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def scan(batches):
        for batch in batches:
            found = shared.value.judge(*common.utf8(batch.column("text")), share)
            if found:
                yield shared.value.batch(batch.column("doc_id").to_pylist(), found)

    return docs.mapInArrow(scan, FOUND)


def _joined(docs: DataFrame, benchmark: DataFrame, share: float) -> DataFrame:
    """The same by a join of seeds, for a benchmark of any size."""
    docs = common.durable(docs)
    items = common.durable(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).withColumn("item_key", F.monotonically_increasing_id()))

    def of(key: str, text: str):
        def spread(batches):
            for batch in batches:
                data, offsets = common.utf8(batch.column(text))
                keys = batch.column(key).to_numpy()
                for a, b in common.spans(offsets):
                    at = offsets[a : b + 1]
                    words, _, _, first = common.words(data[at[0] : at[-1]], at - at[0])
                    hashes, where = seeds(words, first)
                    own = np.searchsorted(first, where, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(keys[a + own]), pa.array((where - first[own]).astype(np.int32)), pa.array(np.diff(first)[own].astype(np.int32))], ["seed", key, "place", "size"])

        return spread

    by_doc = docs.select("weft_key", "text").mapInArrow(of("weft_key", "text"), "seed long, weft_key long, place int, size int").select("seed", "weft_key").distinct()
    by_item = items.select("item_key", "item_text").mapInArrow(of("item_key", "item_text"), "seed long, item_key long, place int, size int")
    pairs = by_doc.join(by_item, "seed").groupBy("weft_key", "item_key").agg(F.countDistinct("place").alias("n"), F.first("size").alias("size"))
    pairs = pairs.where(F.col("n") * SEED >= F.col("size") * share).select("weft_key", "item_key")
    both = pairs.join(items, "item_key").join(docs, "weft_key")

    def judge(batches):
        for batch in batches:
            items_, texts = batch.column("item_text"), batch.column("text")
            for k in range(batch.num_rows):
                index = Index(batch.column("item_id").slice(k, 1).to_pylist(), *common.utf8(items_.slice(k, 1)))
                found = index.judge(*common.utf8(texts.slice(k, 1)), share)
                if found:
                    out = index.batch(batch.column("doc_id").slice(k, 1).to_pylist(), found)
                    yield pa.RecordBatch.from_arrays([*out.columns, batch.column("weft_key").slice(k, 1)], [*out.schema.names, "weft_key"])

    return both.select("weft_key", "doc_id", "text", "item_id", "item_text").mapInArrow(judge, FOUND + ", weft_key long")


def decontaminate(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The documents that no test item contaminates, with all their columns."""
    index = _index(benchmark, broadcast_words)
    if index is None:
        keyed = common.durable(documents.withColumn("weft_key", F.monotonically_increasing_id()))
        found = _joined(keyed.select("weft_key", F.lit(0).cast("long").alias("doc_id"), "text"), benchmark, share)
        return keyed.join(found.select("weft_key").distinct(), "weft_key", "left_anti").select(*documents.columns)
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def choose(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[x[0] for x in shared.value.judge(*common.utf8(batch.column("text")), share)]] = False
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(choose, documents.schema)


def op3_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
