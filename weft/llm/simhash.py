"""Operator 7, SimHash near-dedup by a May-Ozerov recursion.

A text's features are its distinct words and pairs of neighbouring words; its fingerprint is their
256-bit SimHash. Documents link at a Hamming distance of at most THRESHOLD (0.21 of the bits), which in
prose means that they share more than about half of their word 4-grams.

Search: a repetition draws a random order of the bits and cuts strips from it. On each strip a set of
random centres filters the fingerprints: those of low partial weight (after xor with the centre) go
into the centre's list, and each list is filtered again on the next strip, until lists are small; those
are compared by brute force. Repetitions are added until a pair at the threshold shares a list with the
target probability, at any depth. Equal fingerprints are first folded into one row with a count.

A strip is wide, with random centres, or narrow: one bit, with both its values as centres, so that each row
is in one list of a repetition. The plan takes what costs least: narrow strips, at all sizes up to 1e9.

Scale: a map makes the fingerprints; lists are buckets of one shuffle, of some 48 bytes a row, and a list that
is too long for one block is split into pairs of blocks. A pair counts only in the first list that it
shares, which the bits in which it differs tell, so links are counted without being written: each step
returns a count and a local root per row. The plan weighs rows of the shuffle against filtering and
comparing, so lists, depth and repetitions grow as a power (some 0.35) of the number of fingerprints.

Defined cases: a null text counts as empty; texts without words link only to equal texts; a repeated
row links to its twin; a null doc_id comes after all ids, and rows of one id are apart where their texts
are; no rows give no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log, log1p
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, links

BITS = 256
THRESHOLD = 54
TARGET_RECALL = 0.98  # planned at the threshold itself, whatever the depth; nearer pairs are found more surely
STRIPS = (64, 128)
CENTRES = (4, 16, 64)
#: What a row of the shuffle, an order of the bits, a word of a filter (a bit of a narrow strip) and a comparison
#: cost, in nanoseconds; the plan costs least. Half of a row is for the 60 bytes of disk that it takes, and a
#: comparison contains that lists are longer than those of random bits.
ROW_NS, ORDER_NS, FILTER_NS, PAIR_NS = 8000.0, 100.0, 12.0, 8.0
BLOCK = 8192  # rows of a list that meet in one block
SMALL = 1024  # rows of a list that is compared in step with others
_SALT = common.mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64))


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SimHash of each text, as rows of BITS / 64 unsigned words."""
    n = len(offsets) - 1
    out = np.zeros((n, BITS // 64), np.uint64)
    for a, b in common.spans(offsets):
        at = offsets[a : b + 1]
        out[a:b] = _some(data[at[0] : at[-1]], at - at[0])
    return out


def _some(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    word, _, _, first = common.words(data, offsets)
    count = np.diff(first)
    text = np.repeat(np.arange(n), count)
    inner = text[1:] == text[:-1]
    both = common.mix(word[:-1] * np.uint64(3) + (word[1:] ^ np.uint64(0x5BD1E995)))[inner]
    shift = np.uint64(40)
    key = np.concatenate([(text.astype(np.uint64) << shift) | (word >> np.uint64(24)), (text[1:][inner].astype(np.uint64) << shift) | (both >> np.uint64(24))])
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    text = (key >> shift).astype(np.int64)
    feature = key & np.uint64((1 << 40) - 1)
    size = np.bincount(text, minlength=n)
    votes = np.zeros((n, BITS), np.int32)
    eights = -(-size // 8)  # features are counted eight at a time; the last ones of a text may be none
    place = np.arange(len(key)) + np.repeat(8 * (np.cumsum(eights) - eights) - (np.cumsum(size) - size), size)
    owner = np.repeat(np.arange(n), eights)
    for s in range(0, len(owner), 1 << 10):  # 256 KB of sums at a time
        own = owner[s : s + (1 << 10)]
        first, end = np.searchsorted(place, (8 * s, 8 * (s + len(own))))
        part, at = feature[first:end], place[first:end] - 8 * s
        at = (at & 7) * len(own) + (at >> 3)
        hashes = np.zeros((BITS // 64, 8 * len(own)), np.uint64)
        for k in range(BITS // 64):
            hashes[k, at] = common.mix(part ^ _SALT[k])
        hashes = hashes.reshape(BITS // 64, 8, len(own)).transpose(1, 0, 2)
        bits = np.zeros((len(own), BITS // 8), np.uint64)
        for power, plane in enumerate(_sum_of_eight(hashes)):
            digit = np.unpackbits(np.ascontiguousarray(plane.T).view(np.uint8), axis=1).view(np.uint64)
            digit <<= np.uint64(power)
            bits += digit
        new = np.append(True, own[1:] != own[:-1])
        run = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        starts = np.flatnonzero(new | (run % 31 == 0))  # at most 31 rows of up to 8, so that sums of bytes don't overflow
        sums = np.add.reduceat(bits, starts, axis=0).view(np.uint8)
        votes[own[new]] += np.add.reduceat(sums, np.searchsorted(starts, np.flatnonzero(new)), axis=0, dtype=np.int32)
    out = np.ascontiguousarray(np.packbits(votes * 2 > size[:, None], axis=1)).view(np.uint64).reshape(n, -1)
    for k in np.flatnonzero(size == 0):  # no words: a hash of the text itself
        import xxhash

        raw = data[offsets[k] : offsets[k + 1]].tobytes()
        out[k] = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw, seed=s) for s in range(BITS // 128)), np.uint64)
    return out


def _sum_of_eight(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each bit, in how many of the eight x it is set, as four planes of binary digits."""

    def add(a, b, c):
        both = a ^ b
        return both ^ c, (a & b) | (both & c)

    one, two = add(x[0], x[1], x[2])
    other, more = add(x[3], x[4], x[5])
    third, last = add(x[6], x[7], one)
    ones, carry = other ^ third, other & third
    low, high = add(two, more, last)
    twos, top = low ^ carry, low & carry
    return ones, twos, high ^ top, high & top


class Plan(NamedTuple):
    """Bits of a strip, strips one after the other, most partial weight on a strip, centres of a strip, repetitions."""

    strip: int
    depth: int
    weight: int
    centres: int
    repetitions: int


def narrow(strip: int, weight: int, centres: int) -> bool:
    """Whether the centres are all values of a strip, so that each row is in the list of its own one."""
    return strip == 1 and weight == 0 and centres == 2


def passing(weight: int, strip: int) -> float:
    return sum(comb(strip, w) for w in range(weight + 1)) / 2.0**strip


@lru_cache(maxsize=None)
def meeting(strip: int, weight: int, centres: int) -> tuple[float, ...]:
    """For each number of bits in which a pair differs on a strip, the probability that some centre passes both."""
    if narrow(strip, weight, centres):
        return 1.0, 0.0
    out = []
    for differing in range(strip + 1):
        below = np.append(0.0, np.cumsum([float(comb(strip - differing, y)) for y in range(strip - differing + 1)]))
        room = [(x, min(weight - max(x, differing - x), strip - differing)) for x in range(differing + 1)]
        both = sum(comb(differing, x) * below[m + 1] for x, m in room if m >= 0) / 2.0**strip
        out.append(-np.expm1(centres * log1p(-min(both, 1 - 1e-16))))
    return tuple(out)


@lru_cache(maxsize=None)
def sharing(distance: int, strip: int, depth: int, weight: int, centres: int) -> float:
    """Probability that a pair at this distance shares a list of one repetition.

    The strips of a repetition are cut from one order of the bits, so their differing bits are drawn without
    replacement; all centres of a level see the same ones.
    """
    level = meeting(strip, weight, centres)

    @lru_cache(maxsize=None)
    def rest(left: int, bits: int, levels: int) -> float:
        if not levels:
            return 1.0
        most = min(left, strip)
        return sum(comb(left, k) * comb(bits - left, strip - k) / comb(bits, strip) * level[k] * rest(left - k, bits - strip, levels - 1) for k in range(most + 1) if strip - k <= bits - left)

    return rest(distance, BITS, depth)


def repetitions_of(strip: int, depth: int, weight: int, centres: int, threshold: int = THRESHOLD) -> int:
    """Repetitions until a pair at the threshold shares a list with TARGET_RECALL."""
    share = sharing(threshold, strip, depth, weight, centres)
    return 1 << 62 if share < 1e-12 else 1 if share >= TARGET_RECALL else ceil(log(1 - TARGET_RECALL) / log1p(-share))


def rows_of(plan: Plan) -> float:
    """Rows of the shuffle for a fingerprint."""
    return plan.repetitions * (plan.centres * passing(plan.weight, plan.strip)) ** plan.depth


def cost(plan: Plan, n: int) -> float:
    """Nanoseconds that a fingerprint takes among n."""
    rows = rows_of(plan)
    filters = plan.repetitions * plan.depth * (plan.centres * plan.strip / 64 if plan.strip > 1 else 1)
    return rows * ROW_NS + plan.repetitions * ORDER_NS + filters * FILTER_NS + rows * n * passing(plan.weight, plan.strip) ** plan.depth / 2 * PAIR_NS


@lru_cache
def plan(n: int, threshold: int = THRESHOLD) -> Plan:
    """The plan that costs least for n fingerprints; n counts in steps of a quarter more."""
    if n <= BLOCK:
        return Plan(64, 1, 64, 1, 1)  # one small list, which needs no filter
    n = int(1.25 ** ceil(log(n) / log(1.25)))
    best = None
    for depth in range(1, 64):
        if 1 <= n * passing(0, 1) ** depth <= BLOCK:
            own = Plan(1, depth, 0, 2, repetitions_of(1, depth, 0, 2, threshold))
            if best is None or cost(own, n) < cost(best, n):
                best = own
    for strip in STRIPS:
        for depth in range(1, BITS // strip + 1):
            for weight in range(strip // 4, strip // 2):
                if not 1 <= n * passing(weight, strip) ** depth <= BLOCK:
                    continue
                for centres in CENTRES:
                    own = Plan(strip, depth, weight, centres, repetitions_of(strip, depth, weight, centres, threshold))
                    if best is None or cost(own, n) < cost(best, n):
                        best = own
    return best


@lru_cache(maxsize=1 << 12)
def _draw(repetition: int, strip: int, depth: int, centres: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([7, repetition, strip, depth])
    if strip == 1:
        return rng.permutation(BITS)[:depth], np.zeros(0, np.uint64)
    return rng.permutation(BITS)[: strip * depth], rng.integers(0, 1 << 64, (depth, centres, strip // 64), dtype=np.uint64)


def _bits(prints: np.ndarray, repetition: int, own: Plan) -> list[np.ndarray]:
    """The narrow strips of a repetition, one byte a row."""
    raw = np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), BITS // 8)
    return [(raw[:, k >> 3] >> np.uint8(7 - (k & 7))) & np.uint8(1) for k in _draw(repetition, own.strip, own.depth, own.centres)[0].tolist()]


@lru_cache(maxsize=1 << 12)
def _chosen(repetition: int, strip: int, depth: int, centres: int) -> np.ndarray:
    """The bits of a repetition's narrow strips, as a fingerprint in which they are set."""
    bits = np.zeros(BITS, np.uint8)
    bits[_draw(repetition, strip, depth, centres)[0]] = 1
    return np.packbits(bits).view(np.uint64)


def masks(prints: np.ndarray, repetition: int, own: Plan) -> np.ndarray:
    """For each level the centres that a fingerprint passes, as bits: shape (rows, depth)."""
    if own.strip == 1:
        return np.stack([np.uint64(1) << x.astype(np.uint64) for x in _bits(prints, repetition, own)], axis=1)
    order, centres = _draw(repetition, own.strip, own.depth, own.centres)
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1)
    strips = np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(np.uint64).reshape(len(prints), own.depth, own.strip // 64)
    out = np.zeros((len(prints), own.depth), np.uint64)
    for level in range(own.depth):
        far = np.zeros((len(prints), own.centres), np.uint16)
        for word in range(own.strip // 64):
            far += np.bitwise_count(strips[:, level, word, None] ^ centres[level, :, word])
        low = np.zeros((len(prints), 64), bool)
        low[:, : own.centres] = far <= own.weight
        out[:, level] = np.ascontiguousarray(np.packbits(low, axis=1, bitorder="little")).view(np.uint64).reshape(-1)
    return out


def lists(prints: np.ndarray, repetition: int, own: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) for each list of this repetition that a row ends in."""
    if own.strip == 1:
        path = np.full(len(prints), repetition, np.int64)
        for bit in _bits(prints, repetition, own):
            path <<= 1
            path |= bit
        return np.arange(len(prints)), path
    mask = masks(prints, repetition, own)
    row = np.arange(len(prints))
    path = np.full(len(prints), repetition, np.int64)
    for level in range(own.depth):
        inside = np.unpackbits(np.ascontiguousarray(mask[row, level]).view(np.uint8).reshape(len(row), 8), axis=1, bitorder="little")
        at, centre = np.nonzero(inside)
        row, path = row[at], path[at] * own.centres + centre
    return row, path


def _first_here(prints: np.ndarray, a: np.ndarray, b: np.ndarray, path: int, own: Plan) -> np.ndarray:
    """Whether ``path`` is the first list that both rows of each pair share; each row is filtered once a repetition."""
    if path == 0:
        return np.ones(len(a), bool)
    here = path // own.centres**own.depth
    todo = np.arange(len(a))
    place = np.zeros(len(prints), np.int64)
    for r in range(here + 1):
        if not len(todo):
            break
        some = np.zeros(len(prints), bool)
        some[a[todo]] = some[b[todo]] = True
        rows = np.flatnonzero(some)
        place[rows] = np.arange(len(rows))
        mask = masks(prints[rows], r, own)
        both = mask[place[a[todo]]] & mask[place[b[todo]]]
        hit = (both != 0).all(axis=1)
        if r < here:
            todo = todo[~hit]
            continue
        low = np.bitwise_count((both & (~both + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        first = np.full(len(todo), r, np.int64)
        for level in range(own.depth):
            first = first * own.centres + low[:, level]
        todo = todo[hit & (first == path)]
    out = np.zeros(len(a), bool)
    out[todo] = True
    return out


def _first(prints: np.ndarray, a: np.ndarray, b: np.ndarray, path: np.ndarray, own: Plan) -> np.ndarray:
    """Whether its list, which both rows of each pair are in, is the first that they share."""
    if own.strip > 1:
        out = np.zeros(len(a), bool)
        order = np.argsort(path, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(path[order])) + 1):
            rows, at = np.unique(np.concatenate([a[some], b[some]]), return_inverse=True)
            out[some] = _first_here(prints[rows], at[: len(some)], at[len(some) :], int(path[some[0]]), own)
        return out
    here = path >> own.depth
    differing = np.ascontiguousarray((prints[a] ^ prints[b]).T)
    out = np.ones(len(a), bool)
    todo = np.arange(len(a))
    for r in range(int(here.max(initial=0))):
        later = here[todo] > r
        todo, differing = todo[later], differing[:, later]
        shared = np.ones(len(todo), bool)
        for bits, word in zip(_chosen(r, own.strip, own.depth, own.centres), differing):
            if bits:
                shared &= (word & bits) == 0
        out[todo[shared]] = False
        todo, differing = todo[~shared], differing[:, ~shared]
    return out


def _near(own: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the threshold of rows of left and right; same: both are one list, of which each pair counts once."""
    step, words = max(1, (1 << 17) // max(1, len(right))), own.shape[1]
    x, y = np.ascontiguousarray(own[left].T), np.ascontiguousarray(own[right].T)
    for k in range(0, len(left), step):
        low = k if same else 0
        far = np.zeros((len(x[0, k : k + step]), y.shape[1] - low), np.uint8)
        for word in range(min(3, words)):
            far += np.bitwise_count(x[word, k : k + step, None] ^ y[word, low:])
        i, j = np.nonzero(far <= threshold)
        total = far[i, j].astype(np.int16)
        i, j = i + k, j + low
        for word in range(3, words):
            total += np.bitwise_count(x[word, i] ^ y[word, j])
        near = (total <= threshold) & (i < j) if same else total <= threshold
        yield left[i[near]], right[j[near]]


def _near_in_step(own: np.ndarray, first: np.ndarray, size: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the threshold in each of many small lists; lists of about one length are compared in step."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    words = np.ascontiguousarray(own.T)
    done = 0
    while done < len(size) and size[done] > 1:
        most = int(size[done])
        like = int(np.searchsorted(-size, -(most * 4 // 5 - 4), "right"))
        end = max(done + 1, min(like, done + max(1, (1 << 14) // most)))
        start, count = first[done:end], size[done:end]
        done = end
        if most * len(start) < 1 << 12 and most > 64:
            for begin, n in zip(start.tolist(), count.tolist()):
                rows = np.arange(begin, begin + n)
                yield from _near(own, rows, rows, threshold, True)
            continue
        place = np.arange(most)[:, None]
        empty = place >= count
        block = words[:, np.where(empty, 0, start + place)]  # word, place in the list, list
        block[:, empty] = common.mix(np.arange(block[:, empty].size, dtype=np.uint64)).reshape(len(words), -1)  # far from most, and left out below
        i, at, part, held = [], [], [], 0
        for p in range(most - 1):
            far = np.bitwise_count(block[0, p + 1 :] ^ block[0, p])
            for word in range(1, min(3, len(words))):
                far += np.bitwise_count(block[word, p + 1 :] ^ block[word, p])
            far = far.ravel()
            hit = np.flatnonzero(far <= threshold)
            if len(hit):
                i.append(np.full(len(hit), p))
                at.append(hit + (p + 1) * len(start))
                part.append(far[hit])
                held += len(hit)
            if held > 1 << 17 or (held and p == most - 2):
                lower, (upper, column) = np.concatenate(i), np.divmod(np.concatenate(at), len(start))
                total = np.concatenate(part).astype(np.int16)
                for word in range(3, len(words)):
                    total += np.bitwise_count(block[word, lower, column] ^ block[word, upper, column])
                near = (total <= threshold) & (upper < count[column])
                yield start[column[near]] + lower[near], start[column[near]] + upper[near]
                i, at, part, held = [], [], [], 0


def _pairs(own: np.ndarray, starts: np.ndarray, bi: np.ndarray, bj: np.ndarray, side: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the threshold in each list, or, of a pair of blocks, between the two."""
    size = np.diff(starts)
    cross = (bi != bj)[starts[:-1]]
    small = ~cross & (size <= SMALL)
    yield from _near_in_step(own, starts[:-1][small], size[small], threshold)
    for k in np.flatnonzero(~small).tolist():
        left = right = np.arange(starts[k], starts[k + 1])
        if cross[k]:
            left, right = left[side[left] == bi[starts[k]]], right[side[right] != bi[starts[k]]]
        yield from _near(own, left, right, threshold, not cross[k])


def _in_steps(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs, some ``most`` at a time."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= most:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _columns(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(f"f{k}").to_numpy().view(np.uint64) for k in range(BITS // 64)], axis=1)


def fingerprint(documents: DataFrame) -> DataFrame:
    """(doc_id, row_key, f0, f1, ...): row_key is a hash of id and text, equal for repeated rows."""
    names = [f"f{k}" for k in range(BITS // 64)]

    def make(batches):
        for batch in batches:
            prints = fingerprints(*common.utf8(batch.column("text"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("row_key"), *[pa.array(np.ascontiguousarray(prints[:, k])) for k in range(len(names))]], ["doc_id", "row_key", *names])

    return documents.select("doc_id", "text", _row_key()).mapInArrow(make, "doc_id long, row_key long, " + ", ".join(f"{c} long" for c in names))


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.lit(0), "text").alias("row_key")


def near_duplicates(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (least id of the same fingerprint), n_links (other
    documents within the threshold, copies included), component_id (least id reachable), kept.

    class_id and component_id are null where no document of theirs has an id. Of each component one
    document is kept, and its repeated rows with it.
    """
    return _judged(documents, threshold).drop("row_key")


def _judged(documents: DataFrame, threshold: int) -> DataFrame:
    names = [f"f{k}" for k in range(BITS // 64)]
    prints = common.durable(fingerprint(documents))
    # ids may be null or shared, so classes have numbers of their own; ids decide only which row comes first
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key"))
    classes = common.durable(prints.groupBy(*names).agg(first.alias("first"), F.count("*").alias("copies")).withColumn("class", F.monotonically_increasing_id()))
    n_classes = classes.count()
    chosen = plan(n_classes, threshold)

    def spread(batches):
        for batch in batches:
            own = _columns(batch)
            for r in range(chosen.repetitions):
                row, path = lists(own, r, chosen)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(path), *taken.columns], ["list", *batch.schema.names])

    every = max(1, min(16, n_classes // BLOCK))  # lengths only say which lists are split, so they may be estimated

    def lengths(batches):
        for batch in batches:
            some = common.mix(batch.column("class").to_numpy().view(np.uint64)) % np.uint64(every) == 0
            own = _columns(batch)[some]
            for r in range(chosen.repetitions if len(own) else 0):
                path, n = np.unique(lists(own, r, chosen)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(n * every)], ["list", "n"])

    kinds = "class long, copies long, " + ", ".join(f"{c} long" for c in names)
    spreaded = classes.select("class", "copies", *names).mapInArrow(spread, "list long, " + kinds)
    sizes = classes.select("class", *names).mapInArrow(lengths, "list long, n long").groupBy("list").agg(F.sum("n").alias("bucket_n"))

    def compare(batches):
        for table, starts in links.groups(batches, ["list", "bi", "bj"], 1 << 16):
            own = _columns(table)
            ids, copies, path, bi, bj, side = (table.column(c).to_numpy() for c in ("class", "copies", "list", "bi", "bj", "own"))
            degree = np.zeros(len(ids), np.int64)
            node = root = ids[:0]
            for a, b in _in_steps(_pairs(own, starts, bi, bj, side, threshold)):
                mine = _first(own, a, b, path[a], chosen)
                a, b = a[mine], b[mine]
                degree += (np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))).astype(np.int64)
                node, root = links.forest(np.concatenate([node, ids[a]]), np.concatenate([root, ids[b]]))
            linked = np.flatnonzero(degree)
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(root[np.searchsorted(node, ids[linked])]), pa.array(degree[linked])], ["class", "root", "degree"])

    met = links.in_blocks(spreaded, sizes, ["list"], "class", BLOCK)
    found = met.repartition("list", "bi", "bj").sortWithinPartitions("list", "bi", "bj").mapInArrow(compare, "class long, root long, degree long")
    found = common.durable(found.groupBy("class", "root").agg(F.sum("degree").alias("degree")))
    component = links.components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    degree = found.groupBy("class").agg(F.sum("degree").alias("degree"))
    leader = component.join(classes.select("class", "first"), "class").groupBy("component").agg(F.min("first").alias("leader"))
    linked = component.join(leader, "component").select("class", "leader")
    whole = classes.join(degree, "class", "left").join(linked, "class", "left").withColumn("leader", F.coalesce("leader", "first"))
    whole = whole.select(*names, F.col("first.doc_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.col("leader.doc_id").alias("component_id"), F.col("leader.row_key").alias("leader_key"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_key") == F.col("leader_key"))
    return prints.join(whole, names).select("doc_id", "row_key", "class_id", "n_links", "component_id", kept.alias("kept"))


def keep_one(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The first document of each group, with all its columns: that of the least id, nulls last, and of
    the least key of its row where ids are equal; a repeated row stays once."""
    kept = _judged(documents, threshold).where("kept").select(F.col("doc_id").alias("weft_id"), F.col("row_key").alias("weft_key"))
    once = common.durable(kept.groupBy("weft_id", "weft_key").agg(F.count("*").alias("weft_rows")))
    keyed = documents.withColumn("weft_row", _row_key())
    same = (F.col("weft_row") == F.col("weft_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("weft_id"))
    out = keyed.join(once.select("weft_id", "weft_key"), same, "left_semi")
    if not once.where("weft_rows > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "weft_row"])
    return out.select(*documents.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
