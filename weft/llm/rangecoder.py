"""Operator 4, token ids in files: an adaptive context-mixing range coder.

A file is a row of segments of some STEP characters. A segment begins with its prior, learnt from its ids: order-0 frequencies, order-1 frequencies of the pairs
that are worth their bytes, and for some pairs the id that mostly follows (order 2). Ids are cut into
blocks of BLOCK, each coded on its own, from the prior, with a checksum. Within a block the chance that
the order-2 guess is right is mixed, in the logistic domain and by weights that adapt, from the record of
such guesses, and from the order-1 and order-0 chances of the guessed id. An id that is not the guess is
coded by its order-1 frequency, or after an escape by its order-0 frequency. All of it drives a range
coder with carries.

Blocks are coded in step, a lane each, so that each step of the coder is a vector operation.

Segment: magic and lengths; the index (documents and how many ids each has, the prior, and of each block the
ids, bytes and crc32) with a checksum; the blocks. An end mark with the number of segments closes the file.
Files are in ascending doc_id order, null before all.

Scale: documents are range-partitioned by id, and each partition writes one file, whole and then moved
into place, so a repeated attempt writes the same file. A task holds a segment at a time, the driver a count
per file.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first and is read back as
null; repeated rows keep both, in any order, as they are equal; ids may be any below 2 ** 32; no
documents write no file and give no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pieces

BLOCK = 1024
LANES = 8192  # blocks coded in step, at most
STEP = 12 << 20  # bytes of text in a segment
FILE_BYTES = 1 << 25  # of text in a file
MAGIC, END = b"WEFTIDS2", b"WEFTEND2"
_U = np.uint64
_ROW, _CHANCE = 16, 12  # log2 of the totals of a row of frequencies, and of the chance of a guess
_WORTH = 24.0  # bits that an entry of the prior must save
_CLASSES = np.array([0.5, 0.12, 0.25, 0.4, 0.55, 0.7, 0.85, 0.95])  # chances that guesses start from; class 0 is no guess
_RATES = np.round(_CLASSES * 4096).astype(np.int32)

#: stretch(p) = ln(p / (1 - p)) in 1/256 for p in 1/4096, and its inverse.
_STRETCH = np.round(np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096))) * 256).astype(np.int32)
_STRETCH[2048] = 0
_SQUASH = np.clip(np.round(4096 / (1 + np.exp(-(np.arange(4096) - 2048) / 256))), 16, 4080).astype(np.int32)


def _shares(count: np.ndarray, row: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2 ** bits in each row of sorted ``row``."""
    total, size = np.bincount(row, count, rows), np.bincount(row, minlength=rows)
    out = 1 + np.floor(count / np.maximum(total, 1)[row] * (2**bits - size)[row]).astype(np.int64)
    first = np.cumsum(size) - size
    some = np.flatnonzero(size)
    lost = 2**bits - np.bincount(row, out, rows).astype(np.int64)
    # what rounding left over goes to the row's last entry
    out[(first + size - 1)[some]] += lost[some]
    return out


class Prior:
    """What all blocks of a file start from.

    ids: distinct ids, ascending; own, below, f0: order-0 frequencies. A state is a pair's entry (row: the
    id before, succ: the id, f1, below1) or, after an escape, that of the id alone; ``guess`` is the state
    that mostly comes next (-1: none), ``kind`` the class of its chance.
    """

    def __init__(self, ids, f0, rows, succ, f1, guess, kind):
        self.ids, self.f0, self.succ_of, self.f1, self.rows = ids, f0, succ, f1, rows
        n, self.pairs = len(ids), len(succ)
        self.bits = max(16, int(n).bit_length() + 3)
        self.below0 = np.append(0, np.cumsum(f0)).astype(np.int64)
        # entries of a row: its pairs, then its escape (succ == n)
        self.row_of = np.repeat(np.arange(n), rows)
        self.end = np.cumsum(rows)
        ends = np.append(0, np.cumsum(f1))
        self.below1 = (ends[:-1] & ((1 << _ROW) - 1)).astype(np.int64)
        escape = succ == n
        # states: the entries, then the ids alone
        self.state_id = np.concatenate([np.where(escape, 0, succ), np.arange(n)])
        self.guess = np.concatenate([guess, np.full(n, -1)])
        self.kind = np.concatenate([kind, np.zeros(n, np.int64)])
        self.kind[self.guess < 0] = 0
        at, none = np.maximum(self.guess, 0), self.guess < 0
        in1 = in0 = np.zeros(len(none), np.int64)
        if len(f1):
            in1, in0 = (np.where(none, 0, _STRETCH[np.clip(f >> (b - 12), 2, 4093)].astype(np.int64)) for f, b in ((f1[at], _ROW), (f0[self.state_id[at]], self.bits)))
        # one look at a table a state: what it gives the mixer, and its row; and an entry: its share of its row
        self.mix = self.kind | (in1 + 2048) << 8 | (in0 + 2048) << 20 | self.state_id.astype(np.int64) << 32
        self.share = self.below1.astype(_U) | f1.astype(_U) << _U(20)
        self.escape = escape
        self.alone = np.repeat(np.arange(n, dtype=np.int32), f0) if self.bits <= 20 else None  # id of each slot
        # search index
        self.search = np.append(self.row_of.astype(np.int64) << _ROW | self.below1, np.full(1 << 16, np.iinfo(np.int64).max))
        fine = min(10, max(0, 21 - int(n).bit_length()))
        self.shift = _ROW - fine
        self.coarse = np.searchsorted(self.search, np.arange((n << fine) + 1) << self.shift, "right") - 1
        gap = int(np.diff(self.coarse).max(initial=0))
        self.steps = [1 << k for k in reversed(range(gap.bit_length()))]

    def id_at(self, slot: np.ndarray) -> np.ndarray:
        return self.alone[slot].astype(np.int64) if self.alone is not None else np.searchsorted(self.below0, slot, "right") - 1

    def entry_at(self, key: np.ndarray) -> np.ndarray:
        """The entry of each row << _ROW | slot."""
        at = self.coarse[key >> self.shift]
        for step in self.steps:
            at += step * (self.search[at + step] <= key)
        return at

    @classmethod
    def learn(cls, ids: np.ndarray) -> tuple[Prior, np.ndarray, np.ndarray]:
        """The prior of these ids; the ids as places among the distinct ones; and the entry that codes each
        from the id before (for the first of a block, which has none, 0)."""
        top = int(ids.max(initial=0)) + 1
        if top <= 1 << 24:
            seen = np.zeros(top, np.int32)
            seen[ids] = 1
            known = np.flatnonzero(seen)
            seen[known] = np.arange(len(known), dtype=np.int32)
            x = seen[ids]
        else:
            known, x = np.unique(ids, return_inverse=True)
            x = x.astype(np.int32)
        n = len(known)
        count0 = np.bincount(x, minlength=n)
        bits = max(16, int(n).bit_length() + 3)
        f0 = _shares(count0, np.zeros(n, np.int64), 1, bits)
        p0 = f0 / 2.0**bits
        inner = np.ones(len(x), bool)
        inner[::BLOCK] = False
        inner = inner[1:]
        key = x[:-1].astype(np.int64)
        key *= n
        key += x[1:]
        if n * n <= max(1 << 20, 4 * len(x)):
            table = np.bincount(key[inner], minlength=n * n)
            pair = np.flatnonzero(table)
            count = table[pair]
        else:
            table = None
            pair, count = np.unique(key[inner], return_counts=True)
        before, succ = pair // n, pair % n
        after = np.bincount(before, count, n)
        worth = count * np.log2(count / after[before] / p0[succ]) > np.where(count > 255, 32, _WORTH)
        pair, count, before, succ = pair[worth], count[worth], before[worth], succ[worth]
        rest = after - np.bincount(before, count, n)
        # the entries of all rows in order, each row with its escape last
        row = np.concatenate([before, np.arange(n)])
        order = np.lexsort((np.concatenate([succ, np.full(n, n)]), row))
        row, succ, count = row[order], np.concatenate([succ, np.full(n, n)])[order], np.concatenate([count, rest])[order]
        f1 = _shares(np.maximum(count, 1e-3), row, n, _ROW)
        rows = np.bincount(row, minlength=n)
        end = np.cumsum(rows)
        if table is not None:
            table = np.full(n * n, -1, np.int32)
            table[(row * n + succ)[succ < n]] = np.flatnonzero(succ < n)
            entry = table[key]
        else:
            own = (row * n + succ)[succ < n]
            at = np.minimum(np.searchsorted(own, key), max(0, len(own) - 1))
            entry = np.where(own[at] == key, np.flatnonzero(succ < n)[at], -1).astype(np.int32) if len(own) else np.full(len(key), -1, np.int32)
            del at
        del key
        lost = np.flatnonzero(entry < 0)
        entry[lost] = end[x[:-1][lost]] - 1
        # order 2: the entry that mostly follows an entry
        guess, kind = np.full(len(succ), -1), np.zeros(len(succ), np.int64)
        fine = inner[1:] & inner[:-1] & (succ[entry[:-1]] < n)
        both = entry[:-1][fine].astype(np.int64) * len(succ) + entry[1:][fine]
        both.sort()
        if len(both):
            head = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            times = np.diff(np.append(head, len(both)))
            first, follow = both[head] // len(succ), both[head] % len(succ)
            del both
            whole = np.bincount(first, times, len(succ))
            times = np.where(succ[follow] < n, times, 0)
            order = np.lexsort((times, first))
            best = order[np.append(np.flatnonzero(first[1:] != first[:-1]), len(first) - 1)]
            first, follow, times = first[best], follow[best], times[best].astype(float)
            p1, p2 = f1[follow] / 2.0**_ROW, np.clip(times / whole[first], 1e-4, 0.98)
            gain = times * np.log2(p2 / p1) + (whole[first] - times) * np.log2((1 - p2) / np.maximum(1 - p1, 1e-4))
            good = (gain > _WORTH) & (times > 0) & (p2 > p1)
            guess[first[good]] = follow[good]
            kind[first[good]] = 1 + np.abs(p2[good][:, None] - _CLASSES[1:]).argmin(axis=1)
        entry = np.append(np.int32(0), entry) if len(x) else entry
        return cls(known.astype(np.int64), f0, rows, succ, f1, guess, kind), x, entry

    def pack(self) -> bytes:
        n = len(self.ids)
        start = self.end[self.state_id[: self.pairs]] - self.rows[self.state_id[: self.pairs]]
        guess = np.where(self.guess[: self.pairs] < 0, 0, self.guess[: self.pairs] - start + 1)
        deltas = lambda v: np.diff(v, prepend=0)
        parts = [deltas(self.ids), self.f0, self.rows, deltas(self.succ_of), self.f1, guess, self.kind[: self.pairs]]
        out = []
        for part in parts:  # byte planes, as most values are small
            planes = np.ascontiguousarray((part.astype(np.int64) << 1 ^ part.astype(np.int64) >> 63).astype("<u8").view(np.uint8).reshape(len(part), 8).T)
            deep = 8 - int((planes.any(axis=1)[::-1]).argmax()) if planes.any() else 1
            out.append(struct.pack("<QB", len(part), deep) + planes[:deep].tobytes())
        return zlib.compress(b"".join(out), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Prior:
        raw, at, parts = zlib.decompress(data), 0, []
        for _ in range(7):
            n, deep = struct.unpack_from("<QB", raw, at)
            planes = np.zeros((8, n), np.uint8)
            planes[:deep] = np.frombuffer(raw, np.uint8, n * deep, at + 9).reshape(deep, n)
            value = np.ascontiguousarray(planes.T).view("<u8").reshape(n).astype(np.int64)
            parts.append(value >> 1 ^ -(value & 1))
            at += 9 + n * deep
        ids, f0, rows, succ, f1, guess, kind = parts
        ids, succ = np.cumsum(ids), np.cumsum(succ)
        end = np.cumsum(rows)
        own = np.where(succ == len(ids), 0, succ)
        guess = np.where(guess == 0, -1, guess - 1 + end[own] - rows[own])
        return cls(ids, f0, rows, succ, f1, guess, kind)


class _Writer:
    """Range coder of many lanes with 64-bit bounds; it gives out 32 bits at a time, and a carry goes back into them."""

    def __init__(self, lanes: int, length: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
        self.width = length * 2 + 4
        self.out, self.at = np.zeros(lanes * self.width, "<u4"), np.arange(lanes) * self.width
        self.begin = self.at.copy()

    def add(self, lanes, n: int, up: np.ndarray, wide: np.ndarray) -> None:
        """Move the lower bounds up and set the ranges; lanes: None for the first n, or distinct ones."""
        low = (self.low[:n] if lanes is None else self.low[lanes]) + up
        over = np.flatnonzero(low < up)
        if len(over):
            at = self.at[over if lanes is None else lanes[over]] - 1
            while len(at):
                self.out[at] += np.uint32(1)
                at = at[self.out[at] == 0] - 1
        move = np.flatnonzero(wide < _U(1 << 32))
        if len(move):
            own = move if lanes is None else lanes[move]
            at, moved = self.at[own], low[move]
            self.out[at] = moved >> _U(32)
            self.at[own] = at + 1
            low[move] = moved << _U(32)
            wide[move] <<= _U(32)
        if lanes is None:
            self.low[:n], self.range[:n] = low, wide
        else:
            self.low[lanes], self.range[lanes] = low, wide

    def close(self) -> list[bytes]:
        for k in (32, 0):
            self.out[self.at] = self.low >> _U(k) & _U(0xFFFFFFFF)
            self.at += 1
        return [self.out[a:b].tobytes() for a, b in zip(self.begin.tolist(), self.at.tolist())]


class _Reader:
    def __init__(self, codes: list[bytes]):
        size = [len(c) // 4 for c in codes]
        self.data = np.concatenate([np.frombuffer(b"".join(codes), "<u4"), np.zeros(4, "<u4")]).astype(_U)
        begin = np.append(0, np.cumsum(size))[:-1].astype(np.int64)
        self.range = np.full(len(codes), 2**64 - 1, _U)
        self.over = self.data[begin] << _U(32) | self.data[begin + 1]  # of the code over the lower bound
        self.at = begin + 2

    def settle(self, lanes, n: int, over: np.ndarray, wide: np.ndarray) -> None:
        move = np.flatnonzero(wide < _U(1 << 32))
        if len(move):
            own = move if lanes is None else lanes[move]
            at = self.at[own]
            over[move] = over[move] << _U(32) | self.data[at]
            wide[move] <<= _U(32)
            self.at[own] = at + 1
        if lanes is None:
            self.over[:n], self.range[:n] = over, wide
        else:
            self.over[lanes], self.range[lanes] = over, wide


class _Mixer:
    """The chance that the guess is right; the same updates follow from coding and from decoding."""

    def __init__(self, lanes: int):
        self.rates = np.tile(_RATES, lanes)
        self.lane = np.arange(lanes) * len(_RATES)
        self.weights = [np.full(lanes, 24000, np.int32) for _ in range(3)]  # in 1/65536

    def chance(self, n: int, mix: np.ndarray) -> np.ndarray:
        """In 1/4096; 0 where there is no guess (kind 0)."""
        kind = mix & 255
        in1, in0 = (((mix >> k) & 4095).astype(np.int32) - np.int32(2048) for k in (8, 20))
        self.cell = self.lane[:n] + kind
        self.some = kind > 0
        self.rate = self.rates[self.cell]
        self.inputs = (_STRETCH[self.rate], in1, in0)
        mixed = self.weights[0][:n] * self.inputs[0]
        mixed += self.weights[1][:n] * in1
        mixed += self.weights[2][:n] * in0
        mixed >>= 16
        mixed += 2048
        np.maximum(mixed, 0, out=mixed)
        np.minimum(mixed, 4095, out=mixed)
        self.p = _SQUASH[mixed]
        self.p *= self.some
        return self.p

    def learn(self, n: int, hit: np.ndarray) -> None:
        goal = hit * np.int32(4095)
        error = goal - self.p  # without a guess the inputs are 0, and so are the updates
        for weight, own in zip(self.weights, self.inputs):
            step = own * error
            step >>= 10
            weight[:n] += step
        goal -= self.rate
        goal >>= 5
        goal *= self.some
        self.rates[self.cell] = self.rate + goal


def _groups(blocks: int) -> list[tuple[int, int]]:
    """Ranges of blocks that are coded in step, of about equal size."""
    count = -(-blocks // LANES)
    edges = [blocks * k // count for k in range(count + 1)] if count else [0]
    return list(zip(edges[:-1], edges[1:]))


def encode_blocks(prior: Prior, x: np.ndarray, entry: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(ids, crc32, code) of each block; x: places of the ids in ``prior.ids``, entry: those that code them."""
    out = []
    below0, f0, guess = prior.below0.astype(_U), prior.f0.astype(_U), prior.guess.astype(np.int32)
    for first, end in _groups(-(-len(x) // BLOCK)):
        part, own = x[first * BLOCK : end * BLOCK], entry[first * BLOCK : end * BLOCK]
        lanes, length = end - first, min(BLOCK, len(part))
        last = len(part) - (lanes - 1) * BLOCK

        def grid(values, kind):
            whole = np.zeros(lanes * BLOCK, kind)
            whole[: len(part)] = values
            return np.ascontiguousarray(whole.reshape(lanes, BLOCK).T)

        owns = grid(own, np.int32)
        states = grid(np.where(prior.escape[own], prior.pairs + part, own), np.int32)
        states[0] = prior.pairs + part[::BLOCK]
        writer, mixer = _Writer(lanes, length), _Mixer(lanes)
        for t in range(length):
            n = lanes if t < last else lanes - 1
            state = states[t, :n]
            if t:
                before, now = states[t - 1, :n], owns[t, :n]
                hit = guess[before] == now
                p = mixer.chance(n, prior.mix[before])
                wide = writer.range[:n]
                edge = wide >> _U(_CHANCE)
                edge *= p.astype(_U)
                step = wide - edge
                step >>= _U(_ROW)
                share = prior.share[now]
                up = share & _U((1 << _ROW) - 1)
                up *= step
                up += edge
                up *= ~hit
                share >>= _U(20)
                step *= share
                np.copyto(step, edge, where=hit)
                writer.add(None, n, up, step)
                mixer.learn(n, hit)
                alone = np.flatnonzero(state >= prior.pairs)
            else:
                alone = np.arange(n)
            if len(alone):
                value = state[alone] - prior.pairs
                step = writer.range[alone] >> _U(prior.bits)
                writer.add(alone, n, below0[value] * step, f0[value] * step)
        size = [BLOCK] * (lanes - 1) + [last]
        ids = prior.ids[part].astype("<u4")
        for k, code in enumerate(writer.close()):
            out.append((size[k], zlib.crc32(ids[k * BLOCK : k * BLOCK + size[k]].tobytes()), code))
    return out


def decode_blocks(prior: Prior, blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Ids of the blocks, checked against their sums; only the last block may be short."""
    out = [np.zeros(0, np.uint32)]
    pairs, below0, f0 = prior.pairs, prior.below0.astype(_U), prior.f0.astype(_U)
    for first, end in _groups(len(blocks)):
        part = blocks[first:end]
        lanes, sizes = len(part), [x[0] for x in part]
        grid = np.zeros((max(sizes), lanes), np.int32)
        reader, mixer, last = _Reader([x[2] for x in part]), _Mixer(lanes), sizes[-1]
        state = np.zeros(lanes, np.int64)
        for t in range(max(sizes)):
            n = lanes if t < last else lanes - 1
            if t:
                now = state[:n]
                mix = prior.mix[now]
                p = mixer.chance(n, mix)
                over, wide = reader.over[:n], reader.range[:n]
                edge = wide >> _U(_CHANCE)
                edge *= p.astype(_U)
                hit = over < edge
                mixer.learn(n, hit)
                # what isn't the guess; lanes that have it are put right after
                rest = over - edge
                step = wide - edge
                step >>= _U(_ROW)
                slot = rest // step
                np.minimum(slot, _U((1 << _ROW) - 1), out=slot)
                key = mix >> 32
                key <<= _ROW
                key |= slot.view(np.int64)
                entry = prior.entry_at(key)
                share = prior.share[entry]
                rest -= (share & _U((1 << _ROW) - 1)) * step
                share >>= _U(20)
                step *= share
                np.copyto(rest, over, where=hit)
                np.copyto(step, edge, where=hit)
                escaped = prior.escape[entry]
                escaped &= ~hit
                np.copyto(entry, prior.guess[now], where=hit)
                alone = np.flatnonzero(escaped)
                reader.settle(None, n, rest, step)
                state[:n] = entry
            else:
                alone = np.arange(n)
            if len(alone):
                step = reader.range[alone] >> _U(prior.bits)
                over = reader.over[alone]
                slot = np.minimum(over // step, _U((1 << prior.bits) - 1)).view(np.int64)
                value = prior.id_at(slot)
                reader.settle(alone, n, over - below0[value] * step, f0[value] * step)
                state[alone] = pairs + value
            grid[t, :n] = state[:n]
        ids = prior.ids.astype("<u4")[prior.state_id[grid]]
        for k, (size, crc, _) in enumerate(part):
            own = np.ascontiguousarray(ids[:size, k])
            if zlib.crc32(own.tobytes()) != crc:
                raise ValueError(f"block {first + k} does not match its checksum")
            out.append(own)
    return np.concatenate(out)


def pack(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of documents: which, how many ids each has, and the ids."""
    prior, x, entry = Prior.learn(ids.astype(np.uint32, copy=False))
    blocks = encode_blocks(prior, x, entry)
    table = zlib.compress(np.stack([doc_ids.astype("<i8"), sizes.astype("<i8")]).tobytes(), 6)
    start = prior.pack()
    heads = b"".join(struct.pack("<III", n, len(code), crc) for n, crc, code in blocks)
    index, codes = b"".join([table, start, heads]), b"".join(code for *_, code in blocks)
    return b"".join([MAGIC, struct.pack("<5Q", len(doc_ids), len(table), len(start), len(blocks), len(codes)), struct.pack("<I", zlib.crc32(index)), index, codes])


def unpack(stream) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The next segment of a stream (or of bytes); None at the end mark."""
    take = io.BytesIO(stream).read if isinstance(stream, bytes) else stream.read
    magic = take(8)
    if magic == END:
        return None
    if magic != MAGIC:
        raise ValueError("not a segment of token ids, or the file breaks off")
    n, size, prior, count, length = struct.unpack("<5Q", take(40))
    (crc,) = struct.unpack("<I", take(4))
    index = take(size + prior + 12 * count)
    if zlib.crc32(index) != crc:
        raise ValueError("a segment's index does not match its checksum")
    docs = np.frombuffer(zlib.decompress(index[:size]), "<i8").reshape(2, n)
    heads = [struct.unpack_from("<III", index, size + prior + 12 * k) for k in range(count)]
    codes, at, blocks = take(length), 0, []
    for n_ids, own, sum_ in heads:
        blocks.append((n_ids, sum_, codes[at : at + own]))
        at += own
    return docs[0], docs[1], decode_blocks(Prior.unpack(index[size : size + prior]), blocks)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Pieces of ASCII as the vocabulary's own pattern cuts them, after lower case.
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")
#: Letters of one code point whose lower case and composed form are of one code point too.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(r"[\t\n\r!-~]*")
TOGETHER = 256  # words of one call of the library
REMEMBERED = 1 << 20


@lru_cache(maxsize=2)
def _ends(path: str) -> np.ndarray:
    """Which ids end a word, if the vocabulary marks them."""
    own = _tokenizer(path)
    names = [own.id_to_token(k) or "" for k in range(own.get_vocab_size())]
    return np.array([x.endswith("</w>") for x in names], bool)


def _library(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every string as the library gives them on its own, and where each begins (n + 1)."""
    size, parts = [], [np.zeros(0, np.int32)]
    for k in range(0, len(words), 1 << 16):
        encoded = [x.ids for x in _tokenizer(path).encode_batch_fast(words[k : k + (1 << 16)], add_special_tokens=False)]
        size += map(len, encoded)
        parts.append(np.fromiter((i for x in encoded for i in x), np.int32))
    return np.concatenate(parts), np.append(0, np.cumsum(size)).astype(np.int64)


class _Words:
    """Ids of words that the vocabulary's pattern takes whole, each asked of the library once: TOGETHER in a call,
    told apart by the ids that end a word. A worker keeps up to REMEMBERED words
    that came more than once for its next texts."""

    def __init__(self, path: str):
        self.path, self.ends = path, _ends(path)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        parts, stops, n = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        for k in range(0, len(groups), 1 << 8):
            texts = [" ".join(g) for g in groups[k : k + (1 << 8)]]
            for group, x in zip(groups[k : k + (1 << 8)], _tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(x.ids, np.int32)
                at = np.flatnonzero(self.ends[ids]) + 1
                if len(at) != len(group) or (len(at) and at[-1] != len(ids)):
                    ids, at = _library(group, self.path)
                    at = at[1:]
                parts.append(ids)
                stops.append(at + n)
                n += len(ids)
        return np.concatenate(parts), np.concatenate(stops)

    def __call__(self, words: list[str], often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and where each begins (n + 1); often: which may come again."""
        get = self.number.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        keep = new[often[new]]
        if len(self.number) + len(keep) > REMEMBERED:
            self.forget()
            at[:], new = -1, np.arange(len(words))
            keep = new[often[new]][:REMEMBERED]
        rest = np.setdiff1d(new, keep, assume_unique=True)
        known = len(self.starts) - 1
        at[keep] = known + np.arange(len(keep))
        at[rest] = known + len(keep) + np.arange(len(rest))
        ids, starts = self.ask([words[k] for k in keep.tolist()])
        self.number.update(zip([words[k] for k in keep.tolist()], range(known, known + len(keep))))
        self.ids, self.starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, self.starts[-1] + starts[1:]])
        ids, starts = self.ask([words[k] for k in rest.tolist()])
        return pieces.spread(at, np.concatenate([self.starts, self.starts[-1] + starts[1:]]), np.concatenate([self.ids, ids]))


_words = lru_cache(maxsize=1)(_Words)


def tokenize(texts: list[str | None] | pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with the end id, and where each begins (n + 1).

    The vocabulary drops white space, so a text is encoded piece by piece between spaces, each distinct piece
    once; pieces of Latin-1 letters and ASCII are cut into words as the vocabulary cuts them, and each distinct word is encoded once.
    """
    column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
    split = pc.split_pattern(column.cast(pa.large_string()), " ")
    own = split.flatten().dictionary_encode()
    known, codes = own.dictionary, own.indices.to_numpy()
    count = np.diff(split.offsets.to_numpy())
    del split, own
    n = len(known)
    two = pc.extract_regex(known, rf"^(?P<a>[{_LETTERS}]+)(?P<b>[!-/:-@\[-`{{-~]*)$")
    simple = two.is_valid().to_numpy(zero_copy_only=False) if n else np.zeros(0, bool)
    two = two.filter(pa.array(simple))
    first, second = pc.utf8_lower(two.field("a")), two.field("b")
    pair = np.flatnonzero(pc.greater(pc.binary_length(second), 0).to_numpy(zero_copy_only=False)) if len(two) else np.zeros(0, np.int64)
    other = known.filter(pa.array(~simple)).to_pylist()
    cut, size, whole = [], np.zeros(len(other), np.int64), []
    for k, x in enumerate(other):
        if "<|" not in x and _PLAIN.fullmatch(x):
            parts = _CUT.findall(x.lower())
            cut += parts
            size[k] = len(parts)
        elif x:
            whole.append(k)
    words = pa.concat_arrays([first, second.take(pa.array(pair)), pa.array(cut, pa.large_string())]).dictionary_encode()
    number = words.indices.to_numpy()
    times = np.bincount(codes, minlength=n)
    times = np.concatenate([times[simple], times[simple][pair], np.repeat(times[~simple], size)])
    ids, starts = _words(path)(words.dictionary.to_pylist(), np.bincount(number, times, len(words.dictionary)) > 1)
    # the words of every piece: pieces that the library cuts itself are words of their own, after all others
    more, at = _library([other[k] for k in whole], path)
    base = len(starts) - 1
    ids, starts = np.concatenate([ids, more, np.array([end_id], np.int32)]), np.concatenate([starts, starts[-1] + at[1:], [starts[-1] + at[-1] + 1]])
    size[whole] = 1
    n_words = np.ones(n, np.int64)
    where = np.flatnonzero(simple)
    n_words[where[pair]] = 2
    n_words[~simple] = size
    begin = np.append(0, np.cumsum(n_words))
    piece = np.empty(begin[-1], np.int64)
    piece[begin[:-1][where]] = number[: len(first)]
    piece[begin[:-1][where[pair]] + 1] = number[len(first) : len(first) + len(pair)]
    rest = np.repeat(~simple, n_words)
    cut_own = np.ones(int(size.sum()), bool)
    cut_own[(np.append(0, np.cumsum(size))[:-1])[whole]] = False
    inner = np.empty(len(cut_own), np.int64)
    inner[cut_own] = number[len(first) + len(pair) :]
    inner[~cut_own] = base + np.arange(len(whole))
    piece[rest] = inner
    piece = np.append(piece, base + len(whole))  # the last piece is the end id
    ids, starts = pieces.spread(piece, starts, ids)
    starts = starts[np.append(begin, len(piece))]
    ends = np.append(0, np.cumsum(count + 1))
    rows = np.full(ends[-1], n, np.int32)
    inside = np.ones(len(rows), bool)
    inside[ends[1:] - 1] = False
    rows[inside] = codes
    ids, at = pieces.spread(rows, starts, ids)
    return ids, at[ends]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")


def write(documents: DataFrame, folder: str, path: str, end_id: int = 1) -> list[tuple[str, int]]:
    """Write the ids of all documents in ascending doc_id order; (name, ids) of each file, in order."""

    def store(batches):
        from pyspark import TaskContext

        def steps():
            """(doc ids, sizes, ids) of some STEP bytes of text at a time."""
            held, room = [], 0
            for batch in batches:
                _, offsets = common.utf8(batch.column("text"))
                for a, b in common.spans(offsets, STEP):
                    held.append(batch.slice(a, b - a))
                    room += int(offsets[b] - offsets[a])
                    if room >= STEP // 2:
                        yield from segment(held)
                        held, room = [], 0
            if held:
                yield from segment(held)

        def segment(held):
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, at = tokenize(rows.column("text").chunk(0), path, end_id)
            yield rows.column("doc_id").chunk(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False), np.diff(at), ids

        out, count, total = None, 0, 0
        for doc_ids, sizes, ids in steps():
            if out is None:
                context = TaskContext.get()
                name = f"part-{context.partitionId():06d}.ids"
                system, root = _open(folder)
                system.create_dir(root, recursive=True)
                draft = f"{root}/{name}.{context.taskAttemptId()}"
                out = system.open_output_stream(draft)
            out.write(pack(doc_ids, sizes, ids))
            count, total = count + 1, total + len(ids)
        if out is not None:
            out.write(END + struct.pack("<Q", count))
            out.close()
            system.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total], pa.int64())], ["name", "ids"])

    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(max(spark.sparkContext.defaultParallelism, sized // FILE_BYTES))
    ranged = docs.repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id")
    return sorted((r["name"], r["ids"]) for r in ranged.mapInArrow(store, "name string, ids long").collect())


def read(spark: SparkSession, folder: str, files: list[tuple[str, int]], digest) -> DataFrame:
    """digest(doc ids, ids before, sizes, ids) of every segment, as (doc_id, start, n_tokens, ids_crc32)."""
    before = np.append(0, np.cumsum([n for _, n in files])).tolist()

    def load(batches):
        system, root = _open(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist()):
                with system.open_input_stream(f"{root}/{name}") as data:
                    count = 0
                    while (found := unpack(data)) is not None:
                        yield digest(found[0], start, *found[1:])
                        start, count = start + len(found[2]), count + 1
                    if struct.unpack("<Q", data.read(8))[0] != count:
                        raise ValueError(f"{name} lacks segments")

    names = spark.createDataFrame([(name, start) for (name, _), start in zip(files, before)], "name string, before long").repartition(max(1, len(files)), "name")
    return names.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digest(docs: np.ndarray, before: int, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    ends = np.append(0, np.cumsum(sizes))
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == -(2**63)), pa.array(ends[:-1] + before), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(documents: DataFrame, path: str, folder: str | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the files that :func:`write` writes; without a folder they go after that."""
    spark = documents.sparkSession
    own = f"{common.shared_folder(spark)}/ids-{uuid.uuid4().hex}" if folder is None else folder
    files = write(documents, own, path, end_id)
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = read(spark, own, files, _digest)
    if folder is None:  # nobody else knows of these files
        found = common.durable(found)
        system, root = _open(own)
        system.delete_dir(root)
    return found


def op4_rangecoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
