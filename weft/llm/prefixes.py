"""Operator 5, token counts by prefix dynamic programming.

A prefix's encoding is that of a shorter prefix and one token more: the token that ends there and whose
boundary with the last token of the shorter prefix no merge would cross. So one pass over a word's bytes
stores the last token and the token count at every prefix, and questions of truncation and budget are
answered from the counts. Whether a boundary holds is told from the edges of both tokens' merge trees,
followed upwards in rank order; answers are kept in a table.

Scale: a map over documents; no shuffle. Distinct words of a batch are counted once, all in step.

Defined cases: a null or empty text has no tokens; special strings in a text are one token each, as the
library's default has it; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pieces

LIMIT = 1024
FAR = np.iinfo(np.int32).max
_SLOTS = 1 << 20
_B = np.uint64(0xC6A4A7935BD1E995)


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as text:
            spec = json.load(text)
        letters = _byte_letters()
        plain = lambda token: bytes(letters[c] for c in token)
        ids = spec["model"]["vocab"]
        added = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.sign = os.path.commonprefix(added)[:1]  # what all of them begin with, maybe nothing
        names = sorted((t for t in ids if t not in added), key=ids.get)
        self.names = [plain(t) for t in names]
        number = {t: k for k, t in enumerate(names)}
        n = len(names)
        pairs, left, right, rank = {}, np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made = number.get(a + b)
            if made is None or a not in number or b not in number:
                continue
            pairs[number[a] << 32 | number[b]] = r
            if rank[made] < 0:
                left[made], right[made], rank[made] = number[a], number[b], r
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        # edges of the merge trees, from the single byte up: token, and the rank at which it came to be
        self.right_edge, self.left_edge = self._edges(right, rank), self._edges(left, rank)
        self.size = np.array([len(x) for x in self.names])
        self.longest = int(self.size.max())
        # tokens by hash, length by length; a token that merges can't make is never used
        made = (self.size == 1) | (rank >= 0)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.sieve = np.zeros(1 << 22, bool)
        for size in np.unique(self.size[made]).tolist():
            own = np.flatnonzero(made & (self.size == size))
            data = np.frombuffer(b"".join(self.names[k] for k in own.tolist()), np.uint8).reshape(-1, size)
            hashes = np.zeros(len(own), np.uint64)
            for k in range(size):
                hashes = hashes * _B + (data[:, k].astype(np.uint64) + np.uint64(1))
            hashes = common.mix(hashes + np.uint64(size))
            order = np.argsort(hashes)
            self.by_size[size] = hashes[order], own[order].astype(np.int32)
            self.sieve[hashes >> np.uint64(42)] = True
        self.slots = np.full(_SLOTS, -1, np.int64)
        self.answers = np.zeros(_SLOTS, bool)
        self.splitter = pieces.Splitter(_matched)
        # a token made by merges of its parts alone: else the boundary test wouldn't tell
        self.alone = np.ones(n, bool)
        own = np.flatnonzero(rank >= 0)
        self.alone[own] = self._boundary(left[own], right[own], rank[own])

    def _edges(self, part: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        depth = np.zeros(len(part), np.int64)
        chain = [np.arange(len(part))]
        while True:
            below = np.where(chain[-1] >= 0, part[np.maximum(chain[-1], 0)], -1)
            if (below < 0).all():
                break
            depth += below >= 0
            chain.append(below)
        top = len(chain)
        down = np.stack(chain, axis=1)
        # column k: k steps above the single byte; beyond the token itself nothing comes (FAR)
        tokens = np.full((len(part), top), -1, np.int32)
        ranks = np.full((len(part), top + 1), FAR, np.int32)
        for k in range(top):
            at = depth - k
            own = np.flatnonzero(at >= 0)
            tokens[own, k] = down[own, at[own]]
            ranks[own, k] = rank[tokens[own, k]]
        return tokens, ranks

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], FAR)

    def _boundary(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge (of a rank below ``until``) crosses the boundary of tokens a and b."""
        (ta, ra), (tb, rb) = self.right_edge, self.left_edge
        out = np.ones(len(a), bool)
        todo = np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(todo):
            x, y = a[todo], b[todo]
            across = self.pair(ta[x, i], tb[y, j])
            if until is not None:
                across = np.where(across < until[todo], across, FAR)
            na, nb = ra[x, i + 1], rb[y, j + 1]
            broken = (across < na) & (across <= nb) & (across != FAR)
            out[todo[broken]] = False
            done = broken | ((na == FAR) & (nb == FAR))
            up = na <= nb
            i, j = (i + (up & (na != FAR)))[~done], (j + ~up)[~done]
            todo = todo[~done]
        return out

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        slot = (common.mix(key.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
        known = self.slots[slot] == key
        out = self.answers[slot]
        miss = np.flatnonzero(~known)
        if len(miss):
            answer = self._boundary(a[miss], b[miss])
            self.slots[slot[miss]] = key[miss]
            out[miss] = answer
            # of several keys for a slot the last one stays; its answer goes with it
            self.answers[slot[miss]] = answer
            stale = self.slots[slot[miss]] != key[miss]
            if stale.any():
                keep = ~stale
                self.answers[slot[miss[keep]]] = answer[keep]
        return out

    def prefixes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token count of every prefix of every word (from one byte on), and where each word begins (n + 1)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        begin = np.append(0, np.cumsum(size)).astype(np.int64)
        n = len(data)
        place = np.arange(n) - np.repeat(begin[:-1], size)
        ends, tokens = [], []
        codes = data.astype(np.uint64) + np.uint64(1)
        at, rolled = np.arange(n), np.zeros(n, np.uint64)
        for length in range(1, min(self.longest, int(size.max(initial=0))) + 1):
            # rolled: polynomial of the ``length`` bytes that end at each place which has as many in its word
            fits = place[at] >= length - 1
            if not fits.all():
                at, rolled = at[fits], rolled[fits]
            rolled = rolled + codes[at - length + 1] * np.uint64(pow(int(_B), length - 1, 1 << 64))
            if length not in self.by_size:
                continue
            hashes = common.mix(rolled + np.uint64(length))
            some = np.flatnonzero(self.sieve[hashes >> np.uint64(42)])
            table, own = self.by_size[length]
            k = np.minimum(np.searchsorted(table, hashes[some]), len(table) - 1)
            hit = table[k] == hashes[some]
            ends.append(at[some[hit]])
            tokens.append(own[k[hit]])
        if not n:
            return np.zeros(0, np.int32), begin
        end, token = np.concatenate(ends), np.concatenate(tokens)
        order = np.argsort(place[end], kind="stable")  # prefix by prefix
        end, token = end[order], token[order]
        column = place[end]
        cuts = np.append(np.flatnonzero(np.append(True, column[1:] != column[:-1])), len(end))
        last, count = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at, new = end[a:b], token[a:b]
            long = self.size[new]
            whole = long == place[at] + 1
            before = at - long
            prev = np.where(whole, -1, last[before])
            fine = whole & self.alone[new]
            ask = np.flatnonzero(~whole & (prev >= 0) & self.alone[new])
            fine[ask] = self.holds(prev[ask], new[ask])
            at, new, before, whole = at[fine], new[fine], before[fine], whole[fine]
            last[at] = new
            count[at] = np.where(whole, 0, count[before]) + 1
        return count, begin

    def texts(self, texts: list[str]) -> np.ndarray:
        """Token counts of texts without special strings."""
        pattern = self.splitter.pattern(texts)
        parts, codes, first = pieces.vocabulary(texts, pattern)
        words, of_piece, piece_starts = pieces.split(parts, pattern)
        counts, begin = self.prefixes([w.encode() for w in words])
        own = counts[begin[1:] - 1].astype(np.int64)
        by_piece = np.append(0, np.cumsum(own[of_piece]))[piece_starts]
        return np.diff(np.append(0, np.cumsum(np.diff(by_piece)[codes]))[first])

    def count(self, texts: list[str]) -> np.ndarray:
        """Token counts; special strings count one each."""
        out = np.zeros(len(texts), np.int64)
        flat, owner = [], []
        for k, text in enumerate(texts):
            if self.special is not None and self.sign in text and self.special.search(text):
                between = self.special.split(text)
                out[k] = len(between) - 1
                flat += between
                owner += [k] * len(between)
            else:
                flat.append(text)
                owner.append(k)
        np.add.at(out, np.array(owner, np.int64), self.texts(flat))
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count at every byte prefix of one text (0 first), special strings as one token at their end.

        A prefix that ends in white space or in a special string is counted by the words of the whole text.
        """
        out, total = [np.zeros(1, np.int64)], 0
        ends = [m.span() for m in self.special.finditer(text)] if self.special is not None else []
        at = 0
        for a, b in [*ends, (len(text), len(text))]:
            words = self.splitter.pattern([text]).findall(text[at:a])
            counts, begin = self.prefixes([w.encode() for w in words])
            for x, y in zip(begin[:-1], begin[1:]):
                out.append(total + counts[x:y])
                total += int(counts[y - 1])
            if b > a:
                out.append(np.full(len(text[a:b].encode()), total))
                total += 1
                out[-1][-1] = total
            at = b
        return np.concatenate(out)


def _matched(pattern: str) -> str:
    from tokenizers import Regex, pre_tokenizers

    return "".join(x for x, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(pieces._ALL))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""

    def run(batches):
        own = vocabulary(path)
        for batch in batches:
            size = np.diff(common.utf8(batch.column("text"))[1])
            for first, texts in pieces.text_steps(batch.column("text").to_pylist()):
                n = own.count(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(size[first : first + len(texts)]), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def budget(documents: DataFrame, path: str, tokens: int) -> DataFrame:
    """(doc_id, n_bytes): the bytes of the longest prefix, at a character's end, that has at most ``tokens`` tokens."""

    def run(batches):
        own = vocabulary(path)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                counts_ = own.prefix_counts(text or "")
                raw = np.frombuffer((text or "").encode() + b"a", np.uint8)
                fits = np.flatnonzero((counts_ <= tokens) & ((raw & 0xC0) != 0x80))
                out.append(int(fits[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.int64())], ["doc_id", "n_bytes"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long")


def op5_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
