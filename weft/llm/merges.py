"""Operator 6, byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a batch of documents are one corpus of symbols. An inverted index from token pair
to the places where it stands applies the merges to all words at once, lowest rank first; each merge
rewrites its places and only the pairs with their neighbours, which enter the index under their own rank.

Scale: a map over documents; no shuffle. A batch's vocabulary is bounded by the batch.

Defined cases: a null or empty text has no ids (and decodes to no bytes); special strings are ordinary
text; the vocabulary's path is a parameter; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pieces

NONE = np.iinfo(np.int32).max
STEP = 6 << 20  # characters whose words are replayed together


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Ranks:
    """Ids by bytes, and which token every mergeable pair makes."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {b: a for a, b in self.ids.items()}
        single = np.zeros(256, np.int32)
        for k in range(256):
            single[k] = self.ids[bytes([k])]
        self.single = single
        pairs = {}
        for token, made in self.ids.items():
            for cut in range(1, len(token)):
                left = self.ids.get(token[:cut])
                if left is not None and (right := self.ids.get(token[cut:])) is not None:
                    pairs[left << 32 | right] = made
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.splitter = pieces.Splitter(self._matched)

    @staticmethod
    def _matched(pattern: str) -> str:
        """Characters that the tiktoken library's own regular expressions find."""
        import tiktoken

        own = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
        return bytes(own.encode_ordinary(pieces._ALL)).decode()

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Token that each pair makes, which is also its rank; NONE where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def one(self, word: bytes) -> list[int]:
        """Ids of one word by its own merges: the lowest rank first, the leftmost of equals."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[k] + parts[k + 1], NONE), k) for k in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[x] for x in parts]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each begins (n + 1)."""
        n = len(words)
        whole = np.array([self.ids.get(w, -1) for w in words], np.int64)
        loose = np.flatnonzero(whole < 0)
        ids, starts = self._replay([words[k] for k in loose.tolist()])
        size = np.ones(n, np.int64)
        size[loose] = np.diff(starts)
        ends = np.append(0, np.cumsum(size))
        out = np.empty(ends[-1], np.int32)
        out[ends[:-1][whole >= 0]] = whole[whole >= 0]
        at = np.repeat(ends[:-1][loose] - starts[:-1], size[loose]) + np.arange(len(ids))
        out[at] = ids
        return out, ends

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        begin = np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(begin))
        token = self.single[data]
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        rank = np.full(n, NONE, np.int32)
        if n > 1:
            inner = word[1:] == word[:-1]
            rank[:-1][inner] = self.pair(token[:-1][inner], token[1:][inner])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def file(at: np.ndarray, own: np.ndarray) -> None:
            order = np.argsort(own, kind="stable")
            at, own = at[order], own[order]
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for r, group in zip(own[cuts].tolist(), np.split(at, cuts[1:])):
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(queue, r)

        start = np.flatnonzero(rank != NONE)
        if len(start):
            file(start, rank[start])
        again: set[int] = set()
        while queue:
            r = heapq.heappop(queue)
            groups = index.pop(r)
            at = groups[0] if len(groups) == 1 else _distinct(np.concatenate(groups))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                # of places that overlap, the leftmost goes first
                chained = np.append(False, after[at[:-1]] == at[1:])
                if chained.any():
                    place = np.arange(len(at))
                    run = place - np.maximum.accumulate(np.where(chained, 0, place))
                    at = at[run % 2 == 0]
            gone = after[at]
            follow = after[gone]
            token[at] = r
            after[at] = follow
            alive[gone] = False
            rank[gone] = NONE
            inside = follow < n
            before[follow[inside]] = at[inside]
            left = before[at]
            left = left[(left >= 0)]
            touched = _distinct(np.concatenate([left, at]))
            right = after[touched]
            fine = right < n
            fine[fine] = word[right[fine]] == word[touched[fine]]
            rank[touched[~fine]] = NONE
            touched, right = touched[fine], right[fine]
            new = self.pair(token[touched], token[right])
            rank[touched] = new
            some = new != NONE
            touched, new = touched[some], new[some]
            if len(touched):
                file(touched, new)
                early = new < r
                if early.any():  # a merge of lower rank has come up late: where its word had several places, their order mattered
                    own, n_places = np.unique(word[at], return_counts=True)
                    again.update(np.intersect1d(word[touched[early]], own[n_places > 1]).tolist())
        ids = token[alive]
        starts = np.append(0, np.cumsum(np.bincount(word[alive], minlength=len(words)))).astype(np.int64)
        if again:
            rows = [ids[starts[k] : starts[k + 1]] for k in range(len(words))]
            for k in again:
                rows[k] = np.array(self.one(words[k]), np.int32)
            ids, starts = np.concatenate(rows), np.append(0, np.cumsum([len(x) for x in rows]))
        return ids, starts

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text begins (n + 1)."""
        pattern = self.splitter.pattern(texts)
        parts, codes, first = pieces.vocabulary(texts, pattern)
        words, of_piece, piece_starts = pieces.split(parts, pattern)
        ids, starts = self.encode([w.encode() for w in words])
        ids, ends = pieces.spread(of_piece, starts, ids)
        ids, ends = pieces.spread(codes, ends[piece_starts], ids)
        return ids, ends[first]

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens by id, and where each begins."""
        if not hasattr(self, "_table"):
            ordered = [self.bytes.get(k, b"") for k in range(max(self.bytes) + 1)]
            self._table = np.frombuffer(b"".join(ordered), np.uint8), np.append(0, np.cumsum([len(x) for x in ordered])).astype(np.int64)
        return self._table

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each text begins (n + 1)."""
        data, starts = self.table
        out, ends = pieces.spread(ids.astype(np.int64), starts, data)
        return out, ends[first]


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode(documents: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``keep``, n_tokens and token_ids of every document."""

    def run(batches):
        own = ranks(path)
        for batch in batches:
            for first, texts in pieces.text_steps(batch.column("text").to_pylist(), STEP):
                ids, starts = own.texts(texts)
                rows = batch.slice(first, len(texts))
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", *keep)), pa.array(np.diff(starts)), lists], ["doc_id", *keep, "n_tokens", "token_ids"])

    columns = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return documents.select("doc_id", "text", *keep).mapInArrow(run, f"{columns}, n_tokens long, token_ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes of rows with token_ids; null ids decode to no bytes."""

    def run(batches):
        own = ranks(path)
        for batch in batches:
            lists = batch.column("token_ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            data, at = own.decode(ids, np.append(0, np.cumsum(size)))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded binary")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256."""

    def run(batches):
        own = ranks(path)
        decimal = [str(k) for k in range(max(own.bytes) + 1)]
        for batch in batches:
            for first, texts in pieces.text_steps(batch.column("text").to_pylist(), STEP):
                ids, starts = own.texts(texts)
                data, at = own.decode(ids, starts)
                raw = data.tobytes()
                names = list(map(decimal.__getitem__, ids.tolist()))
                a, b = starts[:-1].tolist(), starts[1:].tolist()
                id_sha = [hashlib.sha256(",".join(names[x:y]).encode()).hexdigest() for x, y in zip(a, b)]
                sha = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(np.diff(starts)), pa.array(id_sha), pa.array(sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
