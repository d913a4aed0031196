import collections
import hashlib
import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from weft.llm import merges, pieces, prefixes, quality, rangecoder, simhash, suffix, tiling


def rows(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- op1 ---------------------------------------------------------------------------------------------


def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        out.append((len(b), int(gone.sum()), int((edge > 0).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def test_transform_orders_suffixes_and_counts_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(40):
        parts = [rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 25)).astype(np.uint8).tobytes() for _ in range(rng.integers(1, 7))]
        data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        _, prefix, text, start = suffix.transform(data, offsets)
        found = [parts[t][s:] for t, s in zip(text.tolist(), start.tolist())]
        assert found == sorted(found) and len(found) == len(data) + len(parts)
        for a, b, n in zip(found, found[1:], prefix[1:].tolist()):
            assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])


@pytest.mark.parametrize("most", [suffix.MOST_SEGMENTS, 2])
def test_repeats_match_brute_force(spark, documents, texts, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST_SEGMENTS", most)
    full = [*texts, texts[7]]
    want = [(k if k < len(texts) else 7, n, gone, spans, hashlib.sha256(rest).hexdigest()) for k, (n, gone, spans, rest) in enumerate(removed(full, 40))]
    assert rows(suffix.dedup_report(documents, 40, 16)) == sorted(want, key=str)


def test_repeats_at_200(spark, documents, texts):
    got = {r.doc_id: r for r in suffix.dedup_report(documents).collect()}
    assert got[5].n_removed == got[5].n_bytes == 900  # one letter throughout: every window comes again
    assert got[0].n_removed == 0 and got[0].n_bytes == 0 and got[0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    for k, (n, gone, spans, _) in enumerate(removed([*texts, texts[7]], 200)[: len(texts)]):
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans) == (n, gone, spans)


def test_repeats_stage_keeps_columns(spark, documents, texts, nothing):
    out = suffix.remove_repeats(documents, 40, 16)
    assert out.columns == documents.columns and out.count() == documents.count()
    want = {k: rest.decode("utf-8", "ignore") for k, (_, _, _, rest) in enumerate(removed([*texts, texts[7]], 40)) if k < len(texts)}
    for r in out.collect():
        assert (r.text or "") == want[r.doc_id] and (texts[r.doc_id] is None) == (r.text is None)
        assert r.text is None or r.n_chars == len(r.text)
    assert suffix.remove_repeats(nothing).count() == 0 and suffix.dedup_report(nothing).count() == 0


# --- op3 ---------------------------------------------------------------------------------------------


def greedy(a, b, least):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                out.append((i, j, best))


def test_tiles_are_those_of_plain_greedy_tiling():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(1, n)).astype(np.uint64) for n in (30, 50))
        assert sorted(tiling.tile(a, b, 4)) == sorted(greedy(a.tolist(), b.tolist(), 4))


def test_contamination_in_any_order(spark, nothing):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, "said " + item + " yes"), (2, "seven eight nine ten eleven twelve and then ONE two, three four five six"), (3, "one two three four only"), (4, None), (5, ""), (1, "said " + item + " yes")]
    documents = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "too short", 1)], "item_id long, text string, doc_id long")
    for most in (tiling.BROADCAST_WORDS, 0):
        found = rows(tiling.contamination(documents, items, broadcast_words=most).select("doc_id", "item_id", "covered_words", "tiles"))
        assert found == [(1, 7, 12, 1), (1, 7, 12, 1), (2, 7, 12, 2)]
        assert sorted(r.doc_id for r in tiling.decontaminate(documents, items, broadcast_words=most).collect()) == [3, 4, 5]
        assert tiling.contamination(nothing, items, broadcast_words=most).count() == 0
        assert tiling.decontaminate(documents, items.limit(0), broadcast_words=most).count() == 6
    assert tiling.decontaminate(documents, items).columns == documents.columns


# --- op4 ---------------------------------------------------------------------------------------------


def test_coder_round_trips():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 2047, 2048, 2049, 5000):
        for most in (2, 300, 49408, 1 << 20, 2**32):
            ids = np.minimum(rng.zipf(1.4, n), most - 1).astype(np.uint32)
            ids[::7] = most - 1
            one = np.full(1, n)
            back = rangecoder.unpack(rangecoder.pack(one, one, ids))
            assert back[1].tolist() == [n] and (back[2] == ids).all()
    ids = np.tile(np.arange(50), 200).astype(np.uint32)
    assert len(rangecoder.pack(np.arange(1), np.array([len(ids)]), ids)) < len(ids) // 3  # contexts repeat, so it must shrink


def test_coder_round_trips_in_several_groups(monkeypatch):
    monkeypatch.setattr(rangecoder, "LANES", 3)
    ids = np.random.default_rng(1).integers(0, 90, 7 * rangecoder.BLOCK + 5).astype(np.uint32)
    assert (rangecoder.unpack(rangecoder.pack(np.arange(1), np.array([len(ids)]), ids))[2] == ids).all()


def test_coder_beats_the_entropy_of_single_ids():
    import pyarrow.parquet as pq

    text = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").combine_chunks()
    ids, at = rangecoder.tokenize(text, public_tokenizers.path("word_bpe_49k.json"), 1)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    data = rangecoder.pack(np.arange(len(at) - 1), np.diff(at), ids)
    assert len(data) * 8 / len(ids) < 0.9 * -(share * np.log2(share)).sum()
    assert (rangecoder.unpack(data)[2] == ids).all()


def test_words_are_cut_as_the_library_cuts_them():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(3)
    parts = [*"abcXYZ019 '.,!?<|>_-\t\n\r\x0b\x1c\x1f\x85\xa0\u0301\u0130ſéÉàßµªİ漢字😀٣Ⅷ", "<|endoftext|>", "<|startoftext|>", " '", "don't", "I'LL", "\x00", "</w>", "Ñandú,"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, ""]
    ids, at = rangecoder.tokenize(odd, path, 1)
    own = Tokenizer.from_file(path)
    for x, a, b in zip(odd, at[:-1], at[1:]):
        assert ids[a:b].tolist() == [*own.encode(x or "", add_special_tokens=False).ids, 1]


def test_words_are_forgotten_beyond_a_bound(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = rangecoder.tokenize(["one two three", "four"], path, 1)[0].tolist()
    monkeypatch.setattr(rangecoder, "REMEMBERED", 3)
    assert rangecoder.tokenize(["one two three", "four"], path, 1)[0].tolist() == want


def test_coder_notices_damage():
    data = bytearray(rangecoder.pack(np.arange(3), np.array([10, 10, 10]), np.arange(30)))
    data[-10] ^= 255
    with pytest.raises(ValueError):
        rangecoder.unpack(bytes(data))


def test_files_read_back_as_the_library_encodes(spark, documents, texts, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, start, want = Tokenizer.from_file(path), 0, []
    for k, t in sorted([*enumerate(texts), (7, texts[7])]):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rangecoder.round_trip(documents, path).collect())) == want
    assert rangecoder.round_trip(nothing, path).count() == 0


def test_files_keep_null_ids(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(None, "a b"), (None, None), (3, "c"), (3, "c")], "doc_id long, text string")
    got = sorted(map(tuple, rangecoder.round_trip(docs, path, str(tmp_path)).select("doc_id", "n_tokens").collect()), key=str)
    assert got == sorted([(None, 3), (None, 1), (3, 2), (3, 2)], key=str)
    files = [x for x in tmp_path.iterdir() if x.suffix == ".ids"]  # a folder that was named keeps its files
    whole = max(files, key=lambda x: x.stat().st_size).read_bytes()
    stream = io.BytesIO(whole[:-20])  # one that breaks off isn't taken for a short one
    with pytest.raises((ValueError, struct.error, IndexError)):
        while rangecoder.unpack(stream) is not None:
            pass


def test_files_of_several_segments(spark, documents, texts, monkeypatch, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    ids, at = rangecoder.tokenize(texts, path, 1)
    parts = [rangecoder.pack(np.arange(a, b), np.diff(at)[a:b], ids[at[a] : at[b]]) for a, b in ((0, 5), (5, 6), (6, batch.num_rows))]
    stream, found = io.BytesIO(b"".join(parts) + rangecoder.END), []
    while (x := rangecoder.unpack(stream)) is not None:
        found.append(x)
    assert np.concatenate([x[0] for x in found]).tolist() == list(range(len(texts)))
    assert (np.concatenate([x[2] for x in found]) == ids).all()


# --- op5 and op6 ---------------------------------------------------------------------------------------


def odd_texts():
    rng = np.random.default_rng(3)
    letters = list(" \n\t ab'sdé1½٣中🙂.,! \x1c\x85 \U00010ee7") + ["'ll", "'re", "  ", "the "]
    return ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(1500)]


def test_counts_are_the_librarys(spark, documents, texts, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    odd = [*odd_texts(), "x<|endoftext|>y<|endoftext|>", "a" * 5000]
    assert prefixes.vocabulary(path).count(odd).tolist() == [count(t) for t in odd]
    for r in prefixes.counts(documents, path, limit=50).collect():
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), count(t), count(t) > 50)
    assert prefixes.counts(nothing, path).count() == 0


def test_prefix_counts_and_budget(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, text = Tokenizer.from_file(path), "The reconciliation wasn't unbelievable, naïve <|endoftext|> 12345 words"
    counts = prefixes.vocabulary(path).prefix_counts(text)
    for k in range(len(text) + 1):
        if not text[:k].endswith((" ", "'")) and not 0 < text.find(">") + 1 - k < 13:
            assert counts[len(text[:k].encode())] == len(own.encode(text[:k], add_special_tokens=False).ids), text[:k]
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    for r in prefixes.budget(docs, path, 5).collect():
        assert r.n_bytes == (max(k for k in range(len(text.encode()) + 1) if counts[k] <= 5) if r.doc_id == 1 else 0)


def test_merges_are_the_librarys(spark, documents, texts, nothing):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = merges.ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ids, special_tokens={})
    odd = [*odd_texts(), "a" * 5000, "ab" * 999]
    ids, starts = own.texts(odd)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [library.encode_ordinary(t) for t in odd]
    assert pieces.PATTERN == public_tokenizers.PATTERN
    for r in merges.digests(documents, path).collect():
        t = texts[r.doc_id] or ""
        own_ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own_ids), hashlib.sha256(",".join(map(str, own_ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    encoded = merges.encode(documents, path, keep=("source",))
    back = {r.doc_id: bytes(r.decoded) for r in merges.decode(encoded, path).collect()}
    assert all(back[k] == (t or "").encode() for k, t in enumerate(texts))
    assert merges.digests(nothing, path).count() == 0


# --- op7 ---------------------------------------------------------------------------------------------


def test_simhash_links_against_all_pairs(spark, documents, texts, nothing):
    prints = simhash.fingerprint(documents).toPandas()
    x = prints[[f"f{k}" for k in range(4)]].to_numpy().view(np.uint64)
    far = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2)
    near = far <= simhash.THRESHOLD
    got = simhash.near_duplicates(documents).toPandas()
    want = dict(zip(prints.doc_id, near.sum(axis=1) - 1))
    assert {r.doc_id: r.n_links for r in got.itertuples()} == want
    same = {r.doc_id: r.component_id for r in got.itertuples()}
    assert same[8] == same[7] == same[9] == 7  # a copy, and one with two words changed
    kept = simhash.keep_one(documents)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(set(same.values())) and kept.columns == documents.columns
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_simhash_counts_links_across_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(300)]
    docs = []
    for k in range(60):
        own = list(base)
        own[int(rng.integers(0, 300))] = f"other{k}"
        docs.append((k, " ".join(own)))
    from weft.llm import links

    whole = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    assert (whole.n_links == 59).all() and (whole.component_id == 0).all()
    split = links.in_blocks
    monkeypatch.setattr(simhash.links, "in_blocks", lambda rows, sizes, bucket, identity, block: split(rows, sizes, bucket, identity, 7))
    assert (simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).toPandas().n_links == 59).all()
    monkeypatch.setattr(simhash.links, "SENT", 0)
    assert (simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).toPandas().n_links == 59).all()


@pytest.mark.parametrize("n", [10_000, 150_000, 1_000_000, 50_000_000])
def test_simhash_recall_at_the_threshold_holds_at_every_size(n):
    plan = simhash.plan(n)
    share = simhash.sharing(simhash.THRESHOLD, plan.strip, plan.depth, plan.weight, plan.centres)
    assert 1 - (1 - share) ** plan.repetitions >= simhash.TARGET_RECALL
    if plan.repetitions < 1000:
        rng = np.random.default_rng(n)
        u = rng.integers(0, 1 << 63, (600, 4)).astype(np.uint64)
        flip = np.zeros((600, simhash.BITS), np.uint8)
        for row in flip:
            row[rng.choice(simhash.BITS, simhash.THRESHOLD, replace=False)] = 1
        v = u ^ np.packbits(flip, axis=1).view(np.uint64)
        shared = np.zeros(600, bool)
        for r in range(plan.repetitions):
            shared |= (simhash.masks(u, r, plan) & simhash.masks(v, r, plan)).all(axis=1)
        assert shared.mean() > 0.955


@pytest.mark.parametrize("depth", [2, 3])
def test_simhash_recall_of_the_recursion_against_all_pairs(spark, monkeypatch, depth):
    """Queries: every row whose id is divisible by 50, against all rows, by brute force."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = simhash.Plan(64, depth, 26, 16, simhash.repetitions_of(64, depth, 26, 16))
    monkeypatch.setattr(simhash, "plan", lambda n, threshold: own)
    got = simhash.near_duplicates(documents).toPandas().set_index("doc_id").n_links
    prints = simhash.fingerprint(documents).toPandas().set_index("doc_id")[[f"f{k}" for k in range(4)]]
    x = prints.to_numpy().view(np.uint64)
    asked = np.flatnonzero(prints.index.to_numpy() % 50 == 0)
    want = (np.bitwise_count(x[asked, None] ^ x[None]).sum(axis=2) <= simhash.THRESHOLD).sum(axis=1) - 1
    found = got.loc[prints.index[asked]].to_numpy()
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum() and want.sum()


@pytest.mark.parametrize("n, rows, compared", [(1_000_000, 60, 30_000), (3_000_000, 90, 45_000), (15_000_000, 160, 60_000)])
def test_simhash_work_of_a_fingerprint_stays_small(n, rows, compared):
    plan = simhash.plan(n)
    assert simhash.rows_of(plan) <= rows
    assert simhash.rows_of(plan) * n * simhash.passing(plan.weight, plan.strip) ** plan.depth / 2 <= compared
    filters = plan.repetitions * plan.depth * plan.centres  # 109 x 2 x 64 at three million before, twice
    assert filters <= 5000


@pytest.mark.parametrize("block", [simhash.BLOCK, 300])
def test_simhash_narrow_strips_against_all_pairs(spark, monkeypatch, block):
    """Small lists in step, long ones in pairs of blocks; queries: every row whose id is divisible by 50."""
    from weft.llm import links

    rng = np.random.default_rng(11)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 60)] for _ in range(40)]
    docs = []
    for k in range(4000):
        own = list(base[int(rng.integers(0, 40))]) if k % 2 else [f"w{x}" for x in rng.integers(0, 5000, 60)]
        for at in rng.integers(0, 60, int(rng.integers(0, 12))):
            own[at] = f"v{int(rng.integers(0, 5000))}"
        docs.append((k, " ".join(own)))
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    own = simhash.Plan(1, 4, 0, 2, simhash.repetitions_of(1, 4, 0, 2))
    monkeypatch.setattr(simhash, "plan", lambda n, threshold: own)
    split = links.in_blocks
    monkeypatch.setattr(simhash.links, "in_blocks", lambda rows, sizes, bucket, identity, most: split(rows, sizes, bucket, identity, block))
    got = simhash.near_duplicates(documents).toPandas().set_index("doc_id").n_links
    prints = simhash.fingerprint(documents).toPandas().set_index("doc_id")[[f"f{k}" for k in range(4)]]
    x = prints.to_numpy().view(np.uint64)
    asked = np.flatnonzero(prints.index.to_numpy() % 50 == 0)
    asked = np.append(asked, np.flatnonzero(prints.index.to_numpy() % 50 == 1))  # copies have odd ids
    want = (np.bitwise_count(x[asked, None] ^ x[None]).sum(axis=2) <= simhash.THRESHOLD).sum(axis=1) - 1
    found = got.loc[prints.index[asked]].to_numpy()
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum() and want.sum() > 1000


def test_simhash_sum_of_eight():
    bits = np.random.default_rng(13).integers(0, 2, (8, 300, 64)).astype(np.uint8)
    bits[:, 0], bits[:, 1] = 0, 1
    planes = simhash._sum_of_eight(np.packbits(bits, axis=2).view(np.uint64)[:, :, 0])
    got = sum(np.unpackbits(x[:, None].view(np.uint8), axis=1).astype(int) << k for k, x in enumerate(planes))
    assert (got == bits.sum(axis=0)).all()


def test_simhash_first_shared_list_counts_each_pair_once():
    rng = np.random.default_rng(12)
    u = rng.integers(0, 1 << 63, (3000, 4)).astype(np.uint64)
    u[1000:] = u[rng.integers(0, 1000, 2000)] ^ (np.uint64(1) << rng.integers(0, 64, (2000, 4)).astype(np.uint64))
    far = np.bitwise_count(u[:, None] ^ u[None]).sum(axis=2)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(far <= simhash.THRESHOLD)) if a < b}
    own = simhash.Plan(1, 5, 0, 2, 12)
    got = []
    for r in range(own.repetitions):
        row, path = simhash.lists(u, r, own)
        assert len(row) == len(u)  # one list of a repetition
        row = row[np.argsort(path, kind="stable")]
        path = np.sort(path)
        starts = np.append(np.flatnonzero(np.append(True, path[1:] != path[:-1])), len(path))
        one = np.zeros(len(path), np.int64)
        for a, b in simhash._in_steps(simhash._pairs(u[row], starts, one, one, one, simhash.THRESHOLD)):
            mine = simhash._first(u[row], a, b, path[a], own)
            got += [(min(p), max(p)) for p in zip(row[a[mine]].tolist(), row[b[mine]].tolist())]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) > 0.99 * len(want) > 1000


def test_components_of_a_long_path(spark):
    from weft.llm import links

    rng = np.random.default_rng(0)
    for order in (np.arange(1000), rng.permutation(1000)):
        edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order[:-1], order[1:])], "a long, b long")
        found = links.components(edges).toPandas()
        assert len(found) == 1000 and (found.component == 0).all()


def test_keep_one_with_null_and_shared_ids(spark):
    rng = np.random.default_rng(6)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**6, 200))
    alone, other, third, base = text(), text(), text(), text()
    near = base + " more"
    rows = [(None, alone, "a"), (None, alone, "a"), (5, other, "b"), (5, third, "c"), (None, base, "d"), (9, near, "e"), (None, None, "f"), (None, text() + " z", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.row_key for r in got.collect()) == ["a", "b", "c", "e", "f", "g"]
    report = simhash.near_duplicates(docs).toPandas()
    assert len(report) == len(rows) and report.kept.notna().all() and report.kept.sum() == 7
    assert sorted(report.n_links) == [0, 0, 0, 0, 1, 1, 1, 1]
    clash = spark.createDataFrame([(3, base, "d"), (3, near, "e")], "doc_id long, text string, row_key string")
    assert simhash.keep_one(clash).count() == 1


# --- op10 ---------------------------------------------------------------------------------------------


def test_quality_parts_labelled_classes(spark, nothing):
    rng = np.random.default_rng(4)
    good = lambda: " ".join(rng.choice(["stone", "river", "maple", "garden", "window", "lantern"], 60))
    docs = [(k, good() if k % 3 else good()[:150] + " zzqx vvkw zzqx " + good()[:150]) for k in range(900)] + [(900, None), (901, ""), (902, "ab")]
    documents = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, units string")
    labels = spark.createDataFrame([(k, int(k % 6 != 0), int(k % 6 == 3), "t") for k in range(0, 600)], "doc_id long, quality int, toxic int, text string")
    got = quality.classify(documents, labels).toPandas().set_index("doc_id")
    assert len(got) == 903
    clean, bad = [k for k in range(600, 900) if k % 3], [k for k in range(600, 900) if k % 3 == 0]
    assert got.kept[clean].mean() > 0.98 and got.kept[bad].mean() < 0.02  # held out
    assert got.kept[[900, 901, 902]].all() and (got.log_weight[[900, 901]] == 0).all()
    out = quality.keep(documents, labels)
    assert out.columns == documents.columns and {r.doc_id for r in out.collect()} == set(got.index[got.kept])
    some = quality.classify(documents, labels, k=10)
    assert some.where("kept").count() == 10
    assert set(some.where("kept").toPandas().doc_id) == set(some.orderBy(F.desc("sample_key")).limit(10).toPandas().doc_id)
    assert quality.classify(nothing, labels).count() == 0
    assert quality.classify(documents, labels.limit(0)).where("kept").count() == 903
