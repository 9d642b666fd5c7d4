"""Each operator against a brute-force version, on documents with awkward cases."""

import functools
import hashlib
import random
import weakref
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpetree, common, linequality, minhash, packing, queries, revisit, rlz, sharding, tokenframes, tokens, toxicity, vafile

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def corpus(n=60, seed=4):
    """(doc_id, text, source, kept): near copies, shared passages, nulls, empty and odd texts, ties."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = prose(60)
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 and texts:
            own = texts[-6].split() if len(texts) >= 6 else prose(80).split()
            own[len(own) // 2] = "changed"
            texts.append(" ".join(own))
        elif kind == 1:
            texts.append(prose(30) + "\n" + passage + " " + prose(20))
        elif kind == 2 and len(texts) > 3:
            texts.append(texts[2])
        else:
            texts.append(prose(rng.randint(1, 120)) + ".")
    texts += [None, "", "   \n\t ", "one", "é́ ſ İ <|endoftext|> don't  x", "Su " * 90, "%%% ### " * 40, "Home | About | Login", "A " + "b" * 40_000, passage]
    return [(i, t, None if i % 17 == 0 else f"s{i % 3}", "mine") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, source string, kept string"  # ``kept`` clashes with an added column
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


library = functools.cache(Tokenizer.from_file)


def ids_of(path, text):
    return np.array(library(path).encode(text or "", add_special_tokens=False).ids, "<u4")


# Tokens


def test_a_worker_remembers_for_one_operator_at_a_time():
    """An encoder with its chunks took some 200 MB beside the memories of the pipeline's other operators."""
    encoder = weakref.ref(tokens.encoder_for(BYTE))
    encoder().encode(b"some words")
    assert tokens.encoder_for(BYTE) is encoder()
    words = weakref.ref(rlz.RangeHash().words)
    assert encoder() is None
    assert rlz.RangeHash().words is words()
    tokens.encoder_for(WORD)
    assert words() is None


def test_models_do_not_mix_in_a_worker_s_memory(spark):
    one, other = (toxicity.Severity({w: 9.0}, np.array([1.0, 2.0, 3.0])) for w in ("bad", "worse"))
    docs = spark.createDataFrame([(1, "bad"), (2, "worse"), (3, "fine")], "doc_id long, text string").coalesce(1)
    for model, rejected in ((one, [1]), (other, [2]), (one, [1])):
        assert [r.doc_id for r in toxicity.score(docs, model).filter("rejected").collect()] == rejected


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_encoding_is_the_library_s(path, rows):
    rng, encoder, library = random.Random(1), tokens.TextEncoder(path, limit=50), Tokenizer.from_file(path)
    parts = ["a", "the", "Word,", " ", "  ", "\n", "\n\n", "'s", "don't", "é", "Éa!", "́", "<|endoftext|>", "12", "!?", "\xa0", "中", "\x1c", "x$$$", "a.\nB", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [t for _, t, *_ in rows if t]
    for text in texts:
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_tree_concatenation(path):
    rng, tok = random.Random(2), bpetree.load_tokenizer(path)
    for _ in range(150):
        text = "".join(rng.choice(["ab", "the", " ", "é", "́", "a" * 30, "<|endoftext|>", "1", "..", "字"]) for _ in range(rng.randint(0, 300)))
        parts = [bpetree.encode_part(tok, text, b, e) for b, e in bpetree.halves(len(text), 40)]
        parts = [bpetree.unpack_part(bpetree.pack_part(p), p.begin, p.end) for p in parts]
        assert bpetree.concatenate(tok, text, parts).ids.tolist() == tok.encode(text, add_special_tokens=False).ids


def test_irregular_texts_are_those_of_the_expression():
    rng, parts = random.Random(7), [b"a", b"b.", b" ", b"\n", b"\t", b"\x1c", b"\x7f", *("é \xa0 \x85 \u1680 \u2009 \u205f \u3000 \u2019 字".encode().split(b" "))]
    for _ in range(5000):
        text = b"".join(rng.choices(parts, [9, 9, 9, 2, 1, 1, 1] + [1] * (len(parts) - 7), k=rng.randint(0, 9)))
        assert tokens.irregular(text) == (tokens._IRREGULAR.search(text) is not None)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_remembered_leaves_are_the_library_s(path):
    rng, encoder, tok = random.Random(6), tokens.TextEncoder(path, limit=40), Tokenizer.from_file(path)
    parts = ["a", "the", "Word,", " ", "  ", "\n", "'s", "don't", "é", "Éa!", "\u0301", "<|endoftext|>", "12", "\xa0", "中", "\x1c", "\t", "İ", "ſ", "각", "😀", "\x85", "</w>", "\0"]
    for _ in range(1000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        got, want = bpetree.encode_leaf(encoder, text), bpetree.encode_part(tok, text, 0, len(text))
        assert (got.ids.tolist(), got.first.tolist(), got.last.tolist()) == (want.ids.tolist(), want.first.tolist(), want.last.tolist())
        decoded = tok.decode(want.ids.tolist(), skip_special_tokens=False).encode()
        ids = want.ids.astype("<u4").tobytes()
        assert [bytes(x) for x in encoder.decode([b"", ids, b"", ids])] == [b"", decoded, b"", decoded]
    assert encoder.decode([]) == [] and encoder.decode([b"", b""]) == [b"", b""]


def test_words_of_a_leaf_go_to_the_library_once():
    encoder, asked = tokens.TextEncoder(WORD), []
    library = encoder.tokenizer

    class Counting:
        def encode(self, text, **options):
            asked.append(text)
            return library.encode(text, **options)

    encoder.tokenizer = Counting()
    text = " ".join(["plain", "Été.", "don't", "12", "字é"] * 400 + ["-" * 300])
    assert bpetree.encode_leaf(encoder, text).ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(map(len, asked)) < len(text) / 10 and asked.count("12") == 1
    assert max(map(len, encoder.chunks)) < 300  # a chunk that long is not kept


def test_encode_decode(docs, rows, empty):
    tok = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpetree.encode_decode(docs, WORD, leaf=100, with_ids=True).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        ids = ids_of(WORD, text)
        decoded = tok.decode(ids.tolist(), skip_special_tokens=False)
        r = got[doc_id]
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids.tolist(), decoded)
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpetree.encode_decode(empty, WORD).count() == 0


# Packing


def check_pieces(pieces, rows, window):
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_window.setdefault(p.sequence_id, []).append(p)
    for doc_id, text, *_ in rows:
        ids, at = np.concatenate([ids_of(BYTE, text), np.array([1], "<u4")]), 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for k, own in by_window.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or k == max(by_window)
    return by_window


def test_pack(docs, rows, empty):
    pieces = packing.pack(docs, BYTE, window=64).collect()
    windows = check_pieces(pieces, rows, 64)
    totals = Counter()
    for p in pieces:
        totals[p.source] += p.length
    whole = sum(totals.values())
    for own in (own for k, own in windows.items() if k < max(windows)):
        share = Counter()
        for p in own:
            share[p.source] += p.length
        assert all(abs(share[s] - 64 * n / whole) <= 3 for s, n in totals.items())
    assert packing.pack(empty, BYTE).count() == 0
    assert packing.pack(docs.drop("source"), BYTE, window=64).count() > 0


def test_pack_with_a_mixture_and_shared_queue(docs, rows):
    pieces = packing.pack(docs, BYTE, mixture={"s0": 3, "s1": 1}, window=64, max_queues=3).collect()
    check_pieces(pieces, rows, 64)


def shares_by_window(pieces):
    """Tokens of each source in the windows up to each but the last."""
    out, reached, by_window = [], Counter(), {}
    for p in pieces:
        by_window.setdefault(p.sequence_id, []).append(p)
    for k in sorted(by_window)[:-1]:
        for p in by_window[k]:
            reached[p.source] += p.length
        out.append(reached.copy())
    return out


@pytest.mark.parametrize("block", [2048, 5])
def test_pack_serves_sources_beyond_the_limit_by_what_they_hold(spark, monkeypatch, block):
    monkeypatch.setattr(packing, "TREE_BLOCK", block)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 90))), f"host{min(rng.randint(0, 50), rng.randint(0, 50))}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    pieces = packing.pack(frame, BYTE, window=128, max_queues=3).collect()
    check_pieces(pieces, rows, 128)
    totals = Counter()
    for p in pieces:
        totals[p.source] += p.length
    whole = sum(totals.values())
    for k, reached in enumerate(shares_by_window(pieces), 1):
        assert all(abs(reached[s] - 128 * k * n / whole) <= 12 for s, n in totals.items())  # a token a level


def test_pack_heeds_the_weight_of_a_small_source(spark):
    rows = [(i, "alpha beta " * 40, f"s{i % 4}") for i in range(80)] + [(100, "gamma " * 60, "tiny")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    pieces = packing.pack(frame, BYTE, mixture={"s0": 1, "s1": 1, "s2": 1, "s3": 1, "tiny": 4}, window=32, max_queues=2).collect()
    check_pieces(pieces, rows, 32)
    first = shares_by_window(pieces)[0]
    assert abs(first["tiny"] - 16) <= 3 and all(abs(first[f"s{i}"] - 4) <= 3 for i in range(4))


def test_pack_weighs_unnamed_sources_in_the_same_unit(spark):
    rows = [(i, "alpha beta " * 40, f"s{i % 4}") for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for rest, want in ((1, [24, 8, 4, 4]), (0, [30, 10, 0, 0])):
        pieces = packing.pack(frame, BYTE, mixture={"s0": 3, "s1": 1}, window=40, rest=rest, max_queues=2).collect()
        check_pieces(pieces, rows, 40)
        first = shares_by_window(pieces)[4]
        assert all(abs(first[f"s{i}"] - 5 * n) <= 3 for i, n in enumerate(want)), (rest, first)


def test_a_rare_source_jumps_from_window_to_window(monkeypatch):
    calls, schedule = [], packing.Schedule([10**13, 200], [10**13, 200])
    before = schedule.before
    monkeypatch.setattr(schedule, "before", lambda *a: calls.append(1) or before(*a))
    pieces = list(packing.pieces_of(schedule, 1, 0, 200, 2048))
    assert [p[:2] for p in pieces] == [(k, 1) for k in range(200)] and len({p[2] for p in pieces}) == 200
    assert len(calls) < 1000


def test_pack_with_null_ids_and_repeated_rows(spark):
    rows = [(None, "alpha beta", "s"), (None, "alpha beta", "s"), (5, "gamma", None), (5, "gamma", None), (6, None, "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.pack(frame, BYTE).collect())
    want = Counter()
    for i, t, _ in rows:
        ids = np.concatenate([ids_of(BYTE, t), np.array([1], "<u4")])
        want[(i, 0, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert got == want
    back = Counter((r.doc_id, r.n_tokens) for r in bpetree.encode_decode(frame, WORD, leaf=4).collect())
    assert back == Counter((i, len(ids_of(WORD, t))) for i, t, _ in rows)


# Vectors


def vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(150)]
    rows += [(150 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(200, None), (201, [1.0, None] + [0.0] * 6), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (204, []), (None, [0.1] * 8), (205, [0.5, 0.5]), (220, [0.1, 0.2])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("blocks", [(4096, 512), (16, 4)])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(vafile, "VECTOR_BLOCK", blocks[0])
    monkeypatch.setattr(vafile, "QUERY_BLOCK", blocks[1])
    rows, frame = vectors(spark)
    sound = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    got = {}
    for r in vafile.top_k(frame, lambda i: i % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, x in sound.items():
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in sound.items() if i != q and len(y) == len(x))[:20]
            assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert vafile.top_k(frame.filter("false"), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("dims", [64, 768])
def test_exact_vectors_are_read_by_bound(spark, monkeypatch, dims):
    rng, read = np.random.default_rng(dims), []
    x = rng.normal(0, 0.3, (600, dims)).astype(np.float32)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(3)
    exact = vafile.exact_scores

    def counted(wanted, rows, asked):
        read.append(wanted.count())
        return exact(wanted, rows, asked)

    monkeypatch.setattr(vafile, "exact_scores", counted)
    monkeypatch.setattr(vafile, "VECTOR_BLOCK", 100)
    got = vafile.top_k(frame, lambda i: i % 20 == 0, k=5).collect()
    whole = np.floor(64 * x.astype(float)).astype(int)
    for q in range(0, 600, 20):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(600) if i != q)[:5]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert read[0] <= 30 * 10 and sum(read) < 0.1 * 30 * 599  # the first 2 k of each query, then those still open


def test_candidates_do_not_grow_with_the_tasks(spark, monkeypatch):
    """Every block in a task of its own: each begins with the bound of the blocks scanned first."""
    monkeypatch.setattr(vafile, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(vafile, "REMEMBERED", 0)
    x = np.random.default_rng(5).normal(0, 0.3, (4000, 16)).astype(np.float32)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    counts, whole = [], vafile.candidates

    def counted(file, queries, cells, k):
        found = common.stage(whole(file, queries, cells, k), "counted")
        counts.append(found.count())
        return found

    monkeypatch.setattr(vafile, "candidates", counted)
    got = vafile.top_k(frame, lambda i: i % 400 == 0, k=5).collect()
    exact = np.floor(64 * x.astype(float)).astype(int)
    for q in range(0, 4000, 400):
        best = sorted((-int(exact[q] @ exact[i]), i) for i in range(4000) if i != q)[:5]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert counts[0] < 10 * 5 * 40  # 80 blocks without a bound leave 5 each at least


def test_top_k_broadcasts_nothing_that_grows(spark, monkeypatch):
    """Staged tables are packed small, so Spark would take any of them for a table to broadcast."""
    plans, staged = [], vafile.stage

    def seen(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return staged(df, label)

    monkeypatch.setattr(vafile, "stage", seen)
    x = np.random.default_rng(8).normal(0, 0.3, (400, 8))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    out = vafile.top_k(frame, lambda i: i % 20 == 0, k=5)
    plans.append(("result", out._jdf.queryExecution().executedPlan().toString()))
    assert out.count() == 20 * 5
    broadcasts = {label: plan.count("BroadcastExchange") for label, plan in plans}
    assert broadcasts.pop("va-floors") == 2  # the first block of each length: for the numbers and for what the blocks hold
    assert not any(broadcasts.values()), broadcasts


def test_top_k_of_large_numbers_repeated_ids_and_clashing_names(spark):
    rows = [(20, [3e7, -1.0]), (20, [1.0, 2.0]), (1, [2.0, 5.0]), (1, [2.0, 5.0]), (2, [-4e7, 7.0])]
    frame = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], "vec_id long, embedding array<double>, number string, block string, codes string")
    whole = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows]
    asked = min(v for i, v in whole if i == 20)
    want = sorted((-sum(a * b for a, b in zip(asked, v)), i) for i, v in whole if i != 20)
    got = sorted((r["rank"], r.vec_id, r.score) for r in vafile.top_k(frame, lambda i: i % 20 == 0).collect())
    assert got == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


# Near duplicates


def brute_components(rows, words):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("blocks", [(1024, 64), (3, 2)])
def test_near_duplicates(docs, rows, empty, monkeypatch, blocks):
    monkeypatch.setattr(minhash, "POSTING_BLOCK", blocks[0])
    monkeypatch.setattr(minhash, "SET_BLOCK", blocks[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words=4).collect()}
    assert got == brute_components(rows, 4)
    assert minhash.near_duplicates(empty).count() == 0


def test_links_between_parts_that_refuted_candidates_hold_together(spark, monkeypatch):
    """Chains of texts whose neighbours alone are linked, so most candidates of a list are refuted."""
    rng = random.Random(12)
    rows, words = [], [f"w{i}" for i in range(5000)]
    for c in range(4):
        text = rng.sample(words, 120)
        for k in range(25):
            rows.append((100 * c + k, " ".join(text)))
            for at in rng.sample(range(120), 3 if k % 4 else 5):
                text[at] = rng.choice(words)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    told = []
    across = minhash.linked_across
    monkeypatch.setattr(minhash, "linked_across", lambda *a: told.append(across(*a)) or told[-1])
    monkeypatch.setattr(minhash, "SET_BLOCK", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, words=3).collect()}
    assert got == brute_components(rows, 3)
    assert told[0] is not None


def test_collisions_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 3, (80, minhash.K)).astype(np.uint32)
    merger = minhash.Merger(sig)
    for i in range(80):
        assert merger.collisions(i).tolist() == [j for j in range(i + 1, 80) if (sig[i] == sig[j]).sum() >= minhash.T]


def test_every_long_posting_list_is_split(spark, monkeypatch):
    """Lists over the block size are dealt, however many of them there are: no run of one bucket is longer than two blocks."""
    monkeypatch.setattr(minhash, "POSTING_BLOCK", 10)
    rows = [(i, " ".join([f"c{k}" for k in range(60)] + [f"d{i}x{k}" for k in range(8)])) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    longest, runs = spark.sparkContext.accumulator(0), minhash.runs_of

    def watched(batches, work):
        def counted(keys, table):
            if "bucket" in table.column_names:
                longest.add(int((np.unique(keys, return_counts=True)[1] > 45).sum()))
            return work(keys, table)

        return runs(batches, counted)

    monkeypatch.setattr(minhash, "runs_of", watched)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, words=3).collect()}
    assert got == brute_components(rows, 3) and longest.value == 0


def test_near_duplicates_with_null_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(None, text), (None, text), (3, text), (3, text), (5, text + " x"), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(frame).collect())
    assert got == [(False, 0, 0, True)] * 2 + [(True, 3, 3, True)] * 2 + [(True, 5, 3, False), (True, 9, 9, True)]
    with pytest.raises(ValueError):
        minhash.near_duplicates(frame, share=70)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(55)] + [(200 + i, 201 + i) for i in range(30)] + [(None, 4), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Quality


def test_clean_lines(docs, rows, empty):
    got = {r.doc_id: r for r in linequality.clean_lines(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        t = t or ""
        words = t.encode().split()
        counts = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if counts[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r.word_chars == sum(len(w.decode()) for w in words)
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    assert linequality.clean_lines(empty).count() == 0


def test_line_rules(spark):
    good = "This is a plain sentence with enough words to stand on its own here.\n"
    prose = "".join(" ".join(f"w{i}x{k}" for k in range(12)) + ".\n" for i in range(9))
    frame = spark.createDataFrame([(1, prose + "Home | Login | About\nshort stub\nAll rights reserved.\n" + good)], "doc_id long, text string")
    r = linequality.clean_lines(frame).first()
    assert r.kept and r.n_lines_removed == 3 and r.clean_text == prose + good
    assert linequality.failed_rule(b"a###b c%%%d", b"a###b c%%%d".split()) == "punctuation"


# Token files


def test_token_files(spark, docs, rows, empty):
    manifest = tokenframes.write_token_files(docs, WORD, end_id=1)
    got = sorted(tokenframes.read_token_files(manifest, with_ids=True).collect(), key=lambda r: r.doc_id)
    at = 0
    for (i, t, *_), r in zip(rows, got, strict=True):
        ids = np.concatenate([ids_of(WORD, t), np.array([1], "<u4")])
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        at += len(ids)
    some = tokenframes.read_token_files(manifest, doc_ids=[3, 40, 9999]).collect()
    assert sorted((r.doc_id, r.start) for r in some) == [(r.doc_id, r.start) for r in got if r.doc_id in (3, 40)]
    assert tokenframes.read_token_files(tokenframes.write_token_files(empty, WORD)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (2, "c"), (2, "c"), (-5, None)], "doc_id long, text string")
    back = tokenframes.read_token_files(tokenframes.write_token_files(odd, WORD)).collect()
    assert sorted((r.start, r.doc_id) for r in back) == [(0, None), (3, -5), (4, 2), (6, 2)]


def test_token_file_is_zstandard_and_damage_shows(spark, docs, tmp_path):
    import zstandard
    from pyarrow import fs

    manifest = tokenframes.write_token_files(docs, WORD)
    name = manifest.first().file.removeprefix("file://")
    data = bytearray(open(name, "rb").read())
    plain = zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read()
    assert len(plain) == 4 * manifest.filter(F.col("file").endswith(name)).first().n_tokens
    data[40] ^= 0xFF
    broken = tmp_path / "broken.zst"
    broken.write_bytes(bytes(data))
    with fs.LocalFileSystem().open_input_file(str(broken)) as source:
        reader = tokenframes.FrameReader(source)
        with pytest.raises((ValueError, zstandard.ZstdError)):
            for k in range(len(reader.ids)):
                reader.read(k)


# Repeated passages


def brute_repeats(rows, window):
    texts = {i: (t or "").encode().split() for i, t, *_ in rows}
    counts = Counter(tuple(w[k : k + window]) for w in texts.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in texts.items():
        gone = {k + j for k in range(len(w) - window + 1) if counts[tuple(w[k : k + window])] > 1 for j in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("window", [35, 16])
def test_remove_repeats(docs, rows, empty, window):
    got = rlz.remove_repeats(docs, window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_repeats(rows, window)
    for r in got:
        assert hashlib.sha256(b" ".join(r.kept_text.encode().split())).hexdigest() == r.kept_sha256
    assert rlz.remove_repeats(empty).count() == 0


def naive_parse(texts, i, window):
    """Greedy factors of one document: at each word the longest match with any other place, if it is long enough."""
    own, at, out = texts[i], 0, []
    while at < len(own):
        best = (0, None, None)
        for j, other in texts.items():
            for k in range(len(other)):
                n = 0
                while (i, at) != (j, k) and at + n < len(own) and k + n < len(other) and own[at + n] == other[k + n]:
                    n += 1
                best = max(best, (n, j, k), key=lambda x: x[0])
        if best[0] >= window:
            out.append((at, *best))
        at += best[0] if best[0] >= window else 1
    return out


def test_factors_are_those_of_a_naive_parser(spark):
    rng = random.Random(31)
    fresh = lambda n: [f"x{rng.randint(0, 10**9)}" for _ in range(n)]
    texts = {i: fresh(60) for i in range(12)}
    for i in range(0, 12, 2):  # two passages stand in two documents each, between words of their own
        one, two = fresh(rng.randint(35, 120)), fresh(rng.randint(20, 60))
        texts[i] = texts[i][:10] + one + texts[i][10:] + two
        texts[i + 1] = fresh(3) + one + texts[i + 1] + two[:50] + fresh(rng.randint(0, 9))
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    got = {}
    for r in rlz.factors(frame, window=35).collect():
        got.setdefault(r.doc, []).append((r.start, r.length, r.ref_doc, r.ref_start))
    assert {i: sorted(v) for i, v in got.items()} == {i: f for i in texts if (f := naive_parse(texts, i, 35))}
    assert sum(len(v) for v in got.values()) >= 12


def test_parse_is_greedy():
    a, b, c = (0, 50, ("a", 7)), (10, 60, ("b", 0)), (20, 100, ("c", 1))
    assert rlz.parse([c, a, b, (120, 160, ("d", 0))]) == [(0, 50, ("a", 7)), (50, 50, ("c", 31)), (120, 40, ("d", 0))]


def test_windows_at_the_boundaries_of_factors_are_found(spark):
    """Three texts share an anchor's passage, two of them more than they share with the third."""
    rng, found = random.Random(9), 0
    for seed in range(3):
        w = [f"y{seed}x{rng.randint(0, 10**9)}" for _ in range(60)]
        texts = {1: w, 2: ["p"] + w[5:50] + ["q"], 3: ["r"] * 2 + w[12:60], 4: w[3:40] + ["s"] * 3}
        texts |= {10 + i: w[i : i + 36] + [f"t{i}"] for i in range(0, 24, 3)}
        rows = [(i, " ".join(t)) for i, t in texts.items()]
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rlz.remove_repeats(frame).collect()}
        assert got == brute_repeats(rows, 35)
        found += sum(r[1] for r in got.values())
    assert found


INNER_NAMES = """row bytes doc text_key spans anchor content first windows lead n is_ref blocks words kind length body ref_doc matched part key keys node
  rep digest sig bucket named component least linked x y a b loose other group mine range size hash tie cell nth shard slot _n _part _queue _q _ids _at _base
  _path _first _bytes _id _text _row begin leaf tokens start offset ids N_Words kept_text n_lines clean_text rejected grade p_toxic component_id file part""".split()


def test_clashing_columns(spark, docs):
    names = list(dict.fromkeys(n for n in [*INNER_NAMES, "a.b"] if n.lower() not in ("kept",)))
    clash = docs.limit(40).select("*", *(F.lit("mine").alias(c) for c in names)).cache()
    n = clash.count()

    def kept(out, added):
        mine = [c for c in names if c.lower() not in {a.lower() for a in added}]
        assert out.filter(" and ".join(f"`{c}` = 'mine'" for c in mine)).count() == out.count() >= n
        assert out.select("doc_id").distinct().count() == n

    kept(rlz.remove_repeats(clash), "n_words n_removed kept_sha256 kept_text".split())
    kept(linequality.clean_lines(clash), [f for f, _ in linequality.FIELDS] + ["clean_text"])
    kept(packing.pack(clash, BYTE), "start length ids_crc32 doc_tokens sequence_id offset ids".split())
    kept(sharding.assign_shards(clash.withColumn("bytes_", F.lit(1)), size="bytes_", group="text"), ["shard", "slot"])
    kept(toxicity.score(clash, toxicity.Severity({}, np.full(3, 40.0))), toxicity.FIELDS)
    assert minhash.near_duplicates(clash).count() == bpetree.encode_decode(clash, WORD).count() == n
    assert tokenframes.read_token_files(tokenframes.write_token_files(clash, WORD)).count() == n


def test_repeated_rows_are_repeats(spark):
    text = " ".join(f"w{i}" for i in range(50))
    frame = spark.createDataFrame([(1, text), (1, text), (None, text + " y"), (2, None), (3, "w1 w2")], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in rlz.remove_repeats(frame).collect())
    assert got == [(0, 0), (2, 0), (50, 50), (50, 50), (51, 50)]


# Shards


def test_shards(spark, docs, rows, empty):
    sized = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    got = sharding.assign_shards(sized, shards=4).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(empty.withColumn("size", F.lit(1)), shards=4).count() == 0
    assert sharding.assign_shards(sized.withColumn("SLOT", F.lit(-1)), shards=4).filter("slot < 0").count() == 0


def test_shards_by_plain_python(spark):
    """Splitters, ranges and shards made again from the keys alone."""
    rng = random.Random(3)
    rows = [(i, f"t{min(rng.randint(0, 900), rng.randint(0, 900))}" if i % 4 else "hot", rng.randint(0, 40), "r", "h") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, size long, range string, hash string").repartition(4)
    out = sharding.assign_shards(frame, shards=6, ranges_per_shard=8).withColumn("key", F.xxhash64("text")).collect()
    assert sorted((r.doc_id, r.text, r.size, r.range, r.hash) for r in out) == sorted(rows)
    slots, sizes, order = {}, Counter(), sorted(out, key=lambda r: (r.shard, r.slot))
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 6
    assert sorted(slots) == list(range(6)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert [r.key for r in order] == sorted(r.key for r in out)  # shards and slots follow the key
    assert all(abs(b - mean) < 0.1 * mean for b in sizes.values())
    weight = Counter()
    for r in out:
        weight[r.text] += r.size
    spread = {t: len({r.shard for r in out if r.text == t}) for t in weight}
    assert spread["hot"] > 1 and all(n == 1 for t, n in spread.items() if weight[t] < mean / 16)


def test_cuts_move_to_the_edges_of_small_groups():
    rows = [(h, t, 1.0) for h in range(40) for t in range(5)] + [(99, t, 1.0) for t in range(200)]
    cuts = sharding._quantiles(rows, 10)
    assert all(t in (sharding.FIRST_TIE, sharding.LAST_TIE) for h, t in cuts if h != 99) and sum(h == 99 for h, _ in cuts) >= 4


def test_a_hot_group_is_subdivided(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit(10).alias("size"))
    sizes = [r.b for r in sharding.assign_shards(rows, shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * 7500 and min(sizes) > 0.9 * 7500


def test_a_range_that_the_sample_leaves_overfull_is_split(spark, monkeypatch):
    first = sharding.splitters
    monkeypatch.setattr(sharding, "splitters", lambda records, ranges: first(records, ranges)[:3])
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 4000).alias("text"), (F.col("id") % 7 + 5).alias("size"))
    got = sharding.assign_shards(rows, shards=5).collect()
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(sizes.values()) / 5
    assert len(got) == 6000 and len(sizes) == 5 and all(abs(b - mean) < 0.1 * mean for b in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# Toxicity


def graded(seed=7, n=40, features=6, levels=4):
    rng = np.random.default_rng(seed)
    rows, columns = np.repeat(np.arange(n), 3), rng.integers(0, features, 3 * n)
    return rows, columns, rng.uniform(0.1, 2, 3 * n), rng.integers(0, levels, n), rng.normal(0, 0.7, features + levels - 1)


def test_likelihood_by_plain_python_and_its_gradient_by_differences():
    rows, columns, values, grades, state = graded()
    theta = [state[6], state[6] + np.exp(state[7]), state[6] + np.exp(state[7]) + np.exp(state[8])]
    total = 0.0
    for i, g in enumerate(grades):
        score = sum(v * state[c] for r, c, v in zip(rows, columns, values) if r == i)
        above = [1.0] + [1 / (1 + np.exp(t - score)) for t in theta] + [0.0]
        total += np.log(above[g] - above[g + 1])
    want = total / len(grades) - 0.01 / 2 * sum(w * w for w in state[:6])
    value, gradient = toxicity.likelihood(state, rows, columns, values, grades, 6, 0.01)
    assert abs(value - want) < 1e-9
    for k in range(len(state)):
        step = np.zeros_like(state)
        step[k] = 1e-5
        up, down = (toxicity.likelihood(state + d, rows, columns, values, grades, 6, 0.01)[0] for d in (step, -step))
        assert abs((up - down) / 2e-5 - gradient[k]) < 1e-6


def test_the_fit_is_a_maximum():
    rows, columns, values, grades, _ = graded()
    weights, theta = toxicity.fit_ordinal(rows, columns, values, grades, 6, 4, l2=0.01, steps=2000, rate=0.02)
    state = np.concatenate([weights, theta[:1], np.log(np.diff(theta))])
    value, gradient = toxicity.likelihood(state, rows, columns, values, grades, 6, 0.01)
    assert np.abs(gradient).max() < 1e-3
    rng = np.random.default_rng(1)
    assert all(toxicity.likelihood(state + rng.normal(0, 0.2, len(state)), rows, columns, values, grades, 6, 0.01)[0] < value for _ in range(20))


def plain_severity(text, model):
    """(expected severity, chance of being toxic, likeliest grade, rejected) of one text."""
    counts = Counter()
    for word in toxicity.WORD.findall((text or "").lower()):
        for f in {word, *(word[:k] + "-" for k in (4, 5, 6, 7) if len(word) > k)}:
            counts[f] += 1
    score = sum(w * np.log(1 + counts[f]) for f, w in model.weights.items() if counts[f])
    above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
    chances = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
    return sum(k * c for k, c in enumerate(chances)), above[0], int(np.argmax(chances)), bool(above[0] >= model.reject_at and (text or "").strip())


def test_scores_by_plain_python(spark, rows):
    model = toxicity.Severity({"abc-": 0.4, "one": 2.5, "changed": 1.5, "dont": -1.0, "su": 0.9}, np.array([0.5, 1.5, 3.0]))
    more = [*rows, (rows[0][0], rows[0][1], "s", "x"), (None, "one changed su", "s", "x"), (7000, "one " * 60_000, "s", "x")]
    frame = spark.createDataFrame(more, "doc_id long, text string, source string, kept string").repartition(3)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), round(r.expected_severity, 9), round(r.p_toxic, 9), r.grade, r.rejected) for r in toxicity.score(frame, model).collect())
    want = []
    for i, t, *_ in more:
        severity, p, grade, rejected = plain_severity(t, model)
        want.append(((i is not None, i or 0), round(float(severity), 9), round(float(p), 9), grade, rejected))
    assert got == sorted(want) and any(w[4] for w in want)


def test_severity_on_held_out_documents(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")  # the least one has too few labels to hold any out
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.xxhash64("doc_id", F.lit(3)) % 4 == 0
    model = toxicity.fit(docs, labels.filter(~held))
    assert (np.diff(model.thresholds) > 0).all()
    told = toxicity.score(docs.select("doc_id", "text"), model).join(labels.filter(held), "doc_id").select("toxic", "rejected", "expected_severity", "grade").collect()
    right = np.mean([r.rejected == bool(r.toxic) for r in told])
    assert right > 0.96
    by_grade = [np.mean([r.toxic for r in told if r.grade == g]) for g in sorted({r.grade for r in told})]
    assert len(by_grade) > 1 and by_grade[0] < 0.1 and min(by_grade[1:]) > 0.8
    assert np.mean([r.expected_severity for r in told if r.toxic]) > 5 * np.mean([r.expected_severity for r in told if not r.toxic])


def test_severity_of_odd_inputs(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs.withColumn("grade", F.lit("x")), model).filter("rejected").count() == 0
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(empty, labels.filter("false")).weights == {}


# Revisits


def test_revisits(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "http://WWW.a.org/x/?utm_source=f#t", 10, 200, "t1", None, h(content_length="9", etag="t1", age="1")),
        (2, "https://a.org:443/x", 20, 304, "W/t1", None, h(content_length="0", age="2")),
        (3, "http://a.org/x", 30, 200, "t2", "d2", h(content_type="text/html")),
        (4, "http://a.org/x", 30, 304, "t1", None, {}),  # the response of its own time is not earlier
        (5, "http://a.org/x", 31, 304, "t1", None, {}),
        (6, "http://a.org/x", 32, 304, None, "d2", None),
        (7, "http://a.org/x", 33, 304, None, None, {}),
        (8, "http://b.org/?ref=1&q=2", 5, 304, "t", None, {}),
        (9, None, 5, 304, "t", None, {}),
        (10, "http://a.org/x", 5, 404, "t", None, {}),
    ]
    frame = spark.createDataFrame(rows, "record_id long, url string, time long, status int, etag string, last_modified string, headers map<string,string>")
    got = {r.record_id: (r.response_id, r.resolution) for r in revisit.resolve(frame, spans=3).collect()}
    assert got == {2: (1, "resolved"), 4: (1, "resolved"), 5: (3, "mismatch"), 6: (3, "resolved"), 7: (3, "unchecked"), 8: (None, "missing"), 9: (None, "missing")}
    two = revisit.resolve(frame).filter("record_id = 2").first()
    assert two.headers == {"content-length": "9", "etag": "t1", "age": "2"} and two.canonical_url == "a.org/x"
    assert revisit.resolve(frame.filter("record_id = 8")).first().canonical_url == "b.org/?q=2"
    assert revisit.resolve(frame.filter("false")).count() == 0


def test_revisits_with_connection_headers_repeats_and_null_times(spark):
    rows = [
        (1, "a.org/", 1, 200, "t", None, {"etag": "t", "x-hop": "old", "age": "1"}),
        (2, "a.org/", 2, 304, "t", None, {"connection": "close, X-Hop", "keep-alive": "5", "x-hop": "new", "te": "x", "age": "9", "upgrade": "u"}),
        (2, "a.org/", 2, 304, "t", None, {"age": "9"}),
        (3, "a.org/", None, 304, "t", None, {}),
        (4, "b.org/", None, 200, "t", None, {"etag": "t"}),
        (5, "b.org/", 9, 304, "t", None, None),
        (6, "c.org/", 3, 200, "u", None, {"etag": "u"}),
        (6, "c.org/", 3, 200, "v", None, {"etag": "v"}),
        (7, "c.org/", 4, 304, "u", None, {}),
    ]
    frame = spark.createDataFrame(rows, "record_id long, url string, time long, status int, etag string, last_modified string, headers map<string,string>")
    clash = frame.select("*", *(F.lit("x").alias(c) for c in ("span", "full", "last", "inherited", "within", "response_id", "r_etag", "r", "canonical_url")))
    got = sorted((r.record_id, r.response_id or 0, r.resolution, str(sorted((r.headers or {}).items()))) for r in revisit.resolve(clash, spans=2).collect())
    merged = str([("age", "9"), ("etag", "t"), ("x-hop", "old")])
    assert [g for g in got if g[0] == 2] == [(2, 1, "resolved", merged)] * 2
    assert [g[:3] for g in got if g[0] in (3, 5)] == [(3, 0, "missing"), (5, 0, "missing")]
    seven = {revisit.resolve(frame.repartition(k)).filter("record_id = 7").first().resolution for k in (1, 3, 5)}
    assert len(seven) == 1


# The registered queries


def test_names():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]


def test_revisit_query_is_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.execute(queries.OP4_SQL).fetchall()
    columns = [c[0] for c in con.description]
    got = queries.op4_revisit_resolution(spark, sf_dir).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]


def test_packing_query(spark, sf_dir, table):
    pieces = queries.op1_packing(spark, sf_dir).collect()
    check_pieces(pieces, table, 2048)


def test_toxicity_query(spark, sf_dir, table):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in queries.op3_ordinal_toxicity(spark, sf_dir).collect()}
    assert len(got) == len(table)
    for i, t, _ in table:
        severity, p, grade, rejected = plain_severity(t, model)
        assert abs(got[i].expected_severity - severity) < 1e-6 and abs(got[i].p_toxic - p) < 1e-6
        assert (got[i].grade, got[i].rejected) == (grade, rejected)


def test_encoding_query(spark, sf_dir, table):
    tok, got = Tokenizer.from_file(WORD), {r.doc_id: r for r in queries.op5_tree_concatenation(spark, sf_dir).collect()}
    assert len(got) == len(table)
    for i, t, _ in table:
        ids = ids_of(WORD, t)
        decoded = tok.decode(ids.tolist(), skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def test_token_file_query(spark, sf_dir, table):
    got, at = sorted(queries.op8_token_frames(spark, sf_dir).collect(), key=lambda r: r.doc_id), 0
    for (i, t, _), r in zip(sorted(table), got, strict=True):
        ids = np.concatenate([ids_of(WORD, t), np.array([1], "<u4")])
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_sharding_query(spark, sf_dir, table):
    got = {r.doc_id: r for r in queries.op10_sampled_splitters(spark, sf_dir).collect()}
    sizes, slots, groups = Counter(), {}, {}
    for i, t, _ in table:
        r, raw = got[i], (t or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(t, []).append(r)
    assert len(got) == len(table) and set(sizes) <= set(range(16))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    share, largest = sum(sizes.values()) / 16, max(r.size for r in got.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(largest, share / 64 * 3)
    assert all(len({r.shard for r in g}) == 1 for g in groups.values() if sum(r.size for r in g) < share / 128)
