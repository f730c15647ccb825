import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import embedding_dedup, language_model

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_links(rows, threshold=0.9):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            good[k] = x / np.linalg.norm(x)
    keys = list(good)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                links[a] += 1
                links[b] += 1
                parent[find(b)] = find(a)
    names = {}
    for k, (i, _) in enumerate(rows):
        names.setdefault(find(k), []).append(i)
    low = {c: min((x for x in v if x is not None), default=None) for c, v in names.items()}
    return sorted((i if i is not None else -1, links[k], low[find(k)] if low[find(k)] is not None else -1) for k, (i, _) in enumerate(rows))


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(250):
        v = rng.standard_normal(48)
        rows.append((k * 7 % 1009, v.tolist()))
        if k % 9 == 0:
            for e in (0.1, 0.25, 0.3):
                rows.append((2000 + len(rows), (v + e * rng.standard_normal(48)).tolist()))
    base = rng.standard_normal(48)
    rows += [(5000 + i, (base + 0.15 * rng.standard_normal(48)).tolist()) for i in range(60)]
    rows += [(6000 + i, rng.standard_normal(16).tolist()) for i in range(5)]
    same = rows[3][1]
    rows += [(7000, same), (7000, same), (None, same), (7001, None), (7002, []), (7003, [0.0] * 48), (7004, [None, *same[1:]]), (7005, [math.nan, *same[1:]]), (7006, [math.inf] * 48), (None, None), (7007, [1e30] * 48), (7008, [1e-30] * 48)]
    return rows


@pytest.mark.parametrize("block", [2048, 64])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label string").repartition(4)
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_embeddings_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 400, 64)))
    y[:200] = x[:200] + 0.05 * rng.standard_normal((200, 64))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert (embedding_dedup.bounds(x, y) >= x @ y.T).mean() > 0.9995


def brute_base(rows):
    def tokens(t):
        return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]

    c = Counter()
    for i, t in rows:
        if i is None or crc32(str(i).encode()) % 10:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = tokens(t)
        out.append((i if i is not None else -1, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    return sorted(out)


@pytest.mark.parametrize("head", [1 << 19, 50, 0])
def test_language_model_base_equals_brute_force(spark, sf, head):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(900001, None), (900002, ""), (None, "The the THE unseenword"), (3, "repeated row"), (3, "repeated row")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    got = language_model.score_documents(df, head, rounds=1).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute_base(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    if head:
        held = [r for r in got if r.held_out]
        assert len(held) > 5
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_sums_to_one(spark):
    rows = [(i, "the cat sat on the mat and the dog ran") for i in range(1, 9)] + [(20, "once only words stand here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = language_model.count_words(language_model.training_rows(docs))
    vocab = language_model.vocabulary(words, 1 << 19)
    rng = np.random.default_rng(0)
    weights = rng.standard_normal((language_model.ROWS, language_model.CLASSES)).astype(np.float32)
    shared = spark.sparkContext.broadcast(vocab)
    known = [r.word for r in words.collect() if r.word is not None]
    # all continuations of one history: a word, an unknown word, or the end
    probe = [(i, f"the cat {w}") for i, w in enumerate([*known, "zzzz"])] + [(1000, "the cat")]
    got = {r.doc_id: r.score for r in language_model.score(spark.createDataFrame(probe, "doc_id long, text string"), words, vocab, shared, weights).collect()}
    ended = {}
    for i, w in [*enumerate([*known, "zzzz"])]:
        text = pa.array([f"the cat {w}"], pa.large_string())
        target, features, _ = language_model.tokens_of(*language_model.encode(text, vocab), vocab)
        p = language_model.softmax(features, weights, vocab.bias)
        ended[i] = got[i] - math.log10(p[-1, language_model.END])
        end_only = language_model.softmax(features[:, :3], weights, vocab.bias)
        end_p = end_only[2, language_model.END]
    prefix = got[1000] - math.log10(end_p)
    total = sum(10 ** (s - prefix) for s in ended.values()) + end_p
    assert total == pytest.approx(1, abs=1e-4)


def test_language_model_without_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score_documents(none).count() == 0
    held = next(i for i in range(1000) if crc32(str(i).encode()) % 10 == 0)
    got = language_model.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)]


def test_recall_of_planted_pairs(spark):
    """Every 50th row against all rows: pairs at cosines from 0.9 on are found."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64))
    x[1000:2000] = x[:1000] + rng.uniform(0.05, 0.5, (1000, 1)) * rng.standard_normal((1000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {i: int((unit @ unit[i] >= 0.9).sum()) - 1 for i in range(0, 3000, 50)}
    assert sum(want.values()) > 5 and all(got[i] <= want[i] for i in want)
    assert sum(got[i] for i in want) >= 0.99 * sum(want.values())


def test_inner_factor_sums_to_one_and_sees_the_history(spark):
    rows = [(i, "the cat sat on the mat and the dog ran to the man who ate") for i in range(1, 9)]
    words = language_model.count_words(language_model.training_rows(spark.createDataFrame(rows, "doc_id long, text string")))
    vocab = language_model.vocabulary(words)
    rng = np.random.default_rng(0)
    inner = rng.standard_normal((vocab.sizes.inner, language_model.BUCKETS)).astype(np.float32)
    for c in range(language_model.CLASSES):
        own = vocab.buckets[vocab.classes == c]
        if len(own):
            held = np.array([vocab.counts[(vocab.classes == c) & (vocab.buckets == b)].sum() for b in range(language_model.BUCKETS)])
            assert np.exp(vocab.inner_bias[c]) == pytest.approx(held / held.sum(), abs=1e-6)
            p = language_model.softmax(rng.integers(0, len(inner), (2, 5)), inner, np.repeat(vocab.inner_bias[c][None], 5, 0))
            # all words of the class: the bucket's probability times the share within it
            totals = sum(p[:, b] * 10 ** vocab.share[(vocab.classes == c) & (vocab.buckets == b)].sum() if (own == b).sum() == 1 else p[:, b] * (10 ** vocab.share[(vocab.classes == c) & (vocab.buckets == b)]).sum() for b in set(own.tolist()))
            assert totals == pytest.approx(np.ones(5), abs=1e-5)


def test_tables_grow_with_the_tokens_and_blocks_round_trip():
    sizes = [language_model.Sizes.of(n) for n in (0, 10**8, 10**9, 10**10, 10**12)]
    assert [s.rows for s in sizes] == sorted(s.rows for s in sizes) and sizes[-1].rows > 20 * sizes[0].rows and sizes[1].scale == 1
    rng = np.random.default_rng(1)
    w = language_model.Weights(*(rng.standard_normal(x.shape).astype(np.float32) for x in language_model.Weights.new(sizes[0]).parts()))
    back = language_model.Weights.new(sizes[0])
    for b in range(language_model.BLOCKS):
        back.put(b, w.block(b))
    assert all((x == y).all() for x, y in zip(w.parts(), back.parts(), strict=True))


def test_sums_of_runs_and_shared_features_equal_plain_ones():
    rng = np.random.default_rng(2)
    for n, top in ((0, 5), (1, 5), (700, 3), (700, 400)):
        rows, key = rng.standard_normal((n, 64)).astype(np.float32), rng.integers(0, top, n)
        want = np.zeros((top, 64))
        np.add.at(want, key, rows)
        if n:
            order, first, size = language_model._runs(key)
            got, by = language_model.run_sums(rows, order, size)
            assert len(got) == len(set(key.tolist()))
            assert got == pytest.approx(want[key[order[first[by]]]], abs=1e-4)
    key, other, target = rng.integers(0, 60, 3000), rng.integers(0, 50, 3000), rng.integers(0, 64, 3000)
    features = np.stack([key % 40, 100 + other, 200 + key % 7])
    bias = rng.standard_normal(64).astype(np.float32)
    bias[5] = -1e9
    made = []
    for shared in ((), ((key, (0, 2)),)):
        w, speed = np.zeros((300, 64), np.float32), np.ones(300, np.float32)
        for _ in range(3):
            language_model.descend(target, features, w, speed, bias, shared)
        made.append(w)
    assert made[0] == pytest.approx(made[1], abs=1e-4) and np.abs(made[0]).max() > 0.1
    far = np.array([[900.0] + [0.0] * 63, [-900.0] * 64], np.float32)
    assert language_model.softmax(np.array([[0, 1]]), far, np.zeros(64, np.float32)).sum(1) == pytest.approx([1, 1])


def test_texts_are_looked_up_once(spark, sf, monkeypatch):
    """Rounds and scores read the numbers of ``encode_texts``, which say all that the texts do."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    words = language_model.count_words(language_model.training_rows(docs))
    vocab = language_model.vocabulary(words, 1000)
    told = language_model.encode_texts(docs, vocab, spark.sparkContext.broadcast(vocab)).toArrow().combine_chunks()
    texts = dict(docs.select("doc_id", "text").toPandas().values.tolist())
    batch = told.to_batches()[0]
    known, offsets = language_model._words_of(batch)
    got = language_model.token_features(known, offsets, vocab)
    want = language_model.tokens_of(*language_model.encode(pa.array([texts[i] or "" for i in batch["doc_id"].to_pylist()], pa.large_string()), vocab), vocab)
    assert all((g == w).all() for g, w in zip(got, want, strict=False)) and (known < 0).any()
    later = language_model._words_of(batch.slice(7, 3))
    assert (later[0] == known[offsets[7] : offsets[10]]).all() and (later[1] == offsets[7:11] - offsets[7]).all()


def plain_descent(target, features, weights, speed, bias):
    """``descend`` in double precision, a feature after another."""
    z = weights[features].sum(0) + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(p)), target] -= 1
    for f in features:
        g = np.zeros_like(weights)
        np.add.at(g, f, p)
        used = np.unique(f)
        speed[used] += (g[used] ** 2).mean(1)
        weights[used] -= language_model.STEP / np.sqrt(speed[used])[:, None] * g[used]


def test_exponentials_are_taken_once_a_row(monkeypatch):
    rng, n, seen, real = np.random.default_rng(4), 4000, [], np.exp
    key, kind, target = rng.integers(0, 90, n), rng.integers(0, 5, n), rng.integers(0, 16, n)
    own_rows = np.stack([key % 40, 100 + rng.integers(0, 50, n), 200 + key % 7])
    one_table = np.stack([key % 40, 20 + kind * 9])  # rows in common
    bias = rng.standard_normal((5, 16)).astype(np.float32)
    bias[3, 5] = -1e9
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: (seen.append(x.size), real(x, *a, **k))[1])
    for features, shared, by_kind in ((own_rows, ((key, (0, 2)),), False), (one_table, (), True)):
        for scale in (0.5, 40):  # sums of the second may overflow
            w, speed = (rng.standard_normal((300, 16)) * scale).astype(np.float32), np.ones(300, np.float32)
            want, fast = w.astype(float), speed.astype(float)
            plain_descent(target, features, want, fast, bias[kind] if by_kind else bias[1])
            seen.clear()
            language_model.descend(target, features, w, speed, bias if by_kind else bias[1], shared, kind if by_kind else None)
            assert w == pytest.approx(want, abs=1e-3 * scale) and speed == pytest.approx(fast, rel=1e-3)
            if scale < 1:
                assert sum(seen) <= 16 * (90 + 50 + 5)  # of tables' rows, not of 4,000 tokens
    places = [rng.integers(0, 50, n) for _ in range(4)]
    for scale in (0.5, 40):
        tables = [(rng.standard_normal((50, 16)) * scale).astype(np.float32) for _ in places]
        safe = language_model.are_safe(tables)
        assert safe == (scale < 1)
        terms = list(zip([real(t) for t in tables] if safe else tables, places, strict=True))
        z = sum(t[f].astype(float) for t, f in zip(tables, places, strict=True))
        p = real(z - z.max(1, keepdims=True))
        p = np.log10(np.maximum(p[np.arange(n), target] / p.sum(1), 1e-30))
        assert language_model.target_logs(terms, target, safe) == pytest.approx(p, abs=1e-3)


def test_head_words_are_found_by_keys(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    words = language_model.count_words(language_model.training_rows(docs))
    vocab = language_model.vocabulary(words, 1000)
    probe = pa.array(["", "zz zz", "naïve", *vocab.head.to_pylist()[::-3], "unseenword"], pa.large_string())
    want = pa.compute.fill_null(pa.compute.index_in(probe, value_set=vocab.head), -1).to_pylist()
    assert max(want) > 100 and min(want) == -1
    with monkeypatch.context() as patch:
        patch.setattr(pa.compute, "index_in", None)  # it hashes the whole head at each call
        found, codes, place, _ = language_model.encode(pa.array([" ".join(probe.to_pylist())], pa.large_string()), vocab)
        assert vocab.places(probe).tolist() == want and len(codes) == len(probe)
        assert vocab.places(probe.slice(3, 9)).tolist() == want[3:12]
    monkeypatch.setattr(language_model, "string_keys", lambda text: np.zeros(len(text), np.uint64))
    alike = language_model.vocabulary(words, 1000)
    assert not len(alike.keys) and alike.places(probe).tolist() == want
    # a word that isn't in the head but has the key of one that is
    vocab.keys[:] = 0
    assert vocab.places(pa.array(["unseenword"], pa.large_string())).tolist() == [-1]
