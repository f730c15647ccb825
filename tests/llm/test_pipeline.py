import numpy as np
import pyarrow as pa
import pytest
from test_ngram_join import brute
from test_text_operators import brute_rules, crc

import corpus_pipeline
from tidewater.llm import gam, packing
from tidewater.llm.encode import default_path, tokenizer


def test_pipeline_equals_its_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [r for r in docs.collect() if not brute_rules(r.text)[5]]
    rows = [r for r in rows if 100 * sum(map((r.text or "").count, "#*$%&|<>")) <= 8 * brute_rules(r.text)[1]]
    stay = spark.createDataFrame(rows, docs.schema)
    model = gam.train(stay, labels.filter(~gam.held_out()), "quality")
    good = model.score(gam.features(pa.array([r.text or "" for r in rows], pa.large_string()))) >= gam.THRESHOLD
    rows = [r for r, ok in zip(rows, good, strict=True) if ok]
    groups, _ = brute([(r.doc_id, r.text) for r in rows], 5, 80)
    keep = {i for i, _, c in groups if i == c}
    library = tokenizer(default_path(packing.VOCABULARY))
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows if r.doc_id in keep}
    got = corpus_pipeline.run(spark, sf).collect()
    assert sum(p.length for p in got) == sum(map(len, ids.values()))
    assert {p.doc_id for p in got} == set(ids)
    for p in got:
        assert crc(ids[p.doc_id][p.start : p.start + p.length]) == p.ids_crc32


def test_stages_keep_columns_and_odd_rows(spark, sf):
    text = "all these plain words make a fine and proper text here with more of them behind"
    data = [(1, text, "en", "a", 1, 7, "x", 0.5), (1, text, "en", "a", 1, 7, "x", 0.5), (None, text, None, None, None, None, None, None), (2, None, "en", "a", 1, 7, "x", 0.5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_words long, host string, score double")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:3]:
            out = stage(spark, table, sf)
            assert out.schema == docs.schema, name
            got = out.collect()
            if table is docs:
                want = {"quality_rules": 3, "near_duplicates": 3}.get(name)
                assert want is None or len(got) == want
            else:
                assert got == []


def sample(n, seed):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "plain", "words", "text", "and", "with", "more"] + [f"word{chr(97 + i)}" for i in range(20)]
    out = []
    for i in range(n):
        w = list(rng.choice(words, rng.integers(15, 90)))
        bad = i % 3 == 0
        if bad:
            w = [x + "!!" for x in w] if i % 2 else [x.upper() for x in w]
        out.append((i, " ".join(w), int(not bad)))
    return out


def test_classifier_learns_and_holds_out(spark):
    data = sample(600, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(None, None), (7000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = gam.classify(docs, labels).collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: q for i, _, q in data}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in gam.classify(docs, none).collect()] == [pytest.approx(0.5)]
    assert gam.classify(docs.limit(0), none).count() == 0


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((6000, len(gam.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = gam.fit(x[:4000], y[:4000])
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[4000:]) > 0.5) == y[4000:]) > 0.9


def test_packing_stage_takes_odd_rows(spark, sf):
    text = "all these plain words make a fine and proper text"
    data = [(1, text, "x"), (1, text, "x"), (None, text, None), (2, None, "y"), (3, "word " * 9000, "y")]
    docs = spark.createDataFrame(data, "doc_id long, text string, sequence_id string")
    name, stage = corpus_pipeline.STAGES[3]
    library = tokenizer(default_path(packing.VOCABULARY))
    got = stage(spark, docs, sf).collect()
    sizes = {i: sum(p.length for p in got if p.doc_id == i) for i in (1, 2, 3, None)}
    n = len(library.encode(text, add_special_tokens=False).ids) + 1
    assert name == "packing" and sizes == {1: 2 * n, 2: 1, 3: 9001, None: n}
    assert stage(spark, docs.limit(0), sf).count() == 0


def brute_features(text):
    """The classifier's features by plain counting."""
    import collections
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    n_words, chars, _, dup, repeats, _ = brute_rules(text)
    lines = len([x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")])
    w, c = max(n_words, 1), max(chars, 1)
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    mean = chars / w
    squares = sum(len(x) ** 2 for x in words)
    other = len(re.findall(r"[^\x20\x09-\x0dA-Za-z0-9#*$%&|<>!.,;:\x80-\U0010ffff]", text))
    top = max(collections.Counter(words).values(), default=0)
    return [
        np.log1p(n_words), mean, np.sqrt(max(squares / w - mean**2, 0)), repeats / w, dup / max(lines, 1), len(re.findall(r"[#*$%&|<>]", text)) / c,
        upper / max(upper + lower, 1), len(re.findall("[0-9]", text)) / c, text.count("!") / w, len(re.findall("[.,;:]", text)) / w,
        other / c, len(re.findall("[\x80-\U0010ffff]", text)) / c, len(set(words)) / w, top / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        n_words / max(lines, 1),
    ]


def test_quality_scores_equal_brute_force(spark, sf):
    """Features by plain counting, tables looked up one by one."""
    import bisect
    import math

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = gam.train(docs, labels.filter(~gam.held_out()), "quality")
    got = {r.doc_id: r for r in gam.classify(docs, labels).collect()}
    for r in docs.collect():
        x = [np.float32(v) for v in brute_features(r.text)]
        total = model.base + sum(t[bisect.bisect_right(e, v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
        total += sum(t[bisect.bisect_right(model.pair_edges[i], x[i]), bisect.bisect_right(model.pair_edges[j], x[j])] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        want = 1 / (1 + math.exp(-total))
        assert abs(got[r.doc_id].score - want) < 1e-6 and got[r.doc_id].predicted == (want >= 0.3)
