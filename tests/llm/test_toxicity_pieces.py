import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import pieces, toxicity
from tidewater.llm.encode import default_path
from tidewater.llm.registry import QUERIES

PATH = default_path(pieces.VOCABULARY)
TEXTS = ["Hello  world", "  lead", " trail ", "a\tb\nc", "é ﬁ① Ａ", "　x", "<s>hi</s>", "", " ", "   ", "日本 語", "a▁b", "▁x", "\x00z", "😀 smile😀", "x" * 400 + " end", " " * 60 + "far", None, "the the the", "ñandú über"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("head", [0, 4, 1 << 18])
def test_pieces_equal_the_library(spark, head):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "y")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r for r in pieces.encode_documents(docs, head_units=head).withColumn("back", pieces.decode(F.col("ids"))).collect()}
    sp = pieces.processor(PATH)
    for i, t in enumerate(TEXTS):
        want = sp.encode(t or "")
        assert got[i]["ids"] == want, t
        assert got[i]["ids_crc32"] == crc(want)
        assert got[i]["back"] == (t or "").replace("▁", " ")
    assert got[None]["ids"] == sp.encode("a b")


def test_pieces_query(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op9_sentencepiece"](spark, sf).collect()}
    sp = pieces.processor(PATH)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = sp.encode(r["text"] or "")
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"], got[r["doc_id"]]["round_trip"]) == (len(want), crc(want), True)


def test_pieces_of_an_empty_table(spark):
    assert pieces.encode_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_viterbi_equals_brute_force(spark):
    table = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.5, "aba": -4.2, "bab": -6.0, "abab": -9.0}
    pairs = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(table.items())], "id int, piece string, score double")
    words = ["abab", "aab", "bbb", "ababa", "axb", "baab"]

    def best(w):
        if not w:
            return 0.0, []
        options = []
        for k in range(1, len(w) + 1):
            cost = table.get(w[-k:], -50.0 if k == 1 else None)
            if cost is not None:
                s, p = best(w[:-k])
                options.append((s + cost, k, [*p, w[-k:]]))
        top = max(options, key=lambda o: (o[0], o[1]))
        return top[0], top[2]

    units = spark.createDataFrame([(w, 1) for w in words], "unit string, times bigint")
    got = {r["unit"]: r["ids"] for r in pieces.encode_units(units, pairs, "viterbi", 4, None, 99, -50.0).collect()}
    place = {p: i for i, p in enumerate(table)}
    assert got == {w: [place.get(p, 99) for p in best(w)[1]] for w in words}


def model(words):
    counts = np.ones((28, 28, 28)) * 0.01
    for w in words:
        a = b = 0
        for c in [*map(toxicity.symbol, w), 0]:
            counts[a, b, c] += 1
            a, b = b, c
    return np.log(counts / counts.sum(2, keepdims=True))


WORDS = ["idiot", "worthless", "the", "house", "loser", "clown"]


@pytest.mark.parametrize("token,word", [("1d10t", "idiot"), ("idi0t", "idiot"), ("!diot", "idiot"), ("i.d.i.o.t", "idiot"), ("idiiiiot", "idiot"), ("w0rthl3$$", "worthless"), ("l0$er", "loser"), ("cl*wn", "clown"), ("house", "house")])
def test_restore(token, word):
    assert toxicity.restore(token, model(WORDS)) == word


def test_evidence_counts_distinct_words():
    found = toxicity.Restorer(["idiot", "loser"], model(WORDS))
    texts = pa.array(["You IDIOT, idiot!", "i d i o t here", "1d10t l0ser", "a clean text of 12 words", "", "l o s e r", "x " * 5000 + "idiiiot."], pa.large_string())
    assert np.diff(found.evidence(texts)[1]).tolist() == [1, 1, 2, 0, 0, 1, 1]


def test_toxicity_finds_disguised_words(spark):
    rng = np.random.default_rng(3)
    base = ["the", "and", "of", "house", "water", "green", "stone", "river"]
    rows, marks = [], []
    for i in range(600):
        words = list(rng.choice(base, 30))
        if toxic := i % 6 == 0:
            words[5:5] = ["moron", "scum"]
        rows.append((i, " ".join(words) + f" {i}"))
        marks.append((i, 0, int(toxic)))
    rows += [(1000, "you m0r0n of the house"), (1001, "m o r o n water"), (1002, "the river is 100 m long"), (1003, None), (1004, ""), (None, "scum")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame(marks + [(5000, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, None)] == [1, 1, 0, 0, 0, 1]
    assert all(got[i]["predicted"] == int(i % 6 == 0) for i in range(600))
    assert all(r["score"] == 0.5 for r in toxicity.classify(docs, labels.limit(0)).collect())
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_neighbours_stay_apart_as_in_the_library():
    sp, table = pieces.processor(PATH), pieces.piece_rows(PATH)
    merges, names, ids = pieces.Merges(table), table["piece"].to_pylist(), table["id"].to_numpy()
    rng = np.random.default_rng(4)
    left, right = rng.integers(0, len(names), (2, 3000))
    # pairs that split a piece in two, which must never stay apart
    long = [i for i, n in enumerate(names) if len(n) > 3][:2000]
    place = {n: i for i, n in enumerate(names)}
    split = [(place[n[:2]], place[n[2:]]) for n in (names[i] for i in long) if n[:2] in place and n[2:] in place]
    left, right = np.concatenate([left, [a for a, _ in split]]), np.concatenate([right, [b for _, b in split]])
    got = merges.apart(left, right)
    want = [pieces.unit_by_library(names[a] + names[b], PATH) == [ids[a], ids[b]] for a, b in zip(left, right, strict=True)]
    assert got.tolist() == want and not got[3000:].any()


def test_repeated_and_long_texts(spark):
    texts = ["wordy " * 30000, "ab" * 3000, "x" * 5000 + " y", "日" * 3000, None]
    docs = spark.createDataFrame([(i % 3, t, 1) for i, t in enumerate(texts * 2)], "doc_id bigint, text string, given int").repartition(3)
    got = sorted((r["doc_id"], r["ids"]) for r in pieces.encode_documents(docs, head_units=2).collect())
    sp = pieces.processor(PATH)
    assert got == sorted((i % 3, sp.encode(t or "")) for i, t in enumerate(texts * 2))


def brute_restore(token, model):
    """The likeliest of all readings of a token, one by one."""
    readings = [("", 0.0)]
    before = ""
    for c in token:
        emit = [(c, 0.0)] if c.isalpha() else [(x, toxicity.AS_SIGN if len(toxicity.SIGNS[c]) < 3 else toxicity.AS_WILD) for x in toxicity.SIGNS.get(c, "")]
        if not emit and c not in toxicity.SEPARATORS:
            emit = [(c, 0.0)]
        if c == before:
            emit.append(("", toxicity.REPEATED))
        elif c in toxicity.SEPARATORS or c in "!*#":
            emit.append(("", toxicity.DROPPED))
        readings = [(t + x, p + q) for t, p in readings for x, q in emit]
        before = c

    def cost(text):
        total, a, b = 0.0, 0, 0
        for s in [*map(toxicity.symbol, text), 0]:
            total += model[a, b, s]
            a, b = b, s
        return total

    return max(p + cost(t) for t, p in readings), {t: p + cost(t) for t, p in readings}


def test_restore_equals_brute_force():
    rng, m = np.random.default_rng(8), model(WORDS)
    for _ in range(300):
        token = "".join(rng.choice(list("idotlser104!$.-_|7") + (["*"] if rng.random() < 0.3 else []), rng.integers(1, 6)))
        best, all_ = brute_restore(token, m)
        assert abs(max(v for t, v in all_.items() if t == toxicity.restore(token, m)) - best) < 1e-9, token


def test_scores_equal_the_odds_of_the_words_found(spark, sf):
    """Scores of all documents from the labelled rows' evidence, in plain Python."""
    import math

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    learned = labels.filter(~toxicity.held_out())
    lexicon, _ = toxicity.learn_lexicon(docs, learned)
    m = toxicity.character_model(docs, lexicon)
    finder = toxicity.Restorer(lexicon, m)
    rows = docs.collect()
    found = {}
    for r in rows:
        places, _, _ = finder.evidence(pa.array([r.text or ""], pa.large_string()))
        found[r.doc_id] = set(places.tolist())
    marked = [(r.doc_id, r.toxic) for r in learned.collect() if r.toxic is not None and r.doc_id in found]
    n, k = len(marked), sum(t for _, t in marked)
    bare = [t for i, t in marked if not found[i]]
    with_n = collections.Counter(w for i, _ in marked for w in found[i])
    with_k = collections.Counter(w for i, t in marked if t for w in found[i])

    def ratio(w, toxic=0, clean=0):
        a, b = with_k[w] - toxic + 0.5, with_n[w] - with_k[w] - clean + 0.5
        return math.log(a / (k - toxic + 1)) - math.log(b / (n - k - clean + 1))

    x = np.array([math.floor(4 * sum(ratio(w, t, 1 - t) for w in found[i]) + 0.5) / 4 for i, t in marked if found[i]])
    y = np.array([t for i, t in marked if found[i]])
    shift, slope = 0.0, 1.0
    for _ in range(20000):  # plain steps uphill
        p = 1 / (1 + np.exp(-(shift + slope * x)))
        shift += 0.05 * ((y - p).sum() - 0.01 * shift) / len(y)
        slope += 0.05 * (((y - p) * x).sum() - (slope - 1)) / (x @ x)
    want = {}
    for i, words in found.items():
        total = sum(ratio(w) if with_n[w] else math.log(toxicity.RATIO) for w in words)
        want[i] = 1 / (1 + math.exp(-(shift + slope * total))) if words else (sum(bare) + k / n) / (len(bare) + 1)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i].score - want[i]) < 0.01 and got[i].predicted == (got[i].score >= 0.3) for i in want)


def test_short_words_and_signs_at_the_end():
    found = toxicity.Restorer(["ass", "idiot", "clown"], model([*WORDS, "ass"]))
    texts = pa.array(["a s s", "you idio7###", "clow^ idio+", "as a sack", "a s s o c"], pa.large_string())
    assert [finding > 0 for finding in np.diff(found.evidence(texts)[1])] == [True, True, True, False, False]


def test_rare_units_are_dealt_once(spark):
    """Units meet their texts without being shuffled again; long ones that all
    texts hold are dealt in parts and have the library's ids."""
    long = "".join(chr(97 + i * i % 23) for i in range(90))
    rows = [(i, f"the {long} of {long[i:]} w{i} end") for i in range(40)] + [(100, "x" * 3000), (101, "x" * 3000), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for head in (0, 20):
        made = pieces.encode_documents(df, head_units=head)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner") == 1  # with the vocabulary
        got = {r.doc_id: list(r.ids) for r in made.collect()}
        sp = pieces.processor(pieces.default_path(pieces.VOCABULARY))
        assert got == {i: sp.encode(t or "") for i, t in rows}


def test_codes_round_trip():
    rng = np.random.default_rng(4)
    for top in (0, 191, 192, 193, 192 + 63 * 256 - 1, 192 + 63 * 256, 1 << 19, (1 << 24) - 1):
        for n in (0, 1, 2, 5000):
            codes = rng.integers(0, top + 1, n)
            codes[:1] = top
            assert (pieces.unpack_codes(pieces.pack_codes(codes)) == codes).all()
