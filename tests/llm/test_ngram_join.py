import itertools
import random
import re

import pytest

from tidewater.llm import ngram_join
from tidewater.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def sets(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent):
    best = {}
    for i, t in rows:
        if i is not None:
            best.setdefault(i, set()).add(sets(t, width))
    parent = {i: i for i in best}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(best.items(), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in a for y in b):
            lo, hi = sorted((find(i), find(j)))
            parent[hi] = lo
    return sorted((i, len(sets(t, width)), None if i is None else find(i)) for i, t in rows if i is not None), sum(i is None for i, _ in rows)


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of"] * 60
    passage = [rng.choice(vocab) for _ in range(60)]
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n * 3 % 1009 + 1, " ".join(words)))
        n += 1

    base = [rng.choice(vocab) for _ in range(120)]
    for _ in range(90):  # a crowd of near copies, more than FREQUENT
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        add(w)
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(1, 80))]
        add(w)
        add(w[:-1] + ["END"])
        add([*w, "more"])
    for _ in range(40):
        add(passage + [rng.choice(vocab) for _ in range(rng.randrange(0, 25))])
    rows += [(2001, None), (2002, ""), (2003, " \n\t"), (2004, "a"), (2005, "A"), (2006, "a b c"), (None, "a b c"), (2006, "a b c"), (2007, "a b c d"), (2008, rows[0][1]), (2008, rows[120][1]), (2009, "A B\tC")]
    return rows


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_equals_brute_force(spark, width, percent):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(5)
    got, _ = ngram_join.similar_documents(df, width, percent)
    got = got.collect()
    want, nulls = brute(rows, width, percent)
    assert sum(r.doc_id is None and r.component_id is None for r in got) == nulls
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == want


def test_similar_members_of_a_group_whose_head_is_similar_to_neither(spark):
    rng = random.Random(9)
    rows = []
    for k in range(60):  # shingles of a passage are in no other three: often all of the prefix
        word = lambda: f"p{k}x{rng.randrange(10**6)}"  # noqa: E731, B023
        passage, tail = [word() for _ in range(20)], [word() for _ in range(5)]
        texts = [passage + [word() for _ in range(5)], passage + tail, [*passage, *tail[:-1], word()]]
        rows += [(3 * k + i + 1, " ".join(t)) for i, t in enumerate(texts)]
    got, _ = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    want, _ = brute(rows, 5, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want


def test_documents_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want, _ = brute([(r.doc_id, r.text) for r in df.collect()], 4, 85)
    got, _ = ngram_join.similar_documents(df)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want


def test_empty_table(spark):
    got, _ = ngram_join.similar_documents(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: find(i) for i in touched}
