import collections
import re
import zlib

import numpy as np
import pytest

from tidewater.llm import packing, quality_rules, token_counts, token_files
from tidewater.llm.encode import default_path, tokenizer
from tidewater.llm.shared import scratch_path

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [
    (1, None, "a", None, "x"),
    (2, "", "a", None, "x"),
    (3, "one two three four five one two three four five one\n\n one\none\n one", None, None, "x"),
    (3, "one two three four five one two three four five one\n\n one\none\n one", None, None, "x"),
    (None, "a<|endoftext|> b  <|endoftext|>c don't It's x  y \x1c z　 q́ İI #*$%&|<>", "b", None, None),
    (5, "  lead\n\ttail  \n", "b", 3, "x"),
    (6, "word " * 9000 + "ÉÀ straße, Σας ΟΔΟΣ", "b", 3, "x"),
    (7, " ", "b", 3, "x"),
    (8, "a  b   c\n d", "b", 3, "x"),
    (9, "<|startoftext|><|ENDOFTEXT|> it'll, it'll.. 's 12,3!", "b", 3, "x"),
]
SCHEMA = "doc_id long, text string, source string, row long, shard string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def rows(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    failed = len(words) < 10 or 100 * len(cover) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_quality_rules(request, table):
    df = request.getfixturevalue(table)
    want = collections.Counter((r.doc_id, *brute_rules(r.text)) for r in df.collect())
    got = quality_rules.judge(df)
    assert rows(got, "doc_id", *(c for c in quality_rules.COUNTS if c != "n_lines"), "base_failed") == want
    assert all(not r.kept for r in got.collect() if r.base_failed)


def test_host_verdict_follows_the_shrunk_rate(spark):
    good, bad = "all these plain words make a fine and proper text here", "# $ % #"
    data = [(i, bad if i % 10 else good, "bad") for i in range(200)] + [(1000 + i, good, f"h{i % 9}") for i in range(300)] + [(5000, bad, "h1")]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(200)) and all(got[1000 + i] for i in range(300)) and not got[5000]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judge(none).count() == 0
    assert token_counts.count_tokens(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    out = scratch_path(spark, "none")
    token_files.write_tokens(none, out, shards=3)
    assert token_files.read_tokens(spark, out).count() == 0


@pytest.mark.parametrize("head", [0, 20, 1 << 19])
def test_token_counts_equal_the_library(odd, docs, head):
    library = tokenizer(default_path(token_counts.VOCABULARY))
    for df in (odd, docs):
        want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        assert rows(token_counts.count_tokens(df, head_units=head), "doc_id", "n_bytes", "n_tokens") == want


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, odd, docs, encoding):
    library = tokenizer(default_path(token_files.VOCABULARY))
    for df in (odd, docs):
        out = scratch_path(spark, "tokens")
        token_files.write_tokens(df, out, shards=5, encoding=encoding)
        want, start = collections.Counter(), 0
        for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")):
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
            want[r.doc_id, start, len(ids), crc(ids)] += 1
            start += len(ids)
        assert rows(token_files.digest(token_files.read_tokens(spark, out)), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_token_files_decode(spark):
    df = spark.createDataFrame([(1, "plain words, again"), (2, "more of them")], "doc_id long, text string")
    out = scratch_path(spark, "tokens")
    token_files.write_tokens(df, out, shards=2, end_id=None)
    got = {r.doc_id: r.text.replace(" ", "") for r in token_files.decode_tokens(token_files.read_tokens(spark, out)).collect()}
    assert {k: v.replace("</w>", "") for k, v in got.items()} == {1: "plainwords,again", 2: "moreofthem"}


def test_packing_covers_every_id_once(odd, docs):
    library = tokenizer(default_path(packing.VOCABULARY))
    for df in (odd, docs):
        ids = collections.defaultdict(list)
        for r in df.collect():
            ids[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 1])
        got = packing.pack_documents(df).collect()
        covered = collections.Counter()
        for p in got:
            whole = next(x for x in ids[p.doc_id] if len(x) == p.doc_tokens and crc(x[p.start : p.start + p.length]) == p.ids_crc32)
            covered.update((p.doc_id, p.doc_tokens, i) for i in range(p.start, p.start + p.length))
            assert whole
        want = collections.Counter((k, len(x), i) for k, v in ids.items() for x in v for i in range(len(x)))
        assert covered == want
        sequences = collections.defaultdict(list)
        for p in got:
            sequences[p.sequence_id].append((p.offset, p.length))
        for s in sequences.values():
            end = 0
            for offset, length in sorted(s):
                assert offset == end
                end += length
            assert end <= 2048
            assert end == 2048 or end & (end - 1) == 0


def test_examples_keep_all_three_limits(spark):
    rng = np.random.default_rng(3)
    data = [(i, int(t), int(t * rng.random())) for i, t in enumerate(rng.integers(0, 900, 700))]
    limits = packing.Limits(2048, 5, 900)
    got = packing.pack_examples(spark.createDataFrame(data, "example_id long, tokens long, loss_tokens long").coalesce(1), limits).collect()
    assert len(got) == 700
    by = collections.defaultdict(list)
    for r in got:
        assert (r.sequence_id is None) == (r.tokens == 0)
        by[r.sequence_id].append(r)
    by.pop(None, None)
    for s in by.values():
        assert sum(r.tokens for r in s) <= 2048 and len(s) <= 5 and sum(r.loss_tokens for r in s) <= 900
    tokens, loss = sum(r[1] for r in data), sum(r[2] for r in data)
    assert len(by) <= 1.3 * max(tokens / 2048, loss / 900, 700 / 5)


def test_slices_lower_as_a_whole():
    import pyarrow as pa
    import pyarrow.compute as pc

    from tidewater.llm import shared

    batch = pa.RecordBatch.from_arrays([pa.array(["Aé b", None, "", "C" * 50, "dE F"])], names=["text"])
    for a in range(5):
        text = shared.clean_text(batch.slice(a))
        text.validate(full=True)
        lower = pc.ascii_lower(text)
        lower.validate(full=True)
        assert lower.to_pylist() == [(t or "").lower() for t in batch.column("text").to_pylist()[a:]]


def test_examples_over_a_limit_get_no_place(spark):
    data = [(1, 100, 3000, "x"), (2, 9000, 0, "x"), (3, 10, 5, "x"), (3, 10, 5, "x"), (None, 7, None, None), (5, None, 4, "x"), (6, -4, -4, "x")]
    frame = spark.createDataFrame(data, "example_id long, tokens long, loss_tokens long, offset string").coalesce(1)
    got = packing.pack_examples(frame).collect()
    assert collections.Counter((r.example_id, r.tokens, r.sequence_id is None) for r in got) == collections.Counter(
        {(1, 100, True): 1, (2, 9000, True): 1, (3, 10, False): 2, (None, 7, False): 1, (5, None, True): 1, (6, -4, True): 1}
    )
    assert packing.pack_examples(frame.filter("tokens = 1")).count() == 0
    with pytest.raises(ValueError):
        packing.Limits(loss_tokens=0)


@pytest.mark.parametrize("loss_limit", [2048, 300, 1])
def test_cut_examples_keep_all_limits(loss_limit):
    rng = np.random.default_rng(5)
    masks = [rng.random(int(n)) < p for n, p in zip(rng.integers(0, 6000, 60), rng.choice([0.0, 0.05, 1.0], 60), strict=True)]
    sums = [np.concatenate([[0], np.cumsum(m)]) for m in masks]
    limits = packing.Limits(2048, 5, loss_limit)
    pieces, _, rest = packing.pack(np.array([len(m) for m in masks]), np.array([m.sum() for m in masks]), limits, sums=sums)
    covered = collections.Counter((p.item, j) for p in pieces for j in range(p.start, p.start + p.length))
    assert not rest and covered == collections.Counter((i, j) for i, m in enumerate(masks) for j in range(len(m)))
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.sequence].append(p)
    for s in by.values():
        assert sum(p.length for p in s) <= 2048 and len(s) <= 5
        assert sum(sums[p.item][p.start + p.length] - sums[p.item][p.start] for p in s) <= loss_limit


def test_repeated_lines_bear_no_loss(spark):
    data = [(1, "one line\nanother\n one line\none line\n\n\nanother"), (2, "same"), (3, None)]
    plain = collections.Counter()
    for p in packing.pack_documents(spark.createDataFrame(data, "doc_id long, text string").coalesce(1)).collect():
        plain[p.doc_id] += p.length - p.loss_tokens  # a document may be cut
    assert plain == {1: 3, 2: 0, 3: 0}


def test_conversations_are_packed_under_three_limits(spark, sf):
    from tidewater.llm import registry

    got = registry.pack_conversations(spark, sf).collect()
    turns = collections.defaultdict(lambda: [0, 0])
    library = tokenizer(default_path(packing.VOCABULARY))
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
        turns[r.conv_id][0] += n
        turns[r.conv_id][1] += n * (r.role == "assistant")
    assert {r.example_id: [r.tokens, r.loss_tokens] for r in got} == turns
    by = collections.defaultdict(list)
    for r in got:
        assert (r.sequence_id is None) == (r.tokens > 2048 or r.loss_tokens > 1024)
        by[r.sequence_id].append(r)
    by.pop(None, None)
    for s in by.values():
        assert sum(r.tokens for r in s) <= 2048 and sum(r.loss_tokens for r in s) <= 1024 and len(s) <= 8


def test_encoder_of_another_vocabulary_and_of_clashing_keys(monkeypatch):
    import pyarrow as pa

    from tidewater.llm import encode

    texts = ["Hello world, the End", "  a\tb\n", "", "straße, ÉÀ!"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = tokenizer(default_path(name))
        for clash in (False, True):
            if clash:
                monkeypatch.setattr(encode, "string_keys", lambda a: np.arange(len(a), dtype=np.uint64) % np.uint64(2))
            ids, bounds = encode.ChunkEncoder(default_path(name)).encode(pa.array(texts, pa.large_string()), None)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        monkeypatch.undo()


def test_token_files_are_read_in_part(spark, docs):
    out = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, out, shards=4)
    some = token_files.read_some(spark, out, 50, 59)
    assert {r.doc_id for r in some.collect()} == {r.doc_id for r in docs.filter("doc_id between 50 and 59").collect()}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,50)" in plan
    plan = token_files.read_metadata(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan
