"""Toxicity by a noisy channel: disguised words are restored, then scored.

1.  A character language model (trigrams, all texts) gives the prior of letters.
2.  The labelled rows give a lexicon: words found in texts marked toxic far more
    often than in others (likelihood ratio), and stems; copied passages count once.
3.  A token that looks disguised (signs for letters, drawn-out letters, single
    letters with gaps) is a lattice of characters: each sign may stand for
    letters, a repeated letter or a separator may stand for nothing.  Viterbi
    finds the likeliest letters under the language model.
4.  The distinct lexicon words of the restored text are a document's evidence.
    Each has a log odds ratio, learned from the evidence of the labelled rows.
    The score is a logistic function of their sum, fitted to sums for which each
    labelled row's own part was left out; without evidence it is the share of
    toxic rows among labelled ones without any.

Only counts are shuffled: by character trigram, by word of labelled rows and
its neighbours, by word of the evidence.  The lexicon holds ``LEXICON`` words at most and is learned
from ``SAMPLE_ROWS`` labelled rows at most (bounds of the fit); all texts are
scored and no text is shuffled.

Defined cases: a null or empty text has no evidence and the score of that; null
labels are not learned from; without labelled rows every score is 0.5; repeated
rows are scored one by one; rows with a null id are not held out; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.gam import bucket
from tidewater.llm.shared import clean_text, materialize, owner, split_words, text_slices

LEXICON = 4096
#: The lexicon is learned from at most so many labelled rows, those with the
#: smallest hash of their id; rates by evidence use all of them.
SAMPLE_ROWS = 40_000
#: Shortest word that is looked for inside a run of single letters; shorter ones
#: must be the whole run.
INSIDE = 4
#: A word of the lexicon is this many times as frequent in toxic texts.
RATIO = 8.0
#: A stem is kept if at most this share of its uses is in other texts.
IMPURE = 0.01
#: Share of the language model's counts that the lexicon's words get.
BOOST = 0.05
#: Lengths of stems that can be learned besides whole words.
STEMS = (4, 5, 6)
THRESHOLD = 0.3

#: Signs that stand for letters.
SIGNS = {
    "4": "a", "@": "a", "^": "a", "8": "b", "(": "c", "3": "e", "€": "e", "6": "g", "9": "g", "1": "il", "!": "i", "|": "il",
    "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z", "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz",
}
SEPARATORS = ".-_*~'`,/\\:;·"
#: Log probabilities of the channel.
AS_SIGN, AS_WILD, REPEATED, DROPPED = math.log(0.1), math.log(0.01), math.log(0.3), math.log(0.3)
EDGE, OTHER, SYMBOLS, INNER = 0, 27, 28, -1

#: Something within letters that isn't one, a sign at an end, or drawn-out letters.
DISGUISED = r"(\p{L}[^\p{L}\s]+\p{L})|(^[0-9@$!|+(€*#^][^\s]*\p{L})|(\p{L}[0-9@$€+^(]+[^\p{L}\p{N}\s]*$)" + "".join(f"|{c}{c}{c}" for c in "abcdefghijklmnopqrstuvwxyz")
MARKS = ".,;:!?\"'()[]{}*#$%&|<>-_~"


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER


def _byte_codes() -> np.ndarray:
    """Symbols by byte: a character of several bytes is one OTHER, its first byte."""
    codes = np.full(256, OTHER, np.int64)
    codes[0x80:0xC0] = INNER
    codes[97:123] = np.arange(1, 27)
    codes[list(b" \t\n\x0b\x0c\r")] = EDGE
    return codes


_CODES = _byte_codes()


def trigram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for whole in batches:
        for batch in text_slices(whole):
            text = pc.ascii_lower(clean_text(batch))
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            cuts = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)
            codes = np.insert(_CODES[data], cuts[1:], EDGE) if len(data) else np.zeros(len(text), np.int64)
            codes = codes[codes != INNER]
            # an edge stands for both symbols before a word
            a, b, c = (np.concatenate([np.zeros(k, np.int64), codes])[: len(codes)] for k in (2, 1, 0))
            a = np.where(b == EDGE, EDGE, a)
            kept = ~((b == EDGE) & (c == EDGE))
            total += np.bincount(((a * SYMBOLS + b) * SYMBOLS + c)[kept], minlength=len(total))
    found = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])


def character_model(docs: DataFrame, lexicon: list[str]) -> np.ndarray:
    """log P(c | a, b) as a cube, from all texts and the lexicon's words."""
    sent = docs.select("text").mapInArrow(trigram_batches, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # 28**3 rows at most
    counts = np.zeros(SYMBOLS**3)
    counts[sent["gram"].to_numpy()] = sent["n"].to_numpy()
    counts = counts.reshape((SYMBOLS,) * 3)
    own = np.zeros_like(counts)
    for word in lexicon:
        a = b = EDGE
        for c in [*map(symbol, word.rstrip("*")), *([] if word.endswith("*") else [EDGE])]:
            own[a, b, c] += 1
            a, b = b, c
    if lexicon:
        counts += own * (BOOST * (counts.sum() + 1000) / own.sum())
    pairs = counts.sum(0)
    back = (pairs + 0.5) / (pairs.sum(1, keepdims=True) + 0.5 * SYMBOLS)
    return np.log((counts + 5 * back[None]) / (counts.sum(2, keepdims=True) + 5))


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest letters behind a token (lower case); other characters
    stand for themselves."""
    best: dict[tuple[int, int], tuple[float, str]] = {(EDGE, EDGE): (0.0, "")}
    before = ""
    for c in token:
        emit = [(c, 0.0)] if c.isalpha() else [(x, AS_SIGN if len(SIGNS[c]) < 3 else AS_WILD) for x in SIGNS.get(c, "")]
        if not emit and c not in SEPARATORS:
            emit = [(c, 0.0)]
        new: dict[tuple[int, int], tuple[float, str]] = {}
        skip = REPEATED if c == before else DROPPED if c in SEPARATORS or c in "!*#" else None
        for (a, b), (cost, text) in best.items():
            for x, p in emit:
                s = symbol(x)
                value = cost + p + model[a, b, s]
                if (found := new.get((b, s))) is None or value > found[0]:
                    new[b, s] = (value, text + x)
            if skip is not None:
                value = cost + skip
                if (found := new.get((a, b))) is None or value > found[0]:
                    new[a, b] = (value, text)
        best, before = new, c
    return max((cost + model[a, b, EDGE], text) for (a, b), (cost, text) in best.items())[1]


class Restorer:
    """Looks lexicon words up in plain, disguised and spaced-out tokens."""

    def __init__(self, lexicon: list[str], model: np.ndarray):
        self.finder = Finder(lexicon)
        self.words, self.place = self.finder.words, self.finder.place
        self.inside = re.compile("|".join(map(re.escape, sorted((w for w in lexicon if len(w) >= INSIDE and w[-1] != "*"), key=len, reverse=True))) or r"(?!)")
        self.decode = lru_cache(100_000)(lambda t: restore(t, model))

    def evidence(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the lexicon of each text's distinct lexicon words, one after
        another; their bounds; and how often such words occur in each text."""
        n = len(text)
        flat, offsets = split_words(pc.utf8_lower(text))
        if not len(flat) or not len(self.words):
            return np.empty(0, np.int64), np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
        encoded = flat.dictionary_encode()
        words, codes = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        bare = pc.utf8_trim(words, characters=MARKS)
        place = self.finder.one_of(bare).copy()
        odd = pc.match_substring_regex(words, DISGUISED).to_numpy(zero_copy_only=False) & (place < 0)
        for i in np.nonzero(odd)[0]:
            token = words[int(i)].as_py()
            for form in dict.fromkeys((token, token.strip(".,;:!?\"'"), token.rstrip(MARKS))):
                if (at := self.finder.of(self.decode(form))) >= 0:
                    place[i] = at
                    break
        doc = owner(offsets)
        at = place[codes]
        hit = np.nonzero(at >= 0)[0]
        docs, found = [doc[hit]], [at[hit]]
        # runs of three or more single characters within a text
        single = (pc.utf8_length(pc.utf8_trim(words, characters=".,;:\"'-_~")).to_numpy(zero_copy_only=False) == 1)[codes]
        cut = np.nonzero(np.diff(np.concatenate([[0], (single * (doc + 1)).astype(np.int64), [0]])))[0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if single[a] and b - a >= 3:
                run = self.decode("".join(pc.utf8_trim(flat.slice(a, b - a), characters=".,;:\"'-_~").to_pylist()))
                for word in self.inside.findall(run) or ([run] if run in self.place else []):
                    docs.append(np.array([doc[a]]))
                    found.append(np.array([self.place[word]]))
        docs, found = np.concatenate(docs), np.concatenate(found)
        pairs = np.unique(docs * len(self.words) + found)
        bounds = np.searchsorted(pairs, np.arange(n + 1) * len(self.words))
        return pairs % len(self.words), bounds, np.bincount(docs, minlength=n)


def _strong(table: DataFrame, n: int, k: int, bar: float) -> DataFrame:
    """Rows (word, n, k) that stand out among ``n`` rows of which ``k`` are toxic."""
    share = k / n
    x, y = F.col("k").cast("double"), (F.col("n") - F.col("k")).cast("double")
    g = 2 * (F.when(x > 0, x * F.log(x / (F.col("n") * share))).otherwise(0.0) + F.when(y > 0, y * F.log(y / (F.col("n") * (1 - share)))).otherwise(0.0))
    ratio = ((x + 0.5) / (k + 1)) / ((y + 0.5) / (n - k + 1))
    return table.withColumn("g", g).filter((ratio >= RATIO) & (F.col("g") >= bar))


def learn_lexicon(docs: DataFrame, labels: DataFrame, most: int = LEXICON, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], float]:
    """Words, and stems (written ``stem*``), whose rate in toxic texts is
    ``RATIO`` times that in others, beyond what chance gives among so many; the
    strongest first.  And the share of toxic ones among texts that hold one.

    Support is counted twice: by text, and then for what stood out by texts that
    are the first (by id) to hold the word between its two neighbours, so that a
    passage or text copied many times counts once.
    """
    marked = labels.filter("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").filter("text is not null").select("doc_id", "toxic", "text")
    told = materialize(rows.select("toxic", "text").mapInArrow(_distinct_words, "toxic int, word string").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")), "labelled-words")
    whole = told.filter("word is null").first()  # one row a text
    if whole is None or not whole["k"] or whole["k"] == whole["n"]:
        return [], 0.5
    n, k = int(whole["n"]), int(whole["k"])
    words = told.filter("word is not null")
    bar = 2 * math.log(max(words.count(), 1)) + 4
    first = [r["word"] for r in _strong(words, n, k, bar).orderBy(F.desc("g"), "word").limit(most).collect()]
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for whole in batches:
            for batch in text_slices(whole):
                flat, offsets = split_words(pc.utf8_lower(clean_text(batch)))
                encoded = pc.utf8_trim(flat, characters=MARKS).dictionary_encode()
                codes = encoded.indices.to_numpy().astype(np.int64)
                hashes = np.array([hash_text(w) for w in encoded.dictionary.to_pylist()], np.uint64)[codes] if len(codes) else np.empty(0, np.uint64)
                around = np.append(hashes[1:], np.uint64(0)) * np.uint64(3) + np.append(np.uint64(0), hashes[:-1]) if len(codes) else hashes
                for found in finder.all_of(encoded.dictionary):
                    at = found[codes] if len(codes) else codes
                    hit = np.nonzero(at >= 0)[0]
                    names = pa.array(shared.value, pa.string()).take(pa.array(at[hit]))
                    own = pa.array(owner(offsets)[hit])
                    yield pa.RecordBatch.from_arrays(
                        [names, pa.array(around[hit].view(np.int64)), batch.column("doc_id").take(own), batch.column("toxic").take(own)], names=["word", "around", "doc_id", "toxic"]
                    )

    met = rows.mapInArrow(contexts, "word string, around bigint, doc_id bigint, toxic int")
    met = met.groupBy("word", "around").agg(F.min("doc_id").alias("first"), F.max("toxic").alias("toxic")).groupBy("word", "first").agg(F.max("toxic").alias("toxic"))
    kept = _strong(met.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")), n, k, bar).orderBy(F.desc("g"), "word").collect()
    kept = [r for r in kept if r["word"][-1] != "*" or r["n"] - r["k"] <= IMPURE * r["n"]]
    stems = {r["word"][:-1] for r in kept if r["word"][-1] == "*"}
    # a stem stands for longer stems; whole words stay beside it
    kept = [r for r in kept if r["word"][-1] != "*" or not any(r["word"][:i] in stems for i in STEMS if i < len(r["word"]) - 1)]
    return [r["word"] for r in kept], sum(r["k"] for r in kept) / max(sum(r["n"] for r in kept), 1)


def hash_text(word: str) -> int:
    return zlib.crc32(word.encode()) | (zlib.adler32(word.encode()) << 31)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct words and stems, and a null for the text itself."""
    for whole in batches:
        for batch in text_slices(whole):
            flat, offsets = split_words(pc.utf8_lower(clean_text(batch)))
            encoded = pc.utf8_trim(flat, characters=MARKS).dictionary_encode()
            codes = encoded.indices.to_numpy().astype(np.int64)
            words, toxic = encoded.dictionary, batch.column("toxic")
            length = pc.utf8_length(words).to_numpy(zero_copy_only=False) if len(words) else np.empty(0, np.int64)
            for size in (None, *STEMS):
                names = words if size is None else pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, size), pa.scalar("*", words.type), pa.scalar("", words.type)) if len(words) else words
                kinds = names.dictionary_encode()
                own = kinds.indices.to_numpy().astype(np.int64)
                used = (length >= 3 if size is None else length > size)[codes] if len(codes) else np.zeros(0, bool)
                pairs = np.unique((owner(offsets)[used] << 32) | own[codes][used]) if len(codes) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([toxic.take(pa.array(pairs >> 32)), kinds.dictionary.cast(pa.string()).take(pa.array(pairs & 0xFFFFFFFF))], names=["toxic", "word"])
            yield pa.RecordBatch.from_arrays([toxic, pa.nulls(len(toxic), pa.string())], names=["toxic", "word"])


class Finder:
    """Places of words in a lexicon of words and stems."""

    def __init__(self, lexicon: list[str]):
        self.words = pa.array(lexicon, pa.large_string())
        self.place = {w: i for i, w in enumerate(lexicon)}

    def all_of(self, words: pa.Array) -> Iterator[np.ndarray]:
        """For whole words, then for stems of each length: places or -1."""
        length = pc.utf8_length(words).to_numpy(zero_copy_only=False) if len(words) else np.empty(0, np.int64)
        for size in (None, *STEMS):
            names = words if size is None or not len(words) else pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, size), pa.scalar("*", words.type), pa.scalar("", words.type))
            found = pc.fill_null(pc.index_in(names, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            yield found if size is None else np.where(length > size, found, -1)

    def one_of(self, words: pa.Array) -> np.ndarray:
        """The word itself, or else its longest stem."""
        whole, *stems = self.all_of(words)
        for found in reversed(stems):
            whole = np.where(whole >= 0, whole, found)
        return whole

    def of(self, word: str) -> int:
        names = [word, *(word[:i] + "*" for i in reversed(STEMS) if len(word) > i)]
        return next((self.place[w] for w in names if w in self.place), -1)


def evidence(docs: DataFrame, lexicon: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, found (places of distinct lexicon words, restored), n_hits."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(*shared.value)
        for whole in batches:
            for batch in text_slices(whole):
                found, bounds, hits = restorer.evidence(clean_text(batch))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(hits)], names=["doc_id", "found", "n_hits"])

    return materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, found array<int>, n_hits bigint"), "evidence")


@dataclass
class Odds:
    """Log odds ratios of lexicon words, the logistic function of their sum, and
    the share of toxic rows among those without evidence."""

    words: list[float]
    shift: float
    slope: float
    bare: float


def log_ratio(k, n, toxic, clean):
    """Of a word that k of ``toxic`` and n - k of ``clean`` texts hold; for
    numbers and columns alike."""
    log = F.log if isinstance(k, Column) else math.log
    return log((k + 0.5) / (toxic + 1.0)) - log((n - k + 0.5) / (clean + 1.0))


def fit_logistic(x: np.ndarray, n: np.ndarray, k: np.ndarray) -> tuple[float, float]:
    """Shift and slope for k of n rows at each x: Newton's method with halved
    steps; weak priors (shift 0, slope 1) keep both finite."""

    def gain(at: np.ndarray) -> float:
        z = at[0] + at[1] * x
        return float((k * z - n * np.logaddexp(0, z)).sum() - 0.005 * at[0] ** 2 - 0.5 * (at[1] - 1) ** 2)

    at = np.array([0.0, 1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] + at[1] * x, -500, 500)))
        w = n * p * (1 - p)
        g = np.array([(k - n * p).sum() - 0.01 * at[0], ((k - n * p) * x).sum() - (at[1] - 1)])
        h = np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1]])
        step = np.linalg.solve(h, g)
        while gain(at + step) < gain(at) and np.abs(step).max() > 1e-12:
            step = step / 2
        at = at + step
        if np.abs(step).max() < 1e-10:
            break
    return float(at[0]), float(at[1])


def learn_odds(found: DataFrame, marked: DataFrame, size: int) -> Odds:
    """From the evidence of labelled rows (doc_id, toxic)."""
    rows = found.join(marked, "doc_id").select("toxic", "found")
    some = F.when(F.size("found") == 0, F.array(F.lit(-1))).otherwise(F.array_append("found", -2))
    counts = rows.select("toxic", F.explode(some).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    got = {r["word"]: (r["n"], r["k"]) for r in counts.collect()}  # a row for each word of the lexicon, and two
    (n0, k0), (n1, k1) = got.get(-1, (0, 0)), got.get(-2, (0, 0))
    n, k = n0 + n1, k0 + k1
    if not n:
        return Odds([0.0] * size, 0.0, 0.0, 0.5)
    words = [got.get(w, (0, 0)) for w in range(size)]
    # a word that no labelled text holds counts as much as the bar for the lexicon
    ratios = [log_ratio(b, a, k, n - k) if a else math.log(RATIO) for a, b in words]
    with_n, with_k = (F.array(*(F.lit(float(x)) for x in [*column, 0])) for column in ([a for a, _ in words], [b for _, b in words]))
    toxic = F.col("toxic").cast("double")
    without = F.aggregate("found", F.lit(0.0), lambda s, w: s + log_ratio(F.get(with_k, w) - toxic, F.get(with_n, w) - 1, k - toxic, n - k - 1 + toxic))
    bins = rows.filter(F.size("found") > 0).groupBy(F.round(without * 4).alias("bin")).agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).orderBy("bin").toArrow()
    x, of, hit = (bins[c].to_numpy().astype(float) for c in ("bin", "n", "k"))  # a row for each quarter of a unit
    shift, slope = fit_logistic(np.clip(x / 4, -30, 30), of, hit)
    return Odds(ratios, shift, slope, (k0 + k / n) / (n0 + 1))


def scored(odds: Odds) -> Column:
    words = F.array(*map(F.lit, [*odds.words, 0.0]))
    total = F.aggregate("found", F.lit(0.0), lambda s, w: s + F.get(words, w))
    total = F.lit(odds.shift) + F.lit(odds.slope) * F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))
    return F.when(F.size("found") == 0, F.lit(odds.bare)).otherwise(1 / (1 + F.exp(-total)))


def held_out() -> Column:
    return F.coalesce(bucket("doc_id", 4) == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words (distinct lexicon words) and
    n_hits of every row."""
    learned = labels.filter(~held_out())
    lexicon, _ = learn_lexicon(docs, learned)
    found = evidence(docs, lexicon, character_model(docs, lexicon))
    marked = learned.filter("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    out = found.withColumns({"score": scored(learn_odds(found, marked, len(lexicon))), "held_out": held_out()})
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("found").cast("long").alias("n_words"), "n_hits")
