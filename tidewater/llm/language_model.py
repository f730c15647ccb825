"""A hashed maximum-entropy language model with a class-factored softmax.

``P(w | h) = P(class(w) | h) * P(bucket(w) | class(w), h) * P(w | bucket(w))``.

*   Classes: one for all words outside the head of the vocabulary (rare and
    unseen words), one for the end of a text, one for each of the most frequent
    words, and one for each frequent word ending.
*   ``P(class | h)`` is a softmax over weights of hashed features of the words
    before: the last word, the last two, the one before the last (a skip), and
    the endings of the last three.  The weights are trained by gradient steps:
    in every round each task goes over its part of all training texts in small
    batches, then the tasks' weights are averaged, block by block, by a shuffle.
    Texts are split and looked up once, to a number for each word, and rounds
    and scores read those numbers.
*   Within a class, words by frequency make up to ``BUCKETS`` buckets of about
    equal mass; ``P(bucket | class, h)`` is a softmax over weights of the class
    hashed with the last word and with its ending, trained in the same passes.
*   ``P(w | bucket)`` is the bucket's share of the word's count.  In the class of
    rare words each count is discounted by ``DISCOUNT``, and what that frees is
    the probability of an unseen word, so all outcomes (V known tokens and one
    unknown) sum to one.

The tables of weights grow with the square root of the training tokens, as
vocabularies do (``Sizes``), and so does the number of words that are features by
name; training runs in no more tasks than keep what they send below the input.
Counts are over all training texts.  Words found often (``HEAD_WORDS`` at most,
a fixed bound) are sent to all tasks; others are joined by word.  Within
a batch weights are added up and exponentials taken once for each distinct row or
pair of names, then multiplied; sums that could overflow are shifted first.

Defined cases: a null or empty text is its end alone; repeated rows are learned
from and scored as often as they occur; rows with a null id are learned from
and not held out; without training texts every token has log10 probability 0
in the base (N = V = 0 gives 0.1 / 0.1) and the model; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.gam import bucket
from tidewater.llm.shared import clean_text, materialize, mix, owner, per_text, split_words, string_keys, text_slices

HEAD_WORDS = 1 << 19
SINGLES, ENDINGS = 24, 38
RARE, END = 0, 1
CLASSES = 2 + SINGLES + ENDINGS
DISCOUNT = 0.75
#: Rows of the weight table: last word, last two words, skipped word, and the
#: endings of the last three words.
WORD_ROWS, PAIR_ROWS, ENDING_ROWS = 2048, 4096, 512
ROWS = 2 * WORD_ROWS + PAIR_ROWS + 3 * ENDING_ROWS
BUCKETS, INNER_ROWS = 16, 4096
NAMED_WORDS = 4096
#: Training tokens up to which the tables have the sizes above.
TOKENS = 200_000_000
ROUNDS, BATCH, STEP = 2, 8192, 0.3
BLOCKS = 128
#: Distinct words of several slices that a task holds while counting.
HELD = 1 << 18
#: Words whose keys are made at a time.
KEYED = 1 << 13
#: Rows of a batch that are worked on at a time, and rows from which on a run is
#: summed alone.
CACHED, LONG = 1024, 24
#: Exponents up to so far from zero need no shift.
SAFE = 60.0


@dataclass(frozen=True)
class Sizes:
    """Rows of the tables and words known by name, ``scale`` times the least."""

    scale: int = 1

    @classmethod
    def of(cls, tokens: int) -> Sizes:
        return cls(1 << max(0, round(math.log2(math.sqrt(max(tokens, 1) / TOKENS)))))

    @property
    def words(self) -> int:
        return WORD_ROWS * self.scale

    @property
    def pairs(self) -> int:
        return PAIR_ROWS * self.scale

    @property
    def rows(self) -> int:
        return 2 * self.words + self.pairs + 3 * ENDING_ROWS

    @property
    def inner(self) -> int:
        return INNER_ROWS * self.scale

    @property
    def named(self) -> int:
        return NAMED_WORDS * self.scale


@dataclass
class Weights:
    """Weights of classes and of buckets, each row with the squares of its
    gradients so far."""

    outer: np.ndarray
    outer_speed: np.ndarray
    inner: np.ndarray
    inner_speed: np.ndarray

    @classmethod
    def new(cls, sizes: Sizes) -> Weights:
        return cls(np.zeros((sizes.rows, CLASSES), np.float32), np.ones(sizes.rows, np.float32), np.zeros((sizes.inner, BUCKETS), np.float32), np.ones(sizes.inner, np.float32))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.outer, self.outer_speed, self.inner, self.inner_speed

    def copy(self) -> Weights:
        return Weights(*(x.copy() for x in self.parts()))

    def block(self, b: int) -> np.ndarray:
        """Part ``b`` of ``BLOCKS`` of all weights, one after another."""
        return np.concatenate([np.array_split(x, BLOCKS)[b].ravel() for x in self.parts()]).astype(np.float32)

    def put(self, b: int, values: np.ndarray) -> None:
        at = 0
        for x in self.parts():
            own = np.array_split(x, BLOCKS)[b]  # a view
            own[...] = values[at : at + own.size].reshape(own.shape)
            at += own.size


@dataclass
class Vocabulary:
    """What every task needs to know; bounded by ``HEAD_WORDS``."""

    head: pa.Array
    counts: np.ndarray
    classes: np.ndarray
    singles: dict[str, int]
    endings: dict[str, int]
    buckets: np.ndarray
    share: np.ndarray  # log10 P(w | bucket) of head words
    end_rows: np.ndarray
    ends: int
    tokens: int
    types: int
    bias: np.ndarray
    inner_bias: np.ndarray
    sizes: Sizes
    keys: np.ndarray  # of head words, ascending; none if two words have one
    key_places: np.ndarray

    def places(self, words: pa.Array) -> np.ndarray:
        """Places of words in the head (-1: not there), found by keys and compared:
        ``pc.index_in`` would hash the whole head for every slice of texts."""
        if not len(self.keys):
            return pc.fill_null(pc.index_in(words, value_set=self.head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        key = word_keys(words)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.nonzero(self.keys[at] == key)[0]
        place = self.key_places[at[hit]]
        same = pc.equal(words.take(pa.array(hit)), self.head.take(pa.array(place))).to_numpy(zero_copy_only=False)
        out = np.full(len(words), -1, np.int64)
        out[hit[same]] = place[same]
        return out


def word_keys(words: pa.Array) -> np.ndarray:
    """``string_keys`` of so many words at a time that little memory is needed."""
    return np.concatenate([np.empty(0, np.uint64), *(string_keys(words.slice(a, KEYED)) for a in range(0, len(words), KEYED))])


def ending(word: str) -> str:
    """The last two letters before marks."""
    return word.rstrip(".,;:!?\"')")[-2:]


def word_class(word: str, singles: dict[str, int], endings: dict[str, int]) -> int:
    if (found := singles.get(word)) is not None:
        return found
    return endings.get(ending(word), 2 + SINGLES + ENDINGS - 1)


def is_training() -> Column:
    return F.coalesce(bucket("doc_id", 10) != 0, F.lit(True))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(is_training())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, c; what several slices hold is summed until there are ``HELD`` rows."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

    for whole in batches:
        for batch in text_slices(whole):
            flat, _ = split_words(pc.ascii_lower(clean_text(batch)))
            encoded = flat.dictionary_encode()
            times = np.bincount(encoded.indices.to_numpy(), minlength=len(encoded.dictionary)).astype(np.int64)
            words = pa.concat_arrays([encoded.dictionary.cast(pa.string()), pa.array([None], pa.string())])
            held.append(pa.table({"word": words, "c": np.append(times, batch.num_rows)}))
            if sum(map(len, held)) > HELD:
                held = [summed()]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches(max_chunksize=1 << 16)
    if held:
        yield from summed().to_batches(max_chunksize=1 << 16)


def count_words(train: DataFrame) -> DataFrame:
    """word, c over all training texts; the end's row has a null word."""
    return materialize(train.select("text").mapInArrow(_word_counts, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "words")


def vocabulary(words: DataFrame, head_words: int = HEAD_WORDS) -> Vocabulary:
    known = words.filter("word is not null")
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("e")).first()
    floor, held = 2, 0
    for row in sorted(known.groupBy(F.least(F.col("c"), F.lit(1_000_000)).alias("t")).count().collect(), reverse=True):
        held += row["count"]
        if held > head_words:
            floor = max(floor, row["t"] + 1)
            break
    head = known.filter((F.col("c") >= floor) & (F.length("word") <= 64)).toArrow()
    order = np.lexsort([pc.rank(head["word"]).to_numpy(), -head["c"].to_numpy()]) if head.num_rows else np.empty(0, np.int64)
    head = head.take(pa.array(order)).combine_chunks()
    names, counts = head["word"].to_pylist(), head["c"].to_numpy()
    singles = {w: 2 + i for i, w in enumerate(names[:SINGLES])}
    by_ending: dict[str, int] = {}
    for w, c in zip(names[SINGLES:], counts[SINGLES:], strict=True):
        e = ending(w)
        by_ending[e] = by_ending.get(e, 0) + int(c)
    chosen = sorted(by_ending, key=lambda e: (-by_ending[e], e))[: ENDINGS - 1]
    endings = {e: 2 + SINGLES + i for i, e in enumerate(chosen)}
    classes = np.fromiter((word_class(w, singles, endings) for w in names), np.int64, len(names))
    mass = np.bincount(classes, counts, CLASSES).astype(float)
    order = np.argsort(classes, kind="stable")  # within a class, the most frequent first
    before = np.cumsum(counts[order]) - counts[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(classes, counts, CLASSES))])[:-1] if len(names) else np.zeros(CLASSES)
    buckets = np.zeros(len(names), np.int64)
    buckets[order] = np.minimum((before - first[classes[order]]) * BUCKETS // mass[classes[order]], BUCKETS - 1)
    held_mass = np.bincount(classes * BUCKETS + buckets, counts, CLASSES * BUCKETS).reshape(CLASSES, BUCKETS)
    share = np.log10(counts / held_mass[classes, buckets]) if len(names) else np.empty(0)
    inner_bias = np.where(held_mass > 0, np.log(np.maximum(held_mass, 0.5) / np.maximum(mass, 0.5)[:, None]), -1e9).astype(np.float32)
    n, v, e = int(total["n"] or 0), int(total["v"] or 0), int(total["e"] or 0)
    mass[END] = e
    mass[RARE] = n - mass.sum()
    mass[[RARE, END]] = np.maximum(mass[[RARE, END]], 0.5)
    bias = np.where(mass > 0, np.log(np.maximum(mass, 0.5) / max(mass.sum(), 0.5)), -1e9).astype(np.float32)  # a class without words takes nothing
    spelled = head["word"].combine_chunks().cast(pa.large_string())
    keys = word_keys(spelled)
    by_key = np.argsort(keys, kind="stable")
    keys = keys[by_key]
    if (keys[1:] == keys[:-1]).any():
        keys = keys[:0]
    return Vocabulary(spelled, counts, classes, singles, endings, buckets, share, ending_rows(head["word"].combine_chunks()), e, n, v, bias, inner_bias, Sizes.of(n), keys, by_key)


def encode(text: pa.Array, vocab: Vocabulary):
    """Places of words in the head (-1: not there), the distinct words and
    codes, and where each text's words start."""
    flat, offsets = split_words(pc.ascii_lower(text))
    encoded = flat.dictionary_encode()
    words = encoded.dictionary.cast(pa.large_string())
    return words, encoded.indices.to_numpy().astype(np.int64), vocab.places(words), offsets


def ending_rows(words: pa.Array) -> np.ndarray:
    """The row of each word's ending, from 1."""
    if not len(words):
        return np.empty(0, np.int32)
    tail = pc.dictionary_encode(pc.utf8_slice_codeunits(pc.utf8_rtrim(words, characters=".,;:!?\"')"), -2, None))
    salt = np.array([_text_hash(e) for e in tail.dictionary.to_pylist()], np.int64)
    return (salt[tail.indices.to_numpy()] % (ENDING_ROWS - 1) + 1).astype(np.int32)


def known_words(words: pa.Array, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """All that the model sees of each word: its place in the head, or -1 less
    the row of its ending."""
    told = place.astype(np.int32)
    rare = np.nonzero(place < 0)[0]
    told[rare] = -1 - ending_rows(words.take(pa.array(rare)))
    return told[codes]


def tokens_of(words: pa.Array, codes: np.ndarray, place: np.ndarray, offsets: np.ndarray, vocab: Vocabulary):
    """Targets and feature rows of all tokens (words, then the end, per text)."""
    return token_features(known_words(words, codes, place), offsets, vocab)[:3]


def name_rows(vocab: Vocabulary) -> np.ndarray:
    """Features 0, 2, 3 and 4 (as rows) of all names of words: those of endings,
    then those of the words that are known by name."""
    sizes = vocab.sizes
    tails = np.concatenate([np.arange(ENDING_ROWS), vocab.end_rows[: sizes.named]])
    names, endings = np.arange(len(tails)), 2 * sizes.words + sizes.pairs
    first = mix(names + 1) % np.uint64(sizes.words)
    skipped = sizes.words + sizes.pairs + (mix(names + 1_000_000_007) % np.uint64(sizes.words)).astype(np.int64)
    return np.stack([first.astype(np.int64), skipped, endings + tails, endings + ENDING_ROWS + tails]).astype(np.int32)


def token_features(known: np.ndarray, offsets: np.ndarray, vocab: Vocabulary):
    """Targets, feature rows, where texts end, and the names of the last two words
    of each token: one gives features 0 and 3, the other 2 and 4."""
    sizes = vocab.sizes
    # by what is known of a word, from the last ending on
    name_of = np.concatenate([np.arange(ENDING_ROWS)[::-1], np.arange(len(vocab.classes)) + ENDING_ROWS]).astype(np.int32)
    name_of[ENDING_ROWS + sizes.named :] = vocab.end_rows[sizes.named :]
    class_of = np.concatenate([np.full(ENDING_ROWS, RARE), vocab.classes]).astype(np.int32)
    told = known + ENDING_ROWS
    n = len(offsets) - 1
    size = len(known) + n
    at = np.arange(len(known)) + owner(offsets)  # where words go, leaving room for ends
    last = offsets[1:] + np.arange(n)
    out = np.full(size, END, np.int32)
    out[at] = class_of.take(told)
    names = np.zeros(size, np.int32)
    names[at] = name_of.take(told)

    def back(k: int) -> np.ndarray:
        """Names k tokens earlier; 0 beyond a text's first word (an end has 0)."""
        moved = np.zeros_like(names)
        moved[k:] = names[:-k]
        first = np.concatenate([[0], last[:-1] + 1])
        for j in range(k):
            here = first + j
            moved[here[here <= last]] = 0
        return moved

    one, two = back(1), back(2)
    first, skipped, tail, before = name_rows(vocab)
    features = np.empty((6, size), np.int32)
    for k, table, rows in ((0, first, one), (2, skipped, two), (3, tail, one), (4, before, two), (5, before + ENDING_ROWS, back(3))):
        table.take(rows, 0, features[k], "clip")
    for a in range(0, size, 1 << 15):  # parts that stay in a core's cache
        some = slice(a, a + (1 << 15))
        features[1, some] = sizes.words + (mix(one[some].astype(np.int64) * 1_000_003 + two[some] + 7) & np.uint64(sizes.pairs - 1)).astype(np.int32)  # a power of two
    return out, features, last, (one, two)


def _text_hash(text: str) -> int:
    value = 0
    for c in text:
        value = (value * 1_000_003 + ord(c)) & 0x7FFFFFFF
    return value


def inner_tokens(known: np.ndarray, offsets: np.ndarray, target: np.ndarray, features: np.ndarray, vocab: Vocabulary):
    """Tokens that are words of the head: their places, buckets, and rows of the
    inner table (the class with the last word, and with its ending)."""
    word = known >= 0
    at = (np.arange(len(known)) + owner(offsets))[word]
    bucket = vocab.buckets[known[word]]
    own = target[at]
    rows = [(mix(features[k, at].astype(np.int64) * CLASSES + own + 11) & np.uint64(vocab.sizes.inner - 1)).astype(np.int32) for k in (0, 3)]  # a power of two
    return at, bucket, np.stack(rows)


def softmax(features: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return softmax_of([(weights, f) for f in features], bias)


def softmax_of(terms: list[tuple[np.ndarray, np.ndarray]], bias: np.ndarray | None, powers: bool = False) -> np.ndarray:
    """Probabilities of each token from the sum of a row of each table (and of a
    bias for all or each token), a part at a time that stays in a core's cache;
    ``powers`` says that tables hold exponentials, of which products are taken."""
    n, width = len(terms[0][1]), terms[0][0].shape[1]
    out = np.empty((n, width), terms[0][0].dtype)
    more = np.empty((min(n, CACHED), width), out.dtype)
    ones = np.ones(width, out.dtype)
    join = np.multiply if powers else np.add
    for a in range(0, n, CACHED):
        z = out[a : a + CACHED]
        other = more[: len(z)]
        for k, (table, rows) in enumerate(terms):
            np.take(table, rows[a : a + CACHED], 0, other if k else z, "clip")  # "raise" would copy; rows are remainders by the table's size
            if k:
                join(z, other, out=z)
        if not powers:
            if bias is not None:
                z += bias if bias.ndim == 1 else bias[a : a + CACHED]
            if z.max() > SAFE or z[:, 0].min() < -SAFE:  # else no sum overflows or vanishes
                z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
        z *= (1 / (z @ ones))[:, None]
    return out


def target_logs(terms: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, powers: bool) -> np.ndarray:
    """log10 of what ``softmax_of`` gives each token's target."""
    if not powers:
        own = softmax_of(terms, None)[np.arange(len(target)), target]
    else:
        own = np.empty(len(target), terms[0][0].dtype)
        for a in range(0, len(target), CACHED):
            some = slice(a, a + CACHED)
            left, right = (table.take(rows[some], 0, None, "clip") for table, rows in terms[:2])
            for k, (table, rows) in enumerate(terms[2:]):
                side = left if k % 2 else right
                side *= table.take(rows[some], 0, None, "clip")
            at = np.arange(len(left)), target[some]
            own[some] = left[at] * right[at] / np.einsum("ij,ij->i", left, right)
    return np.log10(np.maximum(own, 1e-30))


def are_safe(tables: list[np.ndarray]) -> bool:
    """No product of exponentials of a row of each table overflows, and none
    vanishes in the first column, as that of all never does in sums."""
    return sum(max(t.max(), 0) for t in tables) <= SAFE and sum(min(t[:, 0].min(), 0) for t in tables) >= -SAFE


def run_sums(rows: np.ndarray, order: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of runs of ``rows`` taken in ``order``, and the run of each sum, the
    longest first: runs of ``LONG`` rows one by one, others place by place for
    all runs at once."""
    by = np.argsort((LONG - np.minimum(size, LONG)).astype(np.uint8), kind="stable")
    first, size = (np.cumsum(size) - size)[by], size[by]
    sums = np.empty((len(size), rows.shape[1]), rows.dtype)
    long = int(np.count_nonzero(size >= LONG))
    more = np.empty((max(CACHED, int(size.max(initial=0))), rows.shape[1]), rows.dtype)
    ones = np.ones(len(more), rows.dtype)
    for k, (a, n) in enumerate(zip(first[:long].tolist(), size[:long].tolist(), strict=True)):
        np.dot(ones[:n], rows.take(order[a : a + n], 0, more[:n], "clip"), sums[k])
    first, rest = first[long:], sums[long:]
    rows.take(order[first], 0, rest, "clip")
    longer = len(first) - np.cumsum(np.bincount(size[long:], minlength=LONG))
    for k in range(1, LONG):
        if not longer[k]:
            break
        at = order[first[: longer[k]] + k]
        for a in range(0, len(at), CACHED):
            some = at[a : a + CACHED]
            rest[a : a + len(some)] += rows.take(some, 0, more[: len(some)], "clip")
    return sums, by


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts rows, and where each run of equal ones starts and its size."""
    low = rows.min() if len(rows) else 0
    order = np.argsort((rows - low).astype(np.uint16) if len(rows) and rows.max() - low < 1 << 16 else rows, kind="stable")  # 16 bits are sorted by radix
    ranked = rows[order]
    first = np.nonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))[0]
    return order, first, np.diff(np.append(first, len(rows)))


def descend(target: np.ndarray, features: np.ndarray, weights: np.ndarray, speed: np.ndarray, bias: np.ndarray, shared: tuple[tuple[np.ndarray, tuple[int, ...]], ...] = (), kind: np.ndarray | None = None) -> None:
    """One pass of gradient steps over the tokens, in place; each row's step is
    scaled by the squares of its gradients so far.  ``bias`` is one row, or the
    row of each token's ``kind``.  ``shared`` names keys and the features that
    follow from them; then no two features may have a row in common.  Weights are
    added up, their exponentials taken and their gradients summed once for each
    key, or each row of a feature without one."""
    alone = [k for k in range(len(features)) if not any(k in ks for _, ks in shared)]
    for a in range(0, len(target), BATCH):
        part = features[:, a : a + BATCH]
        terms = [] if kind is None else [(bias, kind[a : a + BATCH])]
        orders, sizes, rows, runs, held = [], [], [], [], 0
        for key, own in [*((part[k], (k,)) for k in alone), *((key[a : a + BATCH], own) for key, own in shared)]:
            order, first, size = _runs(key)
            place = np.empty(len(order), np.int64)
            place[order] = np.repeat(np.arange(len(size)), size)
            at = order[first]
            mine = [part[k][at] for k in own]
            table = weights.take(mine[0], 0)
            for f in mine[1:]:
                table += weights.take(f, 0)
            if not terms:
                table += bias
            terms.append((table, place))
            orders.append(order)
            sizes.append(size)
            rows += mine
            runs += [np.arange(held, held + len(size))] * len(mine)
            held += len(size)
        powers = are_safe([table for table, _ in terms])
        slope = softmax_of([(np.exp(table), place) for table, place in terms] if powers else terms, None, powers)
        slope.reshape(-1)[np.arange(len(slope)) * slope.shape[1] + target[a : a + BATCH]] -= 1
        sums, by = run_sums(slope, np.concatenate(orders), np.concatenate(sizes))  # of all keys at once
        place = np.empty(held, np.int64)
        place[by] = np.arange(held)
        if shared:  # several keys may have one row
            f = np.concatenate(rows)
            order, first, size = _runs(f)
            sums, by = run_sums(sums, place[np.concatenate(runs)[order]], size)
            steps = [(f[order[first[by]]], sums)]
        else:
            steps = [(f, sums.take(place[r], 0)) for f, r in zip(rows, runs, strict=True)]
        for f, g in steps:
            speed[f] += np.einsum("ij,ij->i", g, g) / weights.shape[1]
            g *= (STEP / np.sqrt(speed[f]))[:, None]
            new = weights.take(f, 0)
            new -= g
            weights[f] = new


def _words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as ``known_words`` gave them, and where each text's start."""
    column = batch.column("words")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].tobytes() if data is not None else b""
    return np.frombuffer(raw, np.int32), (offsets - offsets[0]) // 4


def train_round(train: DataFrame, vocab, weights: Weights) -> Weights:
    """Each task's pass over its texts (``words`` of ``encode_texts``), then the
    mean of the tasks' weights by their numbers of tokens.  ``vocab`` is a
    broadcast variable."""
    spark = train.sparkSession
    start = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, v = start.value.copy(), vocab.value
        seen = 0
        for whole in batches:
            for batch in text_slices(whole, "words"):
                known, offsets = _words_of(batch)
                target, features, _, (one, two) = token_features(known, offsets, v)
                descend(target, features, w.outer, w.outer_speed, v.bias, ((one, (0, 3)), (two, (2, 4))))
                at, bucket, rows = inner_tokens(known, offsets, target, features, v)
                for a in range(0, len(at), 32 * BATCH):
                    some = slice(a, a + 32 * BATCH)
                    descend(bucket[some], rows[:, some], w.inner, w.inner_speed, v.inner_bias, kind=target[at[some]])
                seen += len(target)
        if seen:
            packed = [w.block(b).tobytes() for b in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([seen] * BLOCKS, pa.int64()), pa.array(packed, pa.binary())], names=["block", "tokens", "w"])

    def mean(part: pa.Table) -> pa.Table:
        total, sums = 0, None
        for tokens, w in zip(part["tokens"].to_pylist(), part["w"], strict=True):
            values = np.frombuffer(w.as_buffer(), np.float32).astype(np.float64) * tokens
            sums = values if sums is None else sums + values
            total += tokens
        return pa.table({"block": part["block"].slice(0, 1), "w": pa.array([(sums / total).astype(np.float32).tobytes()], pa.binary())})

    texts = train.select("words")
    most = 4 * vocab.value.tokens // sum(x.nbytes for x in weights.parts()) + 1
    if weights.outer.shape[0] > Sizes().rows and texts.rdd.getNumPartitions() > most:
        texts = texts.coalesce(most)
    sent = texts.mapInArrow(run, "block int, tokens bigint, w binary")
    got = sent.groupBy("block").applyInArrow(mean, "block int, w binary").collect()  # one model
    new = weights.copy()
    for row in got:
        new.put(row["block"], np.frombuffer(row["w"], np.float32))
    return new


def encode_texts(docs: DataFrame, vocab: Vocabulary, shared) -> DataFrame:
    """row, doc_id, train, n_tokens, known, base, rare (words outside the head and
    how often) and words (as ``known_words`` gives them) of every row."""
    base_total = vocab.tokens + 0.1 * (vocab.types + 1)
    base_end = float(np.log10((vocab.ends + 0.1) / base_total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        base = np.log10((np.append(v.counts, 0) + 0.1) / base_total)
        for whole in batches:
            for batch in text_slices(whole):
                found, codes, place, offsets = encode(clean_text(batch), v)
                at = place[codes]
                plain = np.append(0, np.cumsum(np.where(at >= 0, base[at], 0)))[offsets]
                known = per_text(at >= 0, offsets)
                rare = np.nonzero(at < 0)[0]
                pairs, times = np.unique((owner(offsets)[rare] << 32) | codes[rare], return_counts=True)
                bounds = np.searchsorted(pairs >> 32, np.arange(batch.num_rows + 1)).astype(np.int32)
                struct = pa.StructArray.from_arrays([found.take(pa.array(pairs & 0xFFFFFFFF)).cast(pa.string()), pa.array(times.astype(np.int64))], names=["word", "freq"])
                told = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(known_words(found, codes, place))])
                arrays = [
                    *(batch.column(c) for c in ("row", "doc_id", "train")),
                    pa.array(np.diff(offsets) + 1),
                    pa.array(known + int(v.ends > 0)),
                    pa.array(np.diff(plain) + base_end),
                    pa.ListArray.from_arrays(pa.array(bounds), struct),
                    told,
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "train", "n_tokens", "known", "base", "rare", "words"])

    schema = "row bigint, doc_id bigint, train boolean, n_tokens bigint, known bigint, base double, rare array<struct<word:string,freq:bigint>>, words binary"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", is_training().alias("train"), "text")
    return materialize(rows.mapInArrow(run, schema), "encoded")


def score(docs: DataFrame, words: DataFrame, vocab: Vocabulary, shared, weights: np.ndarray, inner: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row."""
    return score_encoded(encode_texts(docs, vocab, shared), words, vocab, shared, weights, Weights.new(vocab.sizes).inner if inner is None else inner)


def score_encoded(told: DataFrame, words: DataFrame, vocab: Vocabulary, shared, weights: np.ndarray, inner: np.ndarray) -> DataFrame:
    """``score`` of the rows of ``encode_texts``."""
    spark = told.sparkSession
    table = spark.sparkContext.broadcast((weights, inner))
    base_total = vocab.tokens + 0.1 * (vocab.types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (outer, within) = shared.value, table.value
        share = np.append(v.share, 0.0)
        rows_of = name_rows(v)
        by_one, by_two = (outer.take(rows_of[k], 0) + outer.take(rows_of[k + 2], 0) for k in (0, 1))
        by_one += v.bias
        pairs, ends = outer[v.sizes.words :][: v.sizes.pairs], outer[-ENDING_ROWS:]
        tables, inner_tables = [by_one, by_two, pairs, ends], [v.inner_bias, within, within]
        powers, inner_powers = are_safe(tables), are_safe(inner_tables)
        if powers:
            tables = [np.exp(t) for t in tables]
        if inner_powers:
            bias_powers, powers_within = np.exp(v.inner_bias), np.exp(within)
            inner_tables = [bias_powers, powers_within, powers_within]
        for whole in batches:
            for batch in text_slices(whole, "words"):
                known, offsets = _words_of(batch)
                target, features, last, (one, two) = token_features(known, offsets, v)
                log_p = np.empty(len(target))
                for a in range(0, len(target), BATCH):
                    some = slice(a, a + BATCH)
                    places = one[some], two[some], features[1, some] - v.sizes.words, features[5, some] - (len(outer) - ENDING_ROWS)
                    log_p[some] = target_logs(list(zip(tables, places, strict=True)), target[some], powers)
                words_at, bucket, rows = inner_tokens(known, offsets, target, features, v)
                for a in range(0, len(words_at), BATCH):
                    some = slice(a, a + BATCH)
                    own = words_at[some]
                    log_p[own] += target_logs(list(zip(inner_tables, (target[own], *rows[:, some]), strict=True)), bucket[some], inner_powers)
                sums = np.append(0, np.cumsum(log_p))[np.append(0, last + 1)]
                inside = np.append(0, np.cumsum(share[np.maximum(known, -1)]))[offsets]
                model = pa.array(np.diff(sums) + np.diff(inside))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_tokens", "known", "base")), model], names=["row", "doc_id", "n_tokens", "known", "base", "model"])

    found = told.select("row", "doc_id", "n_tokens", "known", "base", "words").mapInArrow(run, "row bigint, doc_id bigint, n_tokens bigint, known bigint, base double, model double")
    # the class of rare words: discounted counts, and the rest for the unseen
    rare_words = words.filter("word is not null").join(_head_frame(spark, vocab), "word", "left_anti") if len(vocab.counts) else words.filter("word is not null")
    tail = materialize(rare_words, "tail")
    held = tail.agg(F.sum("c").alias("c"), F.count("*").alias("v")).first()
    mass, types = held["c"] or 0, held["v"]
    unseen = float(np.log10(DISCOUNT * types / mass)) if mass else 0.0
    c = F.coalesce("c", F.lit(0))
    inside = F.when(c > 0, F.log10((c - F.lit(DISCOUNT)) / F.lit(float(mass or 1)))).otherwise(F.lit(unseen))
    terms = told.select("row", F.inline("rare")).join(tail, "word", "left").select(
        "row",
        F.when(c > 0, F.col("freq")).otherwise(0).alias("known"),
        (F.col("freq") * F.log10((c + 0.1) / F.lit(base_total))).alias("base"),
        (F.col("freq") * inside).alias("model"),
    )
    rest = terms.groupBy("row").agg(F.sum("known").alias("k"), F.sum("base").alias("b"), F.sum("model").alias("m"))
    both = found.join(rest, "row", "left")
    zero = F.lit(0)
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("k", zero)).alias("n_known"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("m", zero)).alias("score"),
    )


def _head_frame(spark, vocab: Vocabulary) -> DataFrame:
    """The head as rows: few enough to be a local table."""
    return spark.createDataFrame(pa.table({"word": vocab.head.cast(pa.string())}))


def score_documents(docs: DataFrame, head_words: int = HEAD_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    train = training_rows(docs)
    words = count_words(train)
    vocab = vocabulary(words, head_words)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    weights = Weights.new(vocab.sizes)
    told = encode_texts(docs, vocab, shared)
    spark, tasks = docs.sparkSession, "spark.sql.files.minPartitionNum"
    before = spark.conf.get(tasks, None)
    spark.conf.set(tasks, str(max(docs.rdd.getNumPartitions(), 1)))  # as many tasks as read the texts, whose files these are
    try:
        for _ in range(rounds if vocab.tokens else 0):
            weights = train_round(told.filter("train"), shared, weights)
    finally:
        spark.conf.unset(tasks) if before is None else spark.conf.set(tasks, before)
    scored = score_encoded(told, words, vocab, shared, weights.outer, weights.inner)
    if not vocab.tokens:
        scored = scored.withColumn("score", F.lit(0.0))
    held = F.coalesce(bucket("doc_id", 10) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")
