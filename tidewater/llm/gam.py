"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins by quantiles of the training rows.  Shallow trees
over one feature's bins are boosted in turn (cyclically), each adding to that
feature's lookup table; then trees over pairs of features with the largest
interaction gain add to pair tables.  A score is the sum of looked-up bins.

Training uses at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the id
(the documented bound of the fit); scoring covers every row.

Defined cases: a null or empty text gets features of zero and a score; null
labels are not learned from; without rows of both labels the score is the share
of label 1 (0.5 without rows); repeated rows count as often as they occur, and
are scored one by one; rows with a null id are scored, not learned from and not
held out; an empty table gives no rows; further columns pass through, but a
column of the name of a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.shared import clean_text, text_slices
from tidewater.llm.textstats import text_stats

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, SHRINK = 120, 40, 0.15, 4, 4.0
THRESHOLD = 0.3

FEATURES = (
    "words", "mean_length", "length_spread", "repeats", "duplicate_lines", "symbols", "upper", "digits",
    "exclaim", "commas", "other", "high", "distinct", "top_word", "echo", "words_a_line",
)


def features(text: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    s = {k: v.astype(np.float64) for k, v in text_stats(text).items()}
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    letters = np.maximum(s["n_upper"] + s["n_lower"], 1)
    mean = s["word_chars"] / words
    columns = [
        np.log1p(s["n_words"]), mean, np.sqrt(np.maximum(s["sum_sq_len"] / words - mean**2, 0)),
        s["n_repeat_words"] / words, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_symbols"] / chars,
        s["n_upper"] / letters, s["n_digits"] / chars, s["n_exclaim"] / words, s["n_commas"] / words,
        s["n_other"] / chars, s["n_high"] / chars, s["n_distinct"] / words, s["n_top"] / words, s["n_echo"] / words,
        s["n_words"] / np.maximum(s["n_lines"], 1),
    ]
    return np.stack(columns, 1).astype(np.float32)


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        cells = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for j in {j for p in self.pairs for j in p}}
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[cells[i], cells[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step for each bin from a best-first tree of ``LEAVES`` leaves."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, None, 0)
        for a, b in leaves:
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    step = np.zeros(len(g))
    for a, b in leaves:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of the best tree that cuts one feature, then each half by
    the other."""
    best_gain, best = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        top_g, top_h = np.cumsum(a, 0), np.cumsum(b, 0)
        for k in range(len(a) - 1):
            total, step = 0.0, np.zeros_like(a)
            for half, rows_g, rows_h in ((slice(0, k + 1), top_g[k], top_h[k]), (slice(k + 1, None), top_g[-1] - top_g[k], top_h[-1] - top_h[k])):
                cg, ch = np.cumsum(rows_g), np.cumsum(rows_h)
                gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
                c = int(gain.argmax())
                total += gain[c]
                step[half, : c + 1] = cg[c] / (ch[c] + SHRINK)
                step[half, c + 1 :] = (cg[-1] - cg[c]) / (ch[-1] - ch[c] + SHRINK)
            if total > best_gain:
                best_gain, best = total, step.T if turned else step
    return best_gain, best


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of the logistic loss."""
    y = y.astype(np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    width = len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        return Gam(base, [np.empty(0, np.float32)] * width, [np.zeros(1)] * width)
    model = Gam(base, [_cuts(x[:, j], BINS) for j in range(width)], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.pair_edges = [_cuts(x[:, j], PAIR_BINS) for j in range(width)]
    cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    margin = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = slopes()
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(cells[j], g, n), np.bincount(cells[j], h, n))
            model.tables[j] += step
            margin += step[cells[j]]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    g, h = slopes()

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        return np.bincount(coarse[i] * shape[1] + coarse[j], values, shape[0] * shape[1]).reshape(shape)

    usable = [j for j in range(width) if len(model.pair_edges[j]) > 0]
    gains = [(_pair_tree(grid(i, j, g), grid(i, j, h))[0], i, j) for i in usable for j in usable if i < j]
    for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[1]
            model.pair_tables[k] += step
            margin += step[coarse[i], coarse[j]]
    return model


def bucket(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole):
            x = features(clean_text(batch))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), rows], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int = SAMPLE_ROWS) -> Gam:
    """Fit to ``labels`` (doc_id, label): at most ``sample_rows`` of them, those
    with the smallest hash of their id."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    got = rows.mapInArrow(_train_batches, "label int, x array<float>").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if got.num_rows else np.empty((0, len(FEATURES)), np.float32)
    y = got["label"].to_numpy()
    order = np.lexsort([y, *x.T])  # the same rows give the same model, in whatever order they come
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Gam, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, which replaces one of its name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                found = shared.value.score(features(clean_text(batch)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, column])

    kept = docs.drop(column)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())]))


def held_out() -> Column:
    return F.coalesce(bucket("doc_id", 5) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, **bound: int) -> DataFrame:
    """``docs`` with held_out, score and predicted, learned from ``labels``."""
    model = train(docs, labels.filter(~held_out()), "quality", **bound)
    return score(docs, model).withColumns({"held_out": held_out(), "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted to be good, with their columns."""
    model = train(docs, labels.filter(~held_out()), "quality")
    return score(docs, model, "_gam_score").filter(F.col("_gam_score") >= THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))
