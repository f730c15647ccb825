"""Counts of characters, words, lines and repeated windows for whole texts.

Used by the quality rules and as features of the quality classifier.  One pass
over Arrow batches; every count is over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewater.llm.shared import clean_text, mix, owner, per_text, split_words, text_slices, windows

COUNT_BYTES = 1 << 20
_CLASSES = ("space", "inside", "upper", "lower", "digit", "symbol", "exclaim", "comma", "other", "high")


def _table() -> np.ndarray:
    kind = np.full(256, _CLASSES.index("other"), np.int32)
    for chars, name in (
        (b" \t\n\x0b\x0c\r", "space"),
        (bytes(range(0x80, 0xC0)), "inside"),
        (bytes(range(0xC0, 0x100)), "high"),
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"),
        (b"abcdefghijklmnopqrstuvwxyz", "lower"),
        (b"0123456789", "digit"),
        (b"#*$%&|<>", "symbol"),
        (b"!", "exclaim"),
        (b".,;:", "comma"),
    ):
        kind[list(chars)] = _CLASSES.index(name)
    return kind


_KIND = _table()


def char_counts(text: pa.Array) -> dict[str, np.ndarray]:
    """Characters of each class in each text (UTF-8 continuation bytes apart),
    counted ``COUNT_BYTES`` of text at a time."""
    n, k = len(text), len(_CLASSES)
    offsets = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8)
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    counts = np.zeros((n, k), np.int64)
    for a in range(int(offsets[0]), int(offsets[-1]), COUNT_BYTES):
        b = min(a + COUNT_BYTES, int(offsets[-1]))
        lo, hi = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
        inside = np.diff(np.clip(offsets[lo : hi + 1], a, b))
        cell = np.repeat(np.arange(hi - lo, dtype=np.int32) * k, inside)
        cell += _KIND[raw[a:b]]
        counts[lo:hi] += np.bincount(cell, minlength=(hi - lo) * k).reshape(-1, k)
    return {name: counts[:, i] for i, name in enumerate(_CLASSES)}


def repeated_words(codes: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Per text, the words in ``width``-word windows found twice or more there."""
    keys, starts = windows(codes, offsets, width)
    cover = np.zeros(len(codes) + 1, np.int64)
    if len(keys):
        own = keys ^ mix(owner(offsets)[starts] + 1)
        order = np.argsort(own)
        ranked = own[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(cover, starts[twice], 1)
        np.add.at(cover, starts[twice] + width, -1)
    return per_text(np.cumsum(cover[:-1]) > 0, offsets)


def duplicate_lines(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those of them equal to an earlier line."""
    lists = pc.split_pattern(text, "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    doc = owner(offsets)[worded]
    code = pc.dictionary_encode(flat).indices.to_numpy()[worded].astype(np.int64)
    distinct = np.unique((doc << 32) | code) >> 32
    lines = per_text(worded, offsets)
    return lines, lines - np.bincount(distinct, minlength=len(lines))


def text_stats(text: pa.Array) -> dict[str, np.ndarray]:
    """All counts, one array entry per text."""
    chars = char_counts(text)
    flat, offsets = split_words(text)
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.uint64)
    doc = owner(offsets)
    pairs, times = np.unique((doc << 32) | codes.astype(np.int64), return_counts=True)
    n = len(text)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, pairs >> 32, times)
    lengths = pc.utf8_length(encoded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[encoded.indices.to_numpy()] if len(flat) else np.empty(0, np.int64)
    echo = np.zeros(len(codes), bool)
    echo[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    lines, dup = duplicate_lines(text)
    visible = sum(chars[c] for c in _CLASSES if c not in ("space", "inside"))
    return {
        "n_words": np.diff(offsets),
        "word_chars": visible,
        "n_symbols": chars["symbol"],
        "n_lines": lines,
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(codes, offsets, 5),
        "n_upper": chars["upper"],
        "n_lower": chars["lower"],
        "n_digits": chars["digit"],
        "n_exclaim": chars["exclaim"],
        "n_commas": chars["comma"],
        "n_other": chars["other"],
        "n_high": chars["high"],
        "n_distinct": np.bincount(pairs >> 32, minlength=n),
        "n_top": top,
        "n_echo": per_text(echo, offsets),
        "sum_sq_len": per_text(lengths * lengths, offsets),
    }


def stats_batches(columns: list[str], keep: list[str], prefix: str = ""):
    """A function for ``mapInArrow``: passes ``keep`` through and adds the
    named counts as longs, their names led by ``prefix``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                stats = text_stats(clean_text(batch))
                arrays = [batch.column(c) for c in keep] + [pa.array(stats[c].astype(np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(prefix + c for c in columns)])

    return run
