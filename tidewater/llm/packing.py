"""Vector bin packing of examples into sequences of bounded length.

Every example has a demand in three dimensions (tokens, segments,
loss-bearing tokens) and every sequence a capacity in each.  The open sequence
takes, among the examples that still fit, the one with the largest dot product
of normalised demand and normalised room.  With ``cut=True`` an example may be
cut where a sequence's room ends, so only the last sequence of a task has room
left, and that rest is laid out in powers of two, which need no padding.

In plain documents the ids of a line that equals an earlier line of its document
bear no loss; in conversations only the answers' do.

Tasks pack what they read, in bundles of ``BUNDLE_TOKENS``, and carry what is
left of a bundle into the next one: memory is bounded, nothing is shuffled and
a repeated task gives the same sequences.

Defined cases: a null text counts as empty (its end id only); examples without
tokens take no room and give no piece; null or negative numbers of tokens count
as 0; an example over a capacity is cut, or with ``cut=False`` gets no place
(null sequence and offset); ties go to the earlier row; repeated rows are packed
each; an empty table packs into no sequences; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.encode import ENCODE_BYTES, default_path, encoder
from tidewater.llm.shared import clean_text, text_slices
from tidewater.llm.textstats import duplicate_lines

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BUNDLE_TOKENS = 2_000_000
BLANKS = " \t\n\x0b\x0c\r"
#: Examples weighed against each other at a time.
CHOICE = 1024


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError(f"a sequence must have room for a token: {self}")


@dataclass
class Piece:
    item: int
    start: int
    length: int
    sequence: int
    offset: int


def pack(
    tokens: np.ndarray, loss: np.ndarray, limits: Limits, first: int = 0, *, sums: list[np.ndarray] | None = None, last: bool = True
) -> tuple[list[Piece], int, list[tuple[int, int]]]:
    """Pieces of items ``0..n-1`` and the next free sequence number.

    ``loss`` counts the loss-bearing tokens of an item.  With ``sums`` (for each
    item, the loss-bearing ones among its first k tokens, k from 0 on) items may
    be cut; without, they are placed whole, and those over a limit not at all.
    With ``last=False`` the rest that does not fill a sequence is returned as
    (item, start) and not laid out.
    """
    cut = sums is not None
    capacity = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    pieces: list[Piece] = []
    sequence = first
    start = np.zeros(len(tokens), np.int64)
    bearing = np.asarray(loss, float).copy()

    def place(i: int, length: int, offset: int, out: list[Piece]) -> float:
        """Cuts ``length`` tokens off the front of item i; the loss they bear."""
        out.append(Piece(i, int(start[i]), length, sequence, offset))
        start[i] += length
        bore = float(sums[i][start[i]] - sums[i][start[i] - length]) if cut else bearing[i]
        bearing[i] -= bore
        return bore

    if cut and limits.loss_tokens >= limits.tokens:
        for i in np.nonzero(tokens >= limits.tokens)[0]:
            for _ in range(int(tokens[i] // limits.tokens)):
                place(int(i), limits.tokens, 0, pieces)
                sequence += 1
    left = tokens - start
    queue = np.nonzero((left > 0) & (cut | ((left <= limits.tokens) & (bearing <= limits.loss_tokens))))[0]
    at = min(CHOICE, len(queue))
    window, behind = queue[:at], at
    while len(window):
        room, used, filled = capacity.copy(), 0, []
        need = np.stack([left[window], np.ones(len(window)), bearing[window]], 1).astype(float)
        alive = np.ones(len(window), bool)
        while room[0] >= 1 and room[1] >= 1 and alive.any():
            value = np.where(alive, need @ (room / capacity**2), -1)
            fits = alive & (need <= room).all(1)
            if cut and room[1] == 1:  # the last segment fills the sequence, if it can
                fits &= need[:, 0] == room[0]
            if fits.any():
                k = int(np.where(fits, value, -1).argmax())
                length = int(need[k, 0])
            elif cut:
                long = need[:, 0] >= room[0]
                k = int(np.where(long, value, -1).argmax() if room[1] == 1 and (alive & long).any() else value.argmax())
                i = int(window[k])
                length = int(min(room[0], left[i]))
                length = min(length, int(np.searchsorted(sums[i], sums[i][start[i]] + room[2], "right")) - 1 - int(start[i]))
                if length < 1:
                    break
            else:
                break
            i = int(window[k])
            room -= (length, 1, place(i, length, used, filled))
            used += length
            left[i] -= length
            need[k] = (left[i], 1, bearing[i])
            alive[k] = left[i] > 0
        if cut and used < limits.tokens and not alive.any() and behind >= len(queue):
            # The last sequence: hand its items back, or lay it out.
            if not last:
                return pieces, sequence, [(p.item, p.start) for p in filled]
            more, sequence = _powers(filled, used, sequence)
            pieces += more
            break
        pieces += filled
        sequence += 1
        window = window[alive]
        take = min(CHOICE - len(window), len(queue) - behind)
        window = np.concatenate([window, queue[behind : behind + take]])
        behind += take
    return pieces, sequence, []


def _powers(filled: list[Piece], used: int, sequence: int) -> tuple[list[Piece], int]:
    """Lay ``used`` tokens out in sequences whose lengths are powers of two."""
    out = []
    todo = [(p.item, p.start, p.length) for p in filled]
    while used:
        room = size = 1 << (used.bit_length() - 1)
        while room:
            item, start, length = todo.pop(0)
            took = min(length, room)
            out.append(Piece(item, start, took, sequence, size - room))
            room -= took
            if took < length:
                todo.insert(0, (item, start + took, length - took))
        used -= size
        sequence += 1
    return out, sequence


def loss_sums(text: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of all texts, their bounds, and which ids bear loss: all but those
    of lines that equal an earlier line of the same text."""
    ids, bounds = encoder(path).encode(text, end_id)
    bears = np.ones(len(ids), np.int8)
    lines, dup = duplicate_lines(text)
    for i in np.nonzero(dup)[0]:  # only texts with such lines are cut into lines
        own = text[int(i)].as_py().split("\n")
        seen: set[str] = set()
        copied = [not (s.strip(BLANKS) and (s not in seen and not seen.add(s))) for s in own]
        sizes = np.diff(encoder(path).encode(pa.array(own, pa.large_string()), None)[1])
        # blank characters within a line may join what the lines hold apart only in number, never in ids
        mask = np.repeat(~np.array(copied), sizes)
        if len(mask) == bounds[i + 1] - bounds[i] - 1:
            bears[bounds[i] : bounds[i + 1] - 1] = mask
    return ids, bounds, bears


def pack_batches(path: str, limits: Limits, end_id: int):
    """For ``mapInArrow`` over (doc_id, text): one row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        sequence = 0
        held: list[tuple[object, int, int, np.ndarray, np.ndarray]] = []  # id, start, all tokens, ids, loss sums
        weight = 0

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal held, weight, sequence
            sizes = np.array([len(h[3]) for h in held], np.int64)
            pieces, sequence, rest = pack(sizes, np.array([h[4][-1] for h in held], float), limits, sequence, sums=[h[4] for h in held], last=last)
            rows = []
            for p in pieces:
                name, start, total, ids, sums = held[p.item]
                crc = zlib.crc32(ids[p.start : p.start + p.length])
                rows.append((name, start + p.start, p.length, crc, total, base + p.sequence, p.offset, int(sums[p.start + p.length] - sums[p.start])))
            back: dict[int, int] = {}
            for item, start in rest:
                back[item] = min(back.get(item, start), start)
            held = [(held[i][0], held[i][1] + s, held[i][2], held[i][3][s:], held[i][4][s:] - held[i][4][s]) for i, s in back.items()]
            weight = sum(len(h[3]) for h in held)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(PIECES)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECES)

        for whole in batches:
            for batch in text_slices(whole, slice_bytes=ENCODE_BYTES):
                got, bounds, bears = loss_sums(clean_text(batch), path, end_id)
                got = got.astype("<u4")
                sums = np.concatenate([[0], np.cumsum(bears, dtype=np.int32)]).astype(np.int32)
                for name, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    held.append((name, 0, int(b - a), got[a:b], sums[a : b + 1] - sums[a]))
                weight += len(got)
                if weight >= BUNDLE_TOKENS:
                    yield emit(False)
        yield emit(True)

    return run


PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


def pack_documents(docs: DataFrame, limits: Limits | None = None, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row a piece: where it starts in its document, its length, its place
    in a sequence and its loss-bearing ids.  ``sequence_id`` is unique over all
    tasks."""
    run = pack_batches(vocabulary or default_path(VOCABULARY), limits or Limits(), end_id)
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in PIECES))


def pack_examples(examples: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Instruction data: rows of (example_id, tokens, loss_tokens) are placed
    whole, none cut, under all three limits at once.

    Returns (example_id, tokens, loss_tokens, sequence_id, offset).
    """
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sequence = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            tokens, loss = (np.maximum(pc.fill_null(batch.column(c), 0).to_numpy(), 0) for c in ("tokens", "loss_tokens"))
            pieces, sequence, _ = pack(tokens, loss, limits, sequence)
            where = {p.item: p for p in pieces}
            seq = [base + where[i].sequence if i in where else None for i in range(len(tokens))]
            off = [where[i].offset if i in where else None for i in range(len(tokens))]
            arrays = [batch.column(c) for c in ("example_id", "tokens", "loss_tokens")] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["example_id", "tokens", "loss_tokens", "sequence_id", "offset"])

    rows = examples.selectExpr("example_id", "cast(tokens as bigint) tokens", "cast(loss_tokens as bigint) loss_tokens")
    kind = dict(rows.dtypes)["example_id"]
    return rows.mapInArrow(run, f"example_id {kind}, tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint")


def conversation_examples(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(example_id, tokens, loss_tokens) of each conversation: its turns' ids,
    an end id after each; those of the assistant's turns bear loss."""
    path = vocabulary or default_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, slice_bytes=ENCODE_BYTES):
                counts = np.diff(encoder(path).encode(clean_text(batch), END_ID)[1])
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("role"), pa.array(counts)], names=["conv_id", "role", "n"])

    sizes = turns.select("conv_id", "role", "text").mapInArrow(run, "conv_id bigint, role string, n bigint")
    answers = F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0))
    return sizes.groupBy(F.col("conv_id").alias("example_id")).agg(F.sum("n").alias("tokens"), answers.alias("loss_tokens"))
