"""Token ids of whole texts by way of their distinct white-space chunks.

For a vocabulary whose pre-tokens never cross ASCII white space and which drops
white space and lower-cases, the ids of a text are the ids of its chunks one
after another.  Each distinct word (a chunk of Latin letters, in lower case and
without the marks behind it) is encoded once per worker and looked up by a key
from then on; texts for any other kind of vocabulary go to the library whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewater.llm.shared import clean_text, split_words, string_keys

#: A chunk of Latin letters with at most some marks behind it is two pre-tokens
#: whose normal form is plain lower case, so the model can be asked directly.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_VISIBLE = {b: chr(b) for b in _BYTES} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_BYTES}))}
#: The steps of a vocabulary that can be taken chunk by chunk.
CHUNK_NORMAL = ["NFC", "Replace", "Lowercase"]
CHUNK_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Most words that a worker remembers (some 40 bytes each); beyond that it starts anew.
CACHE_WORDS = 600_000
#: Text encoded at a time: ids and their places take some twenty times its bytes.
ENCODE_BYTES = 2 << 20


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a ``.json`` file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def default_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def goes_by_chunks(found) -> bool:
    """Whether the tokenizer normalizes and cuts as ``ChunkEncoder`` expects."""
    told = json.loads(found.to_str())
    normal = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
    cuts = [c.get("pattern", {}).get("Regex") for c in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
    return normal == CHUNK_NORMAL and cuts == [CHUNK_SPLIT, None] and told["model"]["type"] == "BPE"


def _gather(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``ids[start:start+length]`` one after another, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum(length)])
    at = np.repeat(start - bounds[:-1], length)
    at += np.arange(bounds[-1])
    return ids[at], bounds


class ChunkEncoder:
    """Encodes slices of texts; keeps the ids of words in one growing array."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.by_chunks = goes_by_chunks(self.tokenizer)
        self._reset()

    def _reset(self) -> None:
        self.keys, self.places = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted by key
        self.names = pa.array([], pa.large_string())
        self.ids, self.first = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, names: pa.Array) -> list[list[int]]:
        plain = pc.match_substring_regex(names, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        rest = names.filter(pa.array(~plain)).to_pylist()
        others = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        out = []
        for word, simple in zip(names.to_pylist(), plain, strict=True):
            if simple:
                shown = word if word.isascii() else word.encode().decode("latin-1").translate(_VISIBLE)
                out.append([t.id for t in self.model.tokenize(shown)])
            else:
                out.append(next(others).ids)
        return out

    def _add(self, names: pa.Array) -> np.ndarray:
        """New places of words, with their ids."""
        got = self._ids(names)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for ids in got for i in ids), np.uint32, int(sizes.sum()))
        known = len(self.first) - 1
        self.ids = np.concatenate([self.ids, flat])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.names = pa.concat_arrays([self.names, names])
        return np.arange(known, known + len(got))

    def _look(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.places[at], -1)

    def _find(self, names: pa.Array) -> np.ndarray:
        """Places of distinct words; those not seen before are encoded."""
        keys = string_keys(names)
        new = np.nonzero(self._look(keys) < 0)[0]
        if len(new):
            _, first = np.unique(keys[new], return_index=True)
            new = new[first]
            both = np.concatenate([self.keys, keys[new]])
            places = np.concatenate([self.places, self._add(names.take(pa.array(new)))])
            order = np.argsort(both, kind="stable")
            self.keys, self.places = both[order], places[order]
        at = self._look(keys)
        same = pc.equal(self.names.take(pa.array(at)), names).to_numpy(zero_copy_only=False)
        if not same.all():  # two words with one key
            at[~same] = self._add(names.filter(pa.array(~same)))
        return at

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after another, and their bounds."""
        if len(self.names) + 2 * len(chunks) > CACHE_WORDS:
            self._reset()
        bare = pc.utf8_rtrim(chunks, characters=MARKS)
        plain = pc.match_substring_regex(bare, f"^[{LETTERS}]+$")
        words = pc.if_else(plain, pc.utf8_lower(bare), chunks).dictionary_encode()
        marked = pc.and_(plain, pc.greater(pc.binary_length(chunks), pc.binary_length(bare))).to_numpy(zero_copy_only=False)
        tails = pc.replace_substring_regex(chunks.filter(pa.array(marked)), f"^[{LETTERS}]+", "").dictionary_encode()
        every = pa.concat_arrays([words.dictionary, tails.dictionary]).dictionary_encode()
        place, where = self._find(every.dictionary), every.indices.to_numpy()
        parts = np.zeros((len(chunks), 2), np.int64)
        parts[:, 0] = place[where[words.indices.to_numpy()]]
        parts[marked, 1] = place[where[len(words.dictionary) + tails.indices.to_numpy()]]
        used = np.ones(parts.shape, bool)
        used[:, 1] = marked
        start = self.first[parts]
        length = np.where(used, self.first[parts + 1] - start, 0)
        ids, bounds = _gather(self.ids, start.ravel(), length.ravel())
        return ids, bounds[::2]

    def _texts(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_chunks:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(text.to_pylist(), add_special_tokens=False)]
            bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))])
            return np.fromiter((i for ids in got for i in ids), np.uint32, int(bounds[-1])), bounds
        flat, offsets = split_words(text)
        if not len(flat):
            return np.empty(0, np.uint32), offsets
        encoded = flat.dictionary_encode()
        ids, bounds = self._chunks(clean_text(pa.RecordBatch.from_arrays([encoded.dictionary], names=["text"])))
        here = encoded.indices.to_numpy()
        out, first = _gather(ids, bounds[here], bounds[here + 1] - bounds[here])
        return out, first[offsets]

    def encode(self, text: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order (``end_id`` after each text, if given)
        and where each text's ids start."""
        found, bounds = self._texts(text)
        if end_id is None:
            return found, bounds
        ids = np.full(len(found) + len(text), end_id, np.uint32)
        body = np.ones(len(ids), bool)
        bounds = bounds + np.arange(len(bounds))
        body[bounds[1:] - 1] = False
        ids[body] = found
        return ids, bounds


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file."""
    return ChunkEncoder(path)
