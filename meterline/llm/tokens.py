"""Whole-text encoding with the `tokenizers` library, a segment at a time.

Both vocabularies split a text before merging, and never across the start of a run of white space
that follows other characters.  A text's ids are therefore the ids of its segments (white space and
the characters after it), joined.  Segments are cut and coded with Arrow and numpy, so that Python
sees each distinct one of a batch once, and one that occurs again need not be encoded again.  A
segment that is a plain word, perhaps with marks after it, goes straight to the vocabulary's merge
model, without the normaliser and splitter that leave it as it is.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Marks that may close a plain word: ASCII punctuation, but for ' (contractions) and < (special tokens).
_PLAIN = re.compile(r"""([ \n\t\r]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)""")

#: Text bytes that are encoded at a time: many, as each distinct segment is looked up once in them.
ENCODE_BYTES = 4 << 20

_encoders: dict[tuple[str, int], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _after_wide_space(data: np.ndarray) -> np.ndarray:
    """Whether the bytes before each place may end a white-space character outside ASCII."""
    out = np.zeros(len(data), bool)
    wide = np.flatnonzero(data[:-1] >= 128) + 1
    if len(wide):
        one, two = data[wide - 2], data[wide - 3]  # of places this near the start the wrong bytes: checked below
        last = data[wide - 1]
        short = (one == 0xC2) & ((last == 0x85) | (last == 0xA0))
        long = (two == 0xE1) & (one == 0x9A) | (two == 0xE2) & ((one == 0x80) | (one == 0x81)) | (two == 0xE3) & (one == 0x80)
        out[wide] = short | long | (wide < 3)
    return out


def segments(text: pa.Array, bare: bool) -> tuple[pa.Array, np.ndarray]:
    """The segments of every text, flat, and where each text's begin and end.

    A segment is a run of white space with what follows it, or without white space if `bare`.  Where
    white space outside ASCII stands before ASCII white space, the run is not cut.
    """
    text = pc.fill_null(text, "").cast(pa.large_string())
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(bounds), np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    turn = np.zeros(len(data), bool)
    turn[1:] = space[1:] & ~space[:-1]
    turn &= ~_after_wide_space(data)
    if bare:
        turn[1:] |= space[:-1] & ~space[1:]
    turn[bounds[:-1][bounds[:-1] < len(data)]] = True
    at = np.flatnonzero(turn)
    cut = np.append(at, len(data))
    flat = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(cut), pa.py_buffer(data))
    if bare:
        full = ~space[at]
        upto = np.concatenate(([0], np.cumsum(full)))
        return flat.filter(pa.array(full)), upto[np.searchsorted(at, bounds)]
    return flat, np.searchsorted(at, bounds)


class Encoder:
    """Ids of texts as unsigned 32-bit numbers, each text closed by `end_id`.

    A null text is empty; special tokens' strings in a text become those tokens, as in the library.
    At most about twice `most_known` segments, and as many words, stay in memory.
    """

    def __init__(self, path: str, end_id: int, most_known: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.most = end_id, most_known
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.lower = self._whole("Ab") == self._whole("ab")
        self.spaced = self._whole(" ab") != self._whole("ab")
        probes = [" Wonderful", "Épreuve", " straße", "ñandú", "x", " tionheß"]
        self.direct = all(self._word(p if self.spaced else p.strip()) == self._whole(p) for p in probes)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of letters, with the one space before them where the vocabulary keeps it."""
        if self.lower:
            word = word.lower()
        ids = self.words.get(word)
        if ids is None:
            ids = self.older_words.get(word)
            if ids is None:
                shown = word if word.isascii() and word[0] != " " else word.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(self.words) >= self.most:
                self.words, self.older_words = {}, self.words
            self.words[word] = ids
        return ids

    def _segment(self, segment: str) -> bytes:
        plain = _PLAIN.fullmatch(segment) if self.direct else None
        if plain is None:
            return self._whole(segment)
        space, word, marks = plain.groups()
        if not self.spaced:
            ids = self._word(word)
        elif space in ("", " "):
            ids = self._word(space + word)
        else:
            ids = self._known(space) + self._word(word)
        return ids + self._known(marks) if marks else ids

    def _known(self, part: str) -> bytes:
        """Ids of white space or marks, which are few."""
        ids = self.parts.get(part)
        if ids is None:
            ids = self._whole(part)
            if len(self.parts) < 10_000:
                self.parts[part] = ids
        return ids

    def _looked_up(self, distinct: list[str]) -> list[bytes]:
        """Ids of distinct segments, from the known ones or new."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, distinct))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            s = distinct[i]
            ids = older.get(s)
            out[i] = known[s] = self._segment(s) if ids is None else ids
        return out

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and end."""
        flat, offsets = segments(text, not self.spaced)
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        held = self._looked_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        bounds = np.concatenate(([0], np.cumsum(np.append(size, 1))))
        pool = np.append(np.frombuffer(b"".join(held), "<u4"), np.uint32(self.end_id))
        lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(pool))
        # each text's end id is one more segment, the last of the pool
        found = lists.take(pa.array(np.insert(index, offsets[1:], len(size))))
        upto = found.offsets.to_numpy()
        return found.values.to_numpy()[upto[0] : upto[-1]], upto[offsets + np.arange(len(offsets))] - upto[0]


def encoder(path: str, end_id: int) -> Encoder:
    """The worker's encoder, which keeps what it knows from task to task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()
