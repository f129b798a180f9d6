"""Byte-level BPE of whole Arrow columns with the tokenizers library.

The library's splitter cuts a text into pieces that are merged independently, so
a piece has the same ids wherever it stands. Here the cuts are found for a whole
column at once with numpy, equal pieces are made one by Arrow's dictionary
encoding, and only pieces that were not met lately go to the library's model.
The class of a character outside ASCII (letter, number, space, other) is asked
of the library's own splitter once, so both always agree.

Strings of the file's added tokens become their ids wherever they stand, as the
library does by default; what stands between two of them is a text of its own.

Defined cases: null counts as empty and has no ids; a piece of any length is one
call; a file whose added tokens strip spaces, keep to single words or are
normalised is refused.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 0, 1, 2, 3, 255


def byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary has for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """``batch`` in runs of rows with at most ``most`` bytes of ``column``; a
    longer text is a run of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


class PieceEncoder:
    """Ids of texts by a byte-level tokenizer file. ``recent`` bounds the pieces
    whose ids are remembered, in two generations."""

    def __init__(self, path: str, recent: int = 200_000):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = {t.content: (i, t) for i, t in tokenizer.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added.values()):
            raise ValueError("added tokens that strip, keep to single words or are normalised")
        self.added = {content: i for content, (i, _) in added.items()}
        self.added_text = "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))
        self.added_pattern = re.compile(f"({self.added_text})") if self.added else None
        self.split, self.model = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # a piece comes here once in a while only
        self.n_ids = tokenizer.get_vocab_size()
        self.letters = byte_letters()
        self.recent = recent
        self.known = pa.array([], pa.large_binary())  # pieces; the ids of piece i are pool[at[i]:at[i + 1]]
        self.pool, self.at, self.met = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)
        ascii_class = [LETTER if chr(b).isalpha() else NUMBER if chr(b).isdigit() else SPACE if chr(b) in " \t\n\v\f\r" else OTHER for b in range(128)]
        self.of_byte = np.array(ascii_class + [UNKNOWN] * 128, np.uint8)
        self.of_char = np.full(0x110000, UNKNOWN, np.uint8)

    def _class(self, char: str) -> int:
        for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.split(before + char)) == 1:
                return kind
        return SPACE

    def classes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each byte's character, and where characters begin."""
        found = self.of_byte[data]
        lead = np.flatnonzero(data >= 0xC0)
        if lead.size:
            first = data[lead].astype(np.int64)
            width = 2 + (first >= 0xE0) + (first >= 0xF0)
            code = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[width]
            for k in (1, 2, 3):
                more = width > k
                code[more] = (code[more] << 6) | (data[lead[more] + k] & 0x3F)
            for c in np.unique(code[self.of_char[code] == UNKNOWN]):
                self.of_char[c] = self._class(chr(c))
            kind = self.of_char[code]
            for k in range(4):
                more = width > k
                found[lead[more] + k] = kind[more]
        return found, (data & 0xC0) != 0x80

    def cuts(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where pieces begin. ``texts``: the offsets of the texts in ``data``,
        the end included."""
        n = data.size
        kind, begins = self.classes(data)
        first = np.zeros(n + 1, bool)  # of a text
        first[texts] = True
        cut = first.copy()
        cut[1:n] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        # the last character of a run of spaces, when the same text goes on
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
        plain = data[last] == 0x20
        cut[last[plain] + 1] = False  # a plain space belongs to what follows
        start = last.copy()
        while (inner := ~begins[start]).any():
            start[inner] -= 1
        cut[start] = True
        # 's 't 'm 'd 're 've 'll, where a piece begins with the apostrophe
        quote = np.flatnonzero((data == 0x27) & cut[:n])
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
        if quote.size:
            one = data[quote + 1]
            two = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], data[np.minimum(quote + 2, n - 1)], 0)
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
            cut[quote[short | long] + 1] = False
            cut[quote[short] + 2] = True
            cut[quote[long] + 3] = True
        return np.flatnonzero(cut[:n])

    def forget(self, stay: np.ndarray) -> None:
        """All known pieces but ``stay`` (a mask)."""
        stay = np.flatnonzero(stay)
        width = np.diff(self.at)[stay]
        self.pool = self.pool[np.repeat(self.at[stay] - (np.cumsum(width) - width), width) + np.arange(width.sum())]
        self.at = np.append(0, np.cumsum(width))
        self.known = self.known.take(pa.array(stay))
        self.met = np.zeros(stay.size, bool)

    def learn(self, pieces: pa.Array) -> None:
        """Ids of pieces that are not known, from the library's model."""
        at = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        letters = bytes(pieces.buffers()[2])[at[0] : at[-1]].decode("latin-1").translate(self.letters)
        at = (at - at[0]).tolist()
        found = [[t.id for t in self.model.tokenize(letters[i:j])] for i, j in pairwise(at)]
        width = np.fromiter(map(len, found), np.int64, len(found))
        self.pool = np.append(self.pool, np.fromiter((i for ids in found for i in ids), np.uint32, width.sum()))
        self.at = np.append(self.at, self.at[-1] + np.cumsum(width))
        self.known = pa.concat_arrays([self.known, pieces])
        self.met = np.append(self.met, np.ones(len(pieces), bool))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's ids
        begin (one more entry: the end)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.added or not any(pc.any(pc.match_substring(texts, x)).as_py() for x in self.added):
            return self._encode(texts)
        parts, after, counts = [], [], []
        for text in texts.to_pylist():
            found = self.added_pattern.split(text)
            parts += found[::2]
            after += [self.added[x] for x in found[1::2]] + [-1]
            counts.append(len(found[::2]))
        ids, at = self._encode(pa.array(parts, pa.large_string()))
        marks = np.array(after)
        ids = np.insert(ids, at[1:][marks >= 0], marks[marks >= 0])
        at = at + np.append(0, np.cumsum(marks >= 0))
        return ids, at[np.append(0, np.cumsum(counts))]

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        cuts = self.cuts(data, offsets)
        bounds = np.append(cuts, data.size)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), cuts.size, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        which = pc.index_in(pieces, value_set=self.known)
        lacking = which.is_null()
        which = np.array(which.fill_null(-1))
        if (which < 0).any():
            new, here = pieces.filter(lacking).dictionary_encode(), np.zeros(len(self.known), bool)
            here[which[which >= 0]] = True
            if here.size + len(new.dictionary) > self.recent:
                stay = here | self.met
                stay = stay if stay.sum() + len(new.dictionary) <= self.recent * 3 // 4 else here
                self.forget(stay)
                which[which >= 0] = (np.cumsum(stay) - 1)[which[which >= 0]]
            first = len(self.known)
            self.learn(new.dictionary)
            which[which < 0] = first + np.asarray(new.indices)
        self.met[which] = True
        each = (self.at[1:] - self.at[:-1])[which]
        ends = np.cumsum(each)
        ids = self.pool[np.repeat(self.at[which] - (ends - each), each) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(cuts, offsets)]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One to a Python worker, which keeps it from task to task."""
    return PieceEncoder(path)
