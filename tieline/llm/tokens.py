"""Token ids of whole texts by a given tokenizer file, each distinct word encoded once per worker."""

from __future__ import annotations

import os
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TAIL = string.punctuation.replace("'", "")  # an apostrophe can begin a word of letters
LATIN = "^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+$"  # letters below U+0250 but the dotted capital I, whose lower case is two characters


def byte_letters() -> dict[int, str]:
    """Byte-level tokenizers name bytes by printable characters: themselves where they are, else the ones from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """For byte-level BPE that lower-cases, drops white space and never joins letters with anything else. Ids are little-endian
    unsigned 16 bits.

    A run of letters, lower-cased, and the punctuation after it are words of their own to such a tokenizer, so a run of Latin letters can
    go straight to its BPE model, and its ids are kept for later texts. Everything else goes through the whole tokenizer. What is kept is
    dropped when it has more than `entries` words. Texts are cut by Arrow, and each distinct piece of `chunks` stretches between white
    space is looked up once."""

    def __init__(self, path: str, entries: int = 1_500_000, chunks: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.raw = [i.to_bytes(2, "little") for i in range(1 << 16)]
        self.entries, self.chunk_entries = entries, chunks
        self.words: dict[str, bytes] = {}  # runs of Latin letters, A-Z lower-cased
        self.others: dict[str, bytes] = {}
        probe = "Straßeñé"
        if self._word(probe.lower()) != self._whole(probe):
            raise ValueError("not a tokenizer of lower-cased byte-level words")

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self.encode(pa.array(texts, pa.string())).to_pylist()

    def encode(self, texts: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of each text; null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        flat, ends = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        values, sizes = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
        for i in range(0, len(flat), self.chunk_entries):
            ids, size = self._chunks(flat.slice(i, self.chunk_entries))
            values.append(ids)
            sizes.append(size)
        ends = np.cumsum(np.concatenate(sizes))[ends]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(values))])

    def _chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids of all chunks, and how many each has. A chunk is Latin letters and the punctuation after them, or one piece."""
        for kept in (self.words, self.others):
            if len(kept) > self.entries:
                kept.clear()
        core = pc.ascii_rtrim(chunks, TAIL)
        plain = pc.ascii_is_alpha(core).to_numpy(zero_copy_only=False).copy()
        rest = np.flatnonzero(~plain)
        plain[rest] = pc.match_substring_regex(core.take(pa.array(rest)), LATIN).to_numpy(zero_copy_only=False)
        chunks = pc.if_else(pa.array(plain), pc.ascii_lower(chunks), chunks)
        offsets = np.frombuffer(chunks.buffers()[1], "<i4")[chunks.offset : chunks.offset + len(chunks) + 1]
        cut = np.where(plain, offsets[:-1] + pc.binary_length(core).to_numpy(), offsets[1:])
        tailed = cut < offsets[1:]
        edges = np.insert(offsets, np.flatnonzero(tailed) + 1, cut[tailed])
        pieces = pa.Array.from_buffers(pa.string(), len(edges) - 1, [None, pa.py_buffer(edges), chunks.buffers()[2]]).dictionary_encode()
        known = self.words.get
        ids = pa.array([known(x) or self.unknown(x) for x in pieces.dictionary.to_numpy(zero_copy_only=False)], pa.large_binary()).take(pieces.indices)
        size = pc.binary_length(ids).to_numpy()
        begin = np.arange(len(chunks)) + np.cumsum(tailed) - tailed
        return np.frombuffer(ids.buffers()[2] or b"", np.uint8)[: size.sum()], np.add.reduceat(size, begin)

    def unknown(self, piece: str) -> bytes:
        """Ids of a piece that is not among the words kept."""
        if piece.isalpha() and (piece.isascii() or max(piece) < "ɐ" and "İ" not in piece):
            ids = self.words[piece] = self._word(piece.lower())
            return ids
        ids = self.others.get(piece)
        if ids is None:
            ids = self.others[piece] = self._whole(piece)
        return ids

    def _word(self, word: str) -> bytes:
        named = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.raw[t.id] for t in self.model.tokenize(named)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
