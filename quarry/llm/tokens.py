"""Token ids of whole texts by a public tokenizer file.

Byte-level BPE never merges across pre-tokens, and a single space before a non-space character always starts one.
A text may thus be cut before such spaces and its chunks encoded apart, each distinct chunk of a batch once: the ids are
those of the whole text. A text with a run of white space that goes on after an inner space is encoded whole.
A chunk of letters, signs and single newlines is cut further, at its pre-tokens: those of letters, most of which stand in many chunks, are what is kept.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.common import worker_cache

#: White space, one space, then white space or the end (RE2): the text is not cut at spaces.
RUN = r"[\s\x0b\x1c-\x1f\x85\pZ] (?:[\s\x0b\x1c-\x1f\x85\pZ]|\z)"
LIMIT = 250_000
#: Up to here Unicode versions agree on what a letter is.
LETTERS_BELOW = "ɐ"
LETTER, SIGN = "A-Za-zªµºÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
#: Pre-tokens without white space or digits about them; an apostrophe may begin one of letters, so it is not among the signs.
PRE_TOKEN = re.compile(f" ?[{LETTER}]+| ?[{SIGN}]+|\n")
PLAIN = re.compile(f"[{LETTER}{SIGN}](?:[{LETTER}{SIGN}]|\n(?!\n))*")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """encode(texts) gives the ids of all texts and where each begins. The cache of chunks has two bounded generations."""

    def __init__(self, path: str, limit: int = LIMIT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.space = self.letters[32]
        self.limit, self.cache, self.older = limit, {}, {}
        #: Ids of pre-tokens without letters.
        self.signs: dict[str, bytes] = {}
        #: Bytes of each id.
        self.sizes = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(self.tokenizer.get_vocab_size())], np.int64)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, letters: str) -> bytes:
        """Ids of letters, after a space or not: one pre-token, so the model alone is asked."""
        mapped = letters.replace(" ", self.space) if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def sign(self, s: str) -> bytes:
        if len(self.signs) >= self.limit // 8:
            self.signs.clear()
        found = self.signs[s] = self.whole(s)
        return found

    def kept(self, c: str, make: Callable[[str], bytes]) -> bytes:
        """What make() gives for c, which is not in the cache, from now on kept there."""
        found = self.older.get(c) or make(c)
        if len(self.cache) >= self.limit:
            self.cache, self.older = {}, self.cache
        self.cache[c] = found
        return found

    def chunk(self, c: str) -> bytes:
        """Ids of a space and c."""
        spaced = " " + c
        found = self.cache.get(spaced)
        if found is not None:
            return found
        if c.isalpha() and max(c) < LETTERS_BELOW:
            return self.kept(spaced, self.word)
        if PLAIN.fullmatch(c):
            return b"".join([(self.cache.get(t) or self.kept(t, self.word)) if t[-1].isalpha() else self.signs.get(t) or self.sign(t) for t in PRE_TOKEN.findall(spaced)])
        return self.kept(spaced, self.whole)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of the texts, none null, one after another; offsets (one more than texts)."""
        return next(self.slices(texts, len(texts)), (np.zeros(0, np.uint32), np.zeros(1, np.int64)))

    def slices(self, texts: pa.Array, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """encode() of every rows texts in turn; each distinct chunk of all is looked up once."""
        if not len(texts):
            return
        odd = pc.match_substring_regex(texts, RUN)
        cut = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        first = cut.offsets.to_numpy()
        words = cut.flatten().dictionary_encode()
        first, which, names = first - first[0], words.indices.to_numpy().astype(np.int32), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.chunk, names))
        # Nothing stands before the first chunk of a text, so it has ids of its own; those of an odd text are all of its ids.
        begins = [self.whole(texts[k].as_py() if o else names[w]) for k, (o, w) in enumerate(zip(odd.to_pylist(), which[first[:-1]].tolist(), strict=True))]
        which[first[:-1]] = len(found) + np.arange(len(begins), dtype=np.int32)
        found += begins
        del cut, words, names
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        del found
        begin = np.cumsum(size) - size
        for k in range(0, len(texts), rows):
            own = first[k : k + rows + 1]
            w = which[own[0] : own[-1]]
            n = size[w]
            ends = np.cumsum(n)
            ids = flat[np.repeat(begin[w] - (ends - n), n) + np.arange(ends[-1])]
            yield ids, np.r_[(ends - n)[own[:-1] - own[0]], ends[-1]]


_encoders: dict[str, Encoder] = worker_cache("encoders")


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batch: pa.RecordBatch, path: str, rows: int = 512, together: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with text, and the ids and offsets of their texts."""
    for k in range(0, batch.num_rows, together):
        part = batch.slice(k, together)
        for i, (ids, offsets) in enumerate(encoder(path).slices(part.column("text"), rows)):
            yield part.slice(rows * i, rows), ids, offsets


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
