"""Token ids of texts by a public tokenizer, with a bounded cache of words in each Python worker."""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CACHE_WORDS = 3 << 17  # entries of one generation in one worker; of two generations the older one is dropped
CHARS_AT_ONCE = 1 << 22
_IRREGULAR = re.compile(r"\s\s|\A\s|\s\Z")
_LETTERS = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
_KIND = np.zeros(256, np.uint8)  # of a UTF-8 byte: 1 for white space, 2 for one that may begin wider white space
_KIND[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]], _KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = 1, 2


def _byte_letters() -> dict[int, int]:
    """The characters by which byte-level vocabularies write bytes, for str.translate of bytes read as Latin-1."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


class Encoder:
    """Ids as little-endian uint32 bytes, equal to those of `tokenizers` for the whole text.

    The byte-level tokenizer begins a new piece at every single space between two other characters, and makes a single
    line end a piece, so a text is cut there and each word (with its space) is looked up or encoded on its own; a full
    stop or comma after a letter is a piece as well. The words of all texts are found at once, as places in their bytes, and each
    different one is looked up once. Texts with white space beside white space or at an end are encoded whole. Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Put words into `known`; those of the generation before are moved, the others encoded."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        lost = [w for w in words if w not in known]
        new = [w for w in lost if w not in before]
        known.update((w, before[w]) for w in lost if w in before)
        closed = [w for w in new if w[-1:] in (".", ",") and w[-2:-1].isalpha()]
        plain = set(new).difference(closed)
        plain.update(w[:-1] for w in closed)
        plain.update(".,")
        plain = [w for w in plain if w not in known]
        single, letters, tokenize = _LETTERS.fullmatch, self.letters, self.own.model.tokenize
        rest = []
        for w in plain:
            if single(w):  # one piece: the model alone is enough
                shown = "\u0120" + w[1:] if w[0] == " " else w
                shown = shown if w.isascii() else w.encode().decode("latin-1").translate(letters)
                known[w] = array("I", [t.id for t in tokenize(shown)]).tobytes()
            else:
                rest.append(w)
        for at in range(0, len(rest), 4096):
            known.update(zip(rest[at : at + 4096], self._encode(rest[at : at + 4096]), strict=True))
        known.update((w, known[w[:-1]] + known[w[-1]]) for w in closed)

    def _whole(self, texts: list[str], letters: np.ndarray, ends: np.ndarray) -> set[int]:
        """Numbers of the texts that are not cut; ends: where in the bytes of all texts each begins, and the end."""
        kind = _KIND[letters]
        white = kind == 1
        at = [np.flatnonzero(white[1:] & white[:-1]), np.flatnonzero(kind == 2)]
        first, last = ends[:-1][np.diff(ends) > 0], ends[1:][np.diff(ends) > 0] - 1
        at += [first[white[first]], last[white[last]]]
        doubtful = np.unique(np.searchsorted(ends, np.concatenate(at), "right") - 1).tolist()
        return {i for i in doubtful if _IRREGULAR.search(texts[i])}

    def __call__(self, texts: list[str]) -> list[bytes]:
        coded = [t.encode() for t in texts]
        data, ends = b"".join(coded), np.cumsum([0, *map(len, coded)])
        whole = self._whole(texts, np.frombuffer(data, np.uint8), ends)
        encoded = dict(zip(whole, self._encode([texts[i] for i in whole]), strict=True))
        if whole:
            coded = [b"" if i in whole else t for i, t in enumerate(coded)]
            data, ends = b"".join(coded), np.cumsum([0, *map(len, coded)])
        letters = np.frombuffer(data, np.uint8)
        cut = np.zeros(len(data) + 1, bool)
        cut[ends] = True
        cut[:-1] |= (letters == 32) | (letters == 10)
        cut[1:] |= letters == 10
        cuts = np.flatnonzero(cut)
        words = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        which, (_, bounds, letters) = words.indices.to_numpy(), words.dictionary.buffers()
        bounds, letters = np.frombuffer(bounds, np.int64)[: len(words.dictionary) + 1].tolist(), letters.to_pybytes()
        different = [letters[a:b].decode() for a, b in itertools.pairwise(bounds)]
        self._learn(different)
        ids = list(map(self.known.__getitem__, different))
        starts = np.cumsum([0, *map(len, ids)])
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(starts), pa.py_buffer(b"".join(ids))])
        joined = pieces.take(pa.array(which)).buffers()[2]
        joined = memoryview(joined) if joined else b""
        places = np.concatenate(([0], np.cumsum(np.diff(starts)[which])))[np.searchsorted(cuts, ends)].tolist()
        return [encoded[i] if i in whole else bytes(joined[places[i] : places[i + 1]]) for i in range(len(texts))]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; it outlives a task where Spark reuses workers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterable[pa.RecordBatch], text: int, path: str) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, ids) for every row in order; a null text is empty. About four million characters are encoded at once."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    encode = encoder(path)
    for batch in batches:
        texts, first, size = [], 0, 0
        for row in range(batch.num_rows):
            texts.append(batch.column(text)[row].as_py() or "")
            size += len(texts[-1])
            if size >= CHARS_AT_ONCE or row + 1 == batch.num_rows:
                for i, ids in enumerate(encode(texts)):
                    yield batch, first + i, np.frombuffer(ids, "<u4")
                texts, first, size = [], row + 1, 0
