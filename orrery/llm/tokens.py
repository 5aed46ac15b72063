"""Token ids of whole texts, with a memo of chunks.

Both vocabularies split a text at white space before any merge, so the ids of a text are those of its
chunks put together. A chunk is what stands between single spaces or line feeds, with the one before it; a
text with any other white space goes to the tokenizer whole. The chunks of many texts are told apart by
Arrow, so each distinct one is looked up once a batch; numpy puts their ids together.

A chunk of letters that normalising leaves letters is one piece for the model and so skips the pipeline in
front of it; a run of ASCII signs behind such letters is a piece of its own. All other chunks go through
the whole tokenizer. Each worker keeps the ids of chunks until they hold `MEMO_BYTES`; forget() frees them,
which a step should call that may leave its workers idle beside other work.
Ids never depend on which texts a worker saw before.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import text_slices

#: Bytes of memo a vocabulary may hold in a worker, by ENTRY bytes a chunk and four an id.
MEMO_BYTES, ENTRY = 160 << 20, 200
#: Bytes of text that are put together at once; a longer text is a run of its own.
SLICE = 4 << 20
_CONTROL = np.array([x < 32 and x != 10 for x in range(256)])
#: White space beyond ASCII as UTF-8, by first byte.
_WIDE = {0xC2: re.compile(rb"\xC2[\x85\xA0]"), 0xE1: re.compile(rb"\xE1\x9A\x80"), 0xE2: re.compile(rb"\xE2(?:\x80[\x80-\x8A\xA8\xA9\xAF]|\x81\x9F)"), 0xE3: re.compile(rb"\xE3\x80\x80")}
_ADDED = re.compile(rb"<\|")
#: ASCII signs that, in a run behind letters, are one piece; an apostrophe may start one of its own.
_MARKS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_kept: dict[tuple[str, str], TokenIds] = {}


def odd_rows(raw: np.ndarray, data: bytes, bounds: np.ndarray) -> np.ndarray:
    """Rows whose white space is more than single spaces and line feeds between words, or that may name a special token."""
    blank = (raw == 32) | (raw == 10)
    bad = _CONTROL[raw]
    bad[1:] |= blank[1:] & blank[:-1]
    some = bounds[:-1][np.diff(bounds) > 0]
    bad[some] |= blank[some]
    last = bounds[1:][np.diff(bounds) > 0] - 1
    bad[last] |= blank[last]
    at = [np.flatnonzero(bad)]
    for wide in _WIDE.values():
        at.append(np.array([m.start() for m in wide.finditer(data)], np.int64))
    at.append(np.array([m.start() for m in _ADDED.finditer(data)], np.int64))
    odd = np.zeros(len(bounds) - 1, bool)
    odd[np.searchsorted(bounds, np.concatenate(at), "right") - 1] = True
    return odd


class TokenIds:
    """Ids of texts as unsigned 32-bit numbers. style: byte (a space belongs to its word) or word."""

    def __init__(self, path: str, style: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.bpe = self.model.model
        self.spaced = style == "byte"
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.marks: dict[bytes, list[int]] = {}
        self.space = self.shown[32]
        self.clear()

    def clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.used = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def word(self, chunk: str) -> list[int] | None:
        """Ids of a chunk of letters (after one space, in byte style), from the model alone; None for other chunks."""
        if not (chunk[1:] if self.spaced and chunk[:1] == " " else chunk).isalpha():
            return None
        if chunk.isascii():
            return [x.id for x in self.bpe.tokenize(chunk.replace(" ", self.space) if self.spaced else chunk.lower())]
        if not self.spaced:
            chunk = self.model.normalizer.normalize_str(chunk)
            if not chunk.isalpha():
                return None
        return [x.id for x in self.bpe.tokenize(chunk.encode().decode("latin-1").translate(self.shown))]

    def found(self, chunks: list[bytes]) -> list[list[int]]:
        """The ids of chunks that the memo lacks."""
        out: list[list[int] | None] = []
        rest: list[int] = []
        get, start = self.memo.get, self.start
        for i, chunk in enumerate(chunks):
            bare = chunk.rstrip(_MARKS)
            if len(bare) == len(chunk):
                ids = self.word(chunk.decode())
            else:
                # ASCII letters stay letters, so the memo's ids of the bare word hold before a mark too
                at = get(bare) if bare.isascii() and bare.lstrip(b" ").isalpha() else None
                ids = self.ids[start[at] : start[at + 1]].tolist() if at is not None else self.word(bare.decode())
                ids = None if ids is None else ids + self.mark(chunk[len(bare) :])
            out.append(ids)
            if ids is None:
                rest.append(i)
        for i, ids in zip(rest, self.encode([chunks[i].decode() for i in rest]), strict=True):
            out[i] = ids
        return out

    def mark(self, tail: bytes) -> list[int]:
        if tail not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[tail] = self.encode([tail.decode()])[0]
        return self.marks[tail]

    def _keep(self, chunks: list[bytes], ids: list[list[int]]) -> None:
        flat = np.fromiter((x for part in ids for x in part), np.uint32)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + len(flat), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        n = len(self.memo)
        if n + len(chunks) + 1 > len(self.start):
            self.start = np.concatenate([self.start[: n + 1], np.zeros(n + len(chunks) + 1, np.int64)])
        self.start[n + 1 : n + len(chunks) + 1] = self.used + np.cumsum([len(x) for x in ids])
        self.used += len(flat)
        self.memo.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def of_slice(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all rows of a slice, and where each row's end."""
        data, sizes = raw.tobytes(), np.diff(bounds)
        odd = odd_rows(raw, data, bounds)
        whole = self.encode([data[bounds[i] : bounds[i + 1]].decode() for i in np.flatnonzero(odd)])
        cut = (raw == 32) | (raw == 10)
        if not self.spaced:
            data = data.replace(b"\n", b" ")
        for i in np.flatnonzero(odd):  # an odd row is one chunk, which is not looked at
            cut[bounds[i] : bounds[i + 1]] = False
        cut[bounds[:-1][sizes > 0]] = True
        first = np.flatnonzero(cut).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, np.int32(len(raw))).tobytes()), pa.py_buffer(data)])
        edge = np.searchsorted(first, bounds)
        keep = None
        if odd.any():
            keep = ~np.repeat(odd, np.diff(edge))
            chunks = chunks.filter(pa.array(keep))
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if not self.spaced:
            names = [x[1:] if x[:1] == b" " else x for x in names]
        had, used = len(self.memo), self.used
        get = self.memo.get
        place = np.array([get(x, -1) for x in names], np.int64)
        lost = np.flatnonzero(place < 0)
        if len(lost):
            new = list(dict.fromkeys([names[i] for i in lost]))
            self._keep(new, self.found(new))
            place[lost] = [get(names[i]) for i in lost]
        size = (self.start[place + 1] - self.start[place])[coded.indices.to_numpy()]
        begin = self.start[place][coded.indices.to_numpy()]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + size, size)]
        if keep is not None:
            every = np.zeros(len(first), np.int64)
            every[keep] = size
            every[~keep] = [len(x) for x in whole]
            inner, ends = np.repeat(keep, every), np.cumsum(every)
            out = np.empty(len(inner), np.uint32)
            out[inner] = ids
            out[~inner] = np.concatenate([np.array(x, np.uint32) for x in whole])
            ids = out
        if len(lost) and ENTRY * len(self.memo) + 4 * self.used > MEMO_BYTES:
            for x in new:
                del self.memo[x]
            assert len(self.memo) == had
            self.used = used
        return ids, np.concatenate([np.zeros(1, np.int64), ends])[edge[1:]]

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        out: list[bytes] = []
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        for _, ids, ends in self.of_batches(iter([batch])):
            raw = ids.astype("<u4").tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def of_batches(self, batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """(rows, ids, ends) of runs of rows."""
        for batch, raw, bounds in text_slices(batches, text, SLICE):
            yield batch, *self.of_slice(raw, bounds)


def token_ids(path: str, style: str) -> TokenIds:
    """One encoder a worker and vocabulary."""
    if (path, style) not in _kept:
        _kept[path, style] = TokenIds(path, style)
    return _kept[path, style]


def forget() -> None:
    """Frees what this worker's encoders keep, and gives it back to the system."""
    for x in _kept.values():
        x.clear()
    pa.default_memory_pool().release_unused()
