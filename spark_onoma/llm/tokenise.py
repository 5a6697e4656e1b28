"""Byte-level BPE ids of whole texts: pre-token borders in numpy, the library once per new pre-token."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from spark_onoma.llm.textops import CHUNK_BYTES, U64, chunks, mix, powers, stream

TOKENIZER_FILE = "byte_bpe_50k.json"
#: Remembered pre-tokens of a worker; when full, it starts anew.
MEMO = 400_000
#: Bits of the place of a pre-token in the memo; a later one of the same place displaces an earlier one.
_PLACES = 22
_SAFE = 0x2060
LETTER, NUMBER, OTHER, BLANK, WHITE, UNSAFE = range(6)


def default_tokenizer() -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def _kinds() -> np.ndarray:
    """Class by code point, for the blocks whose categories no Unicode version has changed; UNSAFE for all others."""
    out = np.full(_SAFE + 1, UNSAFE, dtype=np.uint8)
    for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0]] = WHITE
    out[0x20] = BLANK
    return out


KINDS = _kinds()
CODE = stream(31, _SAFE + 1)


def _letters() -> np.ndarray:
    """The letter that byte-level BPE has for each byte: itself where it is printable Latin-1, else from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, dtype="<u4")
    out[shown] = shown
    rest = [b for b in range(256) if not out[b]]
    out[rest] = 256 + np.arange(len(rest))
    return out


LETTERS = _letters()


class Encoder:
    """Ids of a tokenizers file of the byte-level BPE kind, equal to the library's own on every text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.place = np.zeros(1 << _PLACES, np.int32)
        self.keys, self.at, self.size, self.pool = np.zeros(1, U64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of single pre-tokens that are already in the model's byte letters."""
        found = [[x.id for x in self.tokenizer.model.tokenize(t)] for t in texts]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def marked(self, data: np.ndarray) -> np.ndarray:
        """Where the text of an added token starts; only the library knows its id and what it takes with it."""
        raw, out = data.tobytes(), []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                out.append(at)
                at = raw.find(token, at + 1)
        return np.array(out, np.int64)

    def _borders(self, kind: np.ndarray, code: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where pre-tokens start; ``rows``: True where a row starts, one longer than the text."""
        n = len(kind)
        before = np.full(n, UNSAFE, np.uint8)
        before[1:] = kind[:-1]
        before[rows[:n]] = UNSAFE
        white = (kind == BLANK) | (kind == WHITE)
        was_white = (before == BLANK) | (before == WHITE)
        start = np.where(white, ~was_white, (kind != before) & (before != BLANK)) | rows[:n]
        last = np.zeros(n, dtype=bool)
        last[:-1] = white[:-1] & ~white[1:] & ~rows[1:n]
        start |= last
        for i in np.flatnonzero((code == 39) & (before != OTHER) & (before != BLANK)):
            end = int(i) + 1
            while end < n and end < i + 3 and not rows[end]:
                end += 1
            tail = "".join(map(chr, code[i + 1 : end]))
            size = 1 if tail[:1] in ("s", "t", "m", "d") and tail else 2 if tail in ("re", "ve", "ll") else 0
            if size:
                start[i + 1 : i + 1 + size] = False
                if i + 1 + size < n:
                    after = i + 1 + size
                    start[after] = start[after] or not white[after] or not was_white[after]
        return np.flatnonzero(start)

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, ids per row)."""
        rows = len(offsets) - 1
        text = data.tobytes().decode()
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(code)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        count = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=count[1:])
        bounds = count[offsets]
        low = np.minimum(code, _SAFE)
        kind = KINDS[low]
        unsafe = np.zeros(n + 1, np.int64)
        np.cumsum(kind == UNSAFE, out=unsafe[1:])
        slow = unsafe[bounds[1:]] > unsafe[bounds[:-1]]
        slow[np.searchsorted(offsets[1:], self.marked(data), "right")] = True
        slow = np.flatnonzero(slow)
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        start = self._borders(kind, code, edge)
        end = np.append(start[1:], n)
        row = np.searchsorted(bounds[1:], start, "right")
        if len(slow):
            stay = ~np.isin(row, slow)
            start, end, row = start[stay], end[stay], row[stay]
        up, down = powers(n + 1)
        prefix = np.zeros(n + 1, U64)
        np.cumsum(CODE[low] * up[:n], out=prefix[1:])
        keys = mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))
        if len(self.keys) > MEMO:
            self._forget()
        spot = (keys >> U64(64 - _PLACES)).astype(np.int64)
        entry = self.place[spot].astype(np.int64)
        miss = np.flatnonzero(self.keys[entry] != keys)
        if len(miss):
            fresh, first, which = np.unique(keys[miss], return_index=True, return_inverse=True)
            byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            letters = LETTERS[data].tobytes().decode("utf-32-le")
            first = miss[first]
            ids, size = self._pieces([letters[a:b] for a, b in zip(byte[start[first]].tolist(), byte[end[first]].tolist(), strict=True)])
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(size) - size])
            self.size, self.pool = np.concatenate([self.size, size]), np.concatenate([self.pool, ids])
            entry[miss] = len(self.keys) + which
            self.place[spot[first]] = len(self.keys) + np.arange(len(fresh))
            self.keys = np.concatenate([self.keys, fresh])
        at, size = self.at[entry], self.size[entry]
        total = np.bincount(row, weights=size, minlength=rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
        ids = self.pool[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] if len(size) else np.zeros(0, np.uint32)
        if len(slow):
            parts = np.split(ids, np.cumsum(total)[:-1])
            for r in slow.tolist():
                parts[r], one = self._library([text[bounds[r] : bounds[r + 1]]])
                total[r] = one[0]
            ids = np.concatenate(parts)
        return ids, total


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, kept for its later tasks."""
    return Encoder(path)


def portions(data: np.ndarray, limit: int = CHUNK_BYTES) -> list[np.ndarray]:
    """A long text's bytes in parts of about ``limit``, each but the first starting at a space between two ASCII letters.

    A pre-token ends before such a space and another starts with it, so the parts' ids are the text's ids. Without
    such a space behind the limit the rest stays whole.
    """
    if len(data) <= 2 * limit:
        return [data]
    low = data | 0x20
    letter = (low >= 97) & (low <= 122) & (data < 128)
    cuts = np.flatnonzero((data[1:-1] == 0x20) & letter[:-2] & letter[2:]) + 1
    out, at = [], 0
    while len(data) - at > 2 * limit and (k := int(np.searchsorted(cuts, at + limit))) < len(cuts):
        out.append(data[at : cuts[k]])
        at = int(cuts[k])
    return [*out, data[at:]]


def encoded(column: pa.Array, path: str, end_id: int):
    """(first row, row after the last, ids with ``end_id`` after each row, ids per row) of a string column."""
    tool = encoder(path)
    for first, last, data, offsets in chunks(column):
        if last - first == 1:
            parts = [tool.chunk(x, np.array([0, len(x)]))[0] for x in ([data] if len(tool.marked(data)) else portions(data))]
            ids = np.concatenate(parts)
            size = np.array([len(ids)])
        else:
            ids, size = tool.chunk(data, offsets)
        yield first, last, np.insert(ids, np.cumsum(size), end_id).astype(np.uint32), size + 1
