"""Ids of a `tokenizers` vocabulary with word ends, a batch of texts at a time, memoised by pre-token.

The vocabulary's pattern drops white space and no match spans it, so the ids of a text are those of
its words. Words are cut at ASCII white space only; other white space stays inside a word and is
left to the library. A word of Latin-1 letters, digits and ASCII signs without an apostrophe is cut
further, where the pattern would cut it: into runs of letters, single digits and runs of signs, all
in lower case. Any other word (marks, other scripts, contractions, special strings) goes to the
library whole.

Cuts and lower case are found on the joined bytes of a batch; Arrow's dictionary encoding gives the
distinct pre-tokens, and only those that the memo lacks reach the library.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: An id as it is written: little-endian, unsigned, 32 bits.
ID = np.dtype("<u4")

_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _kinds() -> np.ndarray:
    """Of each byte alone: its kind."""
    out = np.full(256, _ODD, np.uint8)
    out[[*range(9, 14), 32]] = _SPACE
    for b in range(33, 127):
        out[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN
    out[ord("'")] = _ODD
    return out


_KIND = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lead byte of U+00C0 to U+00FF; second bytes of the two signs among them, and of the last capital.
_LEAD, _TIMES, _DIVIDED, _LAST_CAPITAL = 0xC3, 0x97, 0xB7, 0x9E


def _symbols() -> dict[int, str]:
    """The signs by which a byte-level vocabulary writes bytes: printable ones as they are, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(hidden) if b != 32}


_SYMBOLS = _symbols()


def cut(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pre-tokens, their offsets, which are whole odd words, how many stand before each of the `starts`.

    `raw` holds joined UTF-8 texts that begin at `starts` (ascending, the last one is the end).
    """
    n = len(raw)
    kind, low = _KIND[raw], _LOWER[raw]
    leads = np.flatnonzero(raw[:-1] == _LEAD)
    if len(leads):
        second = raw[leads + 1]
        letters = leads[(second & 0xC0 == 0x80) & (second != _TIMES) & (second != _DIVIDED)]
        kind[letters] = kind[letters + 1] = _LETTER
        capitals = letters[raw[letters + 1] <= _LAST_CAPITAL] + 1
        low[capitals] += 32
    begins = np.zeros(n + 1, bool)
    begins[starts] = True
    special = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|"))) if n else np.empty(0, np.int64)
    kind[special] = _ODD
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        # an odd byte makes its whole word odd, between white space or the ends of its text
        edge = kind == _SPACE
        first = np.flatnonzero(~edge & np.r_[True, edge[:-1] | begins[1:n]])
        last = np.flatnonzero(~edge & np.r_[edge[1:] | begins[1:n], True]) + 1
        own = np.unique(np.searchsorted(first, odd, "right") - 1)
        step = np.zeros(n + 1, np.int8)
        step[first[own]] += 1
        step[last[own]] -= 1
        whole = np.cumsum(step[:n], dtype=np.int8).astype(bool)
        kind[whole] = _ODD
        low = np.where(whole, raw, low)
    filled = kind != _SPACE
    marks = np.empty(n, bool)
    marks[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=marks[1:])
    marks |= kind == _DIGIT
    marks |= begins[:n]
    offsets = np.flatnonzero(marks[filled])
    kept = np.append(np.int32(0), np.cumsum(filled, dtype=np.int32))[starts]
    return low[filled], np.append(offsets, kept[-1]), kind[filled][offsets] == _ODD, np.searchsorted(offsets, kept)


class WordIds:
    """Ids of whole texts. The memo is begun anew when it holds about `limit` bytes."""

    def __init__(self, path: str, limit: int = 100_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # the same merges without the normaliser and the pattern, for what is cut already
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        # place of a pre-token's ids in `flat`: from at[k], size[k] of them
        self.places: dict[bytes, int] = {}
        self.flat, self.at, self.size, self.used, self.held = np.empty(1 << 16, ID), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), 0, 0

    def _keep(self, tokens: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        k = len(self.places)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while k + len(tokens) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[k : k + len(tokens)] = sizes
        self.at[k : k + len(tokens)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.places.update(zip(tokens, range(k, k + len(tokens)), strict=True))
        self.held += sum(map(len, tokens)) + 150 * len(tokens) + 4 * len(ids)

    def _whole(self, tokens: list[bytes]) -> None:
        if not tokens:
            return
        got = [np.array(e.ids, ID) for e in self.library.encode_batch_fast([t.decode("utf-8", "replace") for t in tokens], add_special_tokens=False)]
        self._keep(tokens, np.concatenate(got), np.array([len(x) for x in got]))

    def _learn(self, new: list[bytes]) -> None:
        """Ids of pre-tokens, many in one text: the last id of each has a word end, and no other id has."""
        for k in range(0, len(new), 500):
            part = new[k : k + 500]
            line = b" ".join(part).decode("latin-1")
            ids = np.array(self.merges.encode_batch_fast([line if line.isascii() else line.translate(_SYMBOLS)], add_special_tokens=False)[0].ids, ID)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                self._whole(part)
                continue
            self._keep(part, ids, np.diff(stops, prepend=0))

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column (null: empty), and offsets of each text's ids.

        `end_id`, if given, is appended to each text.
        """
        texts = column.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        if not len(texts):
            return np.empty(0, ID), np.zeros(1, np.int64)
        _, where, data = texts.buffers()
        starts = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.empty(0, np.uint8)
        body, offsets, odd, before = cut(raw, starts - starts[0])
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)]).dictionary_encode()
        tokens, own = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
        if self.held > self.limit:
            self._clear()
        places, whole = self.places, np.zeros(len(tokens), bool)
        whole[own[odd]] = True
        new = [(t, w) for t, w in zip(tokens, whole.tolist(), strict=True) if t not in places]
        self._learn([t for t, w in new if not w])
        self._whole([t for t, w in new if w])
        place = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))[own]
        size, at = self.size[place].astype(np.int64), self.at[place]
        if end_id is not None:
            # one more pre-token at each text's end, whose id stands behind the memo's
            self._reserve(end_id)
            size, at = np.insert(size, before[1:], 1), np.insert(at, before[1:], self.used)
            before = before + np.arange(len(before))
        stops = np.cumsum(size)
        ids = self.flat[np.repeat(at - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)]
        return ids, np.concatenate([[0], stops])[before]

    def _reserve(self, end_id: int) -> None:
        if self.used == len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used] = end_id


@lru_cache(maxsize=1)
def word_ids(path: str, limit: int = 100_000_000) -> WordIds:
    return WordIds(path, limit)
