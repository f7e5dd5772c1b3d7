"""Words of texts as 64-bit hashes, by array operations over the bytes of a column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are looked at together, in arrays of 8 bytes for each; a longer text is cut at its white space.
WINDOW = 1 << 19

_draw = np.random.Generator(np.random.Philox(20))
_PLAIN = _draw.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_BASE = _draw.integers(0, 1 << 64, 1, np.uint64)[0] | np.uint64(5)
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_PLAIN[_space] = 0
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class WordHasher:
    """Hashes of words [^\\x20\\x09-\\x0D]+: the sum, modulo 2**64, of a drawn number for each byte times a power of a
    drawn base for its place, mixed.  lower: A-Z count as a-z."""

    def __init__(self, lower: bool = False) -> None:
        self.table = _LOWER if lower else _PLAIN
        self.powers = np.ones(1, np.uint64)

    def of_bytes(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place) of each word of the bytes; no word goes on over an offset in begins."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        word = ~_space[data]
        new = np.append(True, ~word[:-1])
        new[begins[begins < len(data)]] = True
        at = np.flatnonzero(word & new)
        if not len(at):
            return np.zeros(0, np.uint64), at
        sizes = np.diff(np.append(at, len(data)))
        if (most := int(sizes.max())) > len(self.powers):
            self.powers = np.cumprod(np.append(np.uint64(1), np.full(2 * most, _BASE)))
        place = np.arange(len(data) - at[0]) - np.repeat(at - at[0], sizes)
        return mixed(np.add.reduceat(self.table[data[at[0] :]] * self.powers[place], at - at[0])), at

    def long_text(self, data: np.ndarray) -> np.ndarray:
        """The words of one text of any length, in windows that end at white space."""
        out, start = [], 0
        while start < len(data):
            end = min(start + WINDOW, len(data))
            while end < len(data) and not _space[data[end - 1]]:
                ahead = np.flatnonzero(_space[data[end : end + WINDOW]])
                end = end + int(ahead[0]) + 1 if len(ahead) else min(end + WINDOW, len(data))
            out.append(self.of_bytes(data[start:end], np.zeros(1, np.int64))[0])
            start = end
        return np.concatenate(out)

    def slices(self, column: pa.Array, most: int = WINDOW) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, hashes of all words end to end, words of each row) for slices of about `most` bytes of a string
        column; nulls have no words."""
        column = column.fill_null("") if column.null_count else column
        width = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2] if len(column) else None
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        start = 0
        while start < len(column):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            own = data[offsets[start] : offsets[end]]
            if end == start + 1 and len(own) > WINDOW:
                h = self.long_text(own)
                yield slice(start, end), h, np.array([len(h)])
            else:
                begins = offsets[start : end + 1] - offsets[start]
                h, at = self.of_bytes(own, begins[:-1])
                yield slice(start, end), h, np.diff(np.searchsorted(at, begins))
            start = end
