"""Words and hashes of whole texts, for Arrow batches inside tasks.

A batch is cut into slices of about ``SLICE_BYTES`` of text, so memory follows the slice (or one single
text that is longer), not the batch. NULL texts count as empty. Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Where words or shingles are hashed, some 30 arrays of 8 bytes a byte or word are held at once.
WORD_SLICE = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 1


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows, each part holding about ``limit`` bytes of ``column`` or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        upto = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column in one array, and the offsets of its rows."""
    if texts.null_count:
        texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any window over a sequence of 64-bit values, each in a few vector operations."""

    def __init__(self, values: np.ndarray, base: int = _BASE):
        n = len(values)
        self.back = powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Words:
    """Words of a string column: where they begin and end in ``data``, and which rows own them.

    ``first[i]`` to ``first[i + 1]`` are the words of row i.
    """

    def __init__(self, texts: pa.Array, plain: np.ndarray | None = None):
        """``plain`` maps bytes before they are read, such as ``LOWER``."""
        data, offsets = buffers(texts)
        if plain is not None:
            data = plain[data]
        self.data, self.offsets = data, offsets
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~WHITE[data]
        begins, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] |= solid[inner + 1]
        ends[inner - 1] |= solid[inner]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.count = np.diff(self.first)

    @cached_property
    def hashes(self) -> np.ndarray:
        return Rolling(BYTE_VALUES[self.data]).hash(self.begin, self.end)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII lower-cased, with every sign a space: signs part words and carry no meaning.
PLAIN = LOWER.copy()
PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 32


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours, in log(width) steps."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def winnow(hashes: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Marks every position that holds the least hash of some ``width`` neighbours that are all valid.

    Which positions of a run of ``width`` are least depends on that run alone, so equal runs, wherever
    they stand, always mark at least one equal position.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(n, bool)
    whole = sliding(valid, width, np.logical_and)
    least = np.where(whole, sliding(hashes, width, np.minimum), 0)
    wide = np.zeros(n + width - 1, np.uint64)
    wide[width - 1 : n] = least
    found = np.zeros(n + width - 1, bool)
    found[width - 1 : n] = whole
    return valid & sliding(found, width, np.logical_or) & (sliding(wide, width, np.maximum) == hashes)
