"""SentencePiece BPE encoding with seeded merge-dropout, and decoding (operator 6).

The agenda of a pre-token holds its candidate merges, best score first and leftmost among equals; each
popped candidate is skipped for good if a keyed hash of it (seed, variant of the place, pre-token, and
where its two parts begin and end) falls under ``dropout``. A candidate's fate so depends on nothing but
itself: reruns agree, other seeds and places cut words differently, and ``dropout=0`` is the library's
own encoding. All pre-tokens of a slice of text are worked off side by side, one agenda pop of each per
round; long ones take a heap each. Pre-tokens met before are remembered, up to ``REMEMBERED``.

The variant of a place is a keyed hash of doc_id and of the pre-token's number in the text, modulo ``VARIANTS``:
a word is cut in up to so many ways for a seed, within a document as between them. Rows of one doc_id and
text (passes of a mix) are cut alike, as nothing tells them apart. Characters without a piece, and a
literal U+2581 (which the library would turn into a space), become byte pieces: decoding gives back every
text exactly.

Cases: NULL counts as empty and gives no ids; repeated rows get the same ids; NULL doc_id is a doc_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpuslens.llm.batches import Rolling, buffers, column, mix, slices
from corpuslens.llm.shared import sent_text
from corpuslens.llm.tokens import MARK, load

DROPOUT = 0.1
SEED = 20
#: Bytes of text worked off at a time: some 30 arrays of 4 to 8 bytes for each.
SLICE = 1 << 18
VARIANTS = 8
REMEMBERED = 100_000
#: Pre-tokens of more characters take a heap each.
LONG = 48

_NEVER = np.int64(1) << 62
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Vocabulary:
    """Pieces, merges by pair of ids, and byte pieces of a model.

    ``held`` is all of it as plain arrays, which a broadcast carries to executors without this package.
    """

    @classmethod
    def of(cls, held: dict) -> Vocabulary:
        vocabulary = cls.__new__(cls)
        vocabulary.__dict__.update(held)
        return vocabulary

    @property
    def held(self) -> dict:
        return dict(self.__dict__)

    def __init__(self, model: bytes):
        library = load(model)
        self.size = library.get_piece_size()
        byte = [library.is_byte(i) for i in range(self.size)]
        text = [library.id_to_piece(i) for i in range(self.size)]
        plain = {
            t: i for i, t in enumerate(text) if not (byte[i] or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))
        }
        self.byte_ids = np.array([i for i in range(self.size) if byte[i]], np.int32)
        if len(self.byte_ids) != 256:
            raise ValueError("this vocabulary has no byte pieces")
        self.chars = np.full(0x110001, -1, np.int32)
        for t, i in plain.items():
            if len(t) == 1:
                self.chars[ord(t)] = i
        scores = sorted({library.get_score(i) for i in plain.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        merges = {}
        for t, i in plain.items():
            for cut in range(1, len(t)):
                left, right = plain.get(t[:cut]), plain.get(t[cut:])
                if left is not None and right is not None:
                    merges[left << 32 | right] = (i, rank[library.get_score(i)])
        self.keys = np.array(sorted(merges), np.int64)
        self.slots = self.place_keys()
        self.merged = np.array([merges[k][0] for k in self.keys.tolist()], np.int64)
        self.ranks = np.array([merges[k][1] for k in self.keys.tolist()], np.int64)
        data = [t.replace(MARK, " ").encode() for t in text]
        for value, i in enumerate(self.byte_ids.tolist()):
            data[i] = bytes([value])
        named = set(plain.values())
        data = [d if i in named or byte[i] else b"" for i, d in enumerate(data)]
        self.lengths = np.array(list(map(len, data)), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def place_keys(self) -> np.ndarray:
        """Row of ``keys`` by slot of a hash table with open addressing (-1: free)."""
        slots = np.full(1 << max(8, (4 * len(self.keys)).bit_length()), -1, np.int32)
        todo, at = np.arange(len(self.keys)), self.slot(self.keys, len(slots))
        while len(todo):
            free = np.flatnonzero(slots[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            slots[at[placed]] = todo[placed]
            rest = np.ones(len(todo), bool)
            rest[placed] = False
            todo, at = todo[rest], (at[rest] + 1) & (len(slots) - 1)
        return slots

    @staticmethod
    def slot(keys: np.ndarray, size: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * _C[0]) >> np.uint64(65 - size.bit_length())).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the merge table, and whether the pair is there."""
        key = left.astype(np.int64) << 32 | right
        slot = self.slot(key, len(self.slots))
        at = self.slots[slot]
        known = (at >= 0) & (self.keys[at] == key)
        open_ = np.flatnonzero((at >= 0) & ~known)
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
            at[open_] = self.slots[slot[open_]]
            known[open_] = (at[open_] >= 0) & (self.keys[at[open_]] == key[open_])
            open_ = open_[(at[open_] >= 0) & ~known[open_]]
        return at, known


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """The keyed hash that decides over one candidate merge, for arrays of them."""
    if not dropout:
        return np.zeros(len(key), bool)
    h = mix(key + start.astype(np.uint64) * _C[0] + middle.astype(np.uint64) * _C[1] + end.astype(np.uint64) * _C[2])
    return h < np.uint64(min(dropout, 1 - 2**-53) * 2.0**64)


def agenda(vocabulary: Vocabulary, symbols: list[int], key: int, dropout: float) -> list[int]:
    """One pre-token by a heap of candidates."""
    n = len(symbols)
    symbols, before, after, end = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    heap, keys = [], np.array([key], np.uint64)

    def offer(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and after[i] < n]
        if not lefts:
            return
        rights = [after[i] for i in lefts]
        at, known = vocabulary.look_up(np.array([symbols[i] for i in lefts]), np.array([symbols[j] for j in rights]))
        ends = [end[j] for j in rights]
        drop = skipped(np.repeat(keys, len(lefts)), np.array(lefts), np.array(rights), np.array(ends), dropout)
        for k in np.flatnonzero(known & ~drop).tolist():
            heapq.heappush(heap, (int(vocabulary.ranks[at[k]]), lefts[k], rights[k], ends[k], int(vocabulary.merged[at[k]])))

    offer(list(range(n - 1)))
    while heap:
        _, left, right, stop, merged = heapq.heappop(heap)
        if symbols[left] < 0 or after[left] != right or end[left] != right or end[right] != stop:
            continue
        symbols[left], symbols[right], end[left], after[left] = merged, -1, stop, after[right]
        if after[left] < n:
            before[after[left]] = left
        offer([before[left], left])
    return [s for s in symbols if s >= 0]


def side_by_side(
    vocabulary: Vocabulary, symbols: np.ndarray, counts: np.ndarray, keys: np.ndarray, dropout: float
) -> tuple[np.ndarray, np.ndarray]:
    """Many pre-tokens at once: one pop of every agenda per round. Gives ids and how many each has.

    Every symbol holds the candidate it makes with the next one: rank and place in ``order``, the piece in
    ``merged``. A merge changes the candidates of its symbol and of the one before; no other is looked up.
    """
    word = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(symbols)) - np.repeat(np.cumsum(counts) - counts, counts)
    end = start + 1
    symbols = symbols.astype(np.int64)
    order, merged = np.full(len(symbols), _NEVER), np.zeros(len(symbols), np.int64)

    def offer(at: np.ndarray) -> None:
        order[at] = _NEVER
        at = at[at + 1 < len(word)]
        at = at[word[at] == word[at + 1]]
        row, known = vocabulary.look_up(symbols[at], symbols[at + 1])
        at, row = at[known], row[known]
        fine = ~skipped(keys[word[at]], start[at], start[at + 1], end[at + 1], dropout)
        at, row = at[fine], row[fine]
        order[at] = vocabulary.ranks[row] << 32 | start[at]
        merged[at] = vocabulary.merged[row]

    offer(np.arange(len(symbols)))
    done_word, done_symbol = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(symbols):
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, len(symbols))))
        stay = best < _NEVER
        done_word.append(word[~stay])
        done_symbol.append(symbols[~stay])
        left = np.flatnonzero(stay & (order == best))
        symbols[left] = merged[left]
        end[left] = end[left + 1]
        stay[left + 1] = False
        at = (np.cumsum(stay) - 1)[left]
        symbols, word, start, end, order, merged = (x[stay] for x in (symbols, word, start, end, order, merged))
        offer(np.concatenate([at, at[(at > 0)] - 1]))
    word = np.concatenate(done_word)
    return np.concatenate(done_symbol)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(counts))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indices ``start, start + 1, ...`` of many runs, one run after the other."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - counts), counts)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, seed: int = SEED, dropout: float = DROPOUT, variants: int = VARIANTS):
        self.vocabulary, self.dropout, self.variants = vocabulary, dropout, np.uint64(variants)
        self.salt = mix(np.array([seed], np.uint64))[0]
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, symbols: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> None:
        """Remembers how these pre-tokens are cut."""
        offset, long = np.cumsum(counts) - counts, counts > LONG
        short = np.flatnonzero(~long)
        ids, held = side_by_side(
            self.vocabulary, symbols[spread(offset[short], counts[short])], counts[short], keys[short], self.dropout
        )
        parts, sizes, order = [ids], [held], [short]
        for w in np.flatnonzero(long):
            cut = agenda(self.vocabulary, symbols[offset[w] : offset[w] + counts[w]].tolist(), int(keys[w]), self.dropout)
            parts.append(np.array(cut))
            sizes.append(np.array([len(cut)]))
            order.append(np.array([w]))
        ids, sizes, order = np.concatenate(parts), np.concatenate(sizes).astype(np.int64), np.concatenate(order)
        ids, sizes = self.with_bytes(ids, sizes)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(len(ids) + len(self.ids), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        base = len(self.starts)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.counts = np.concatenate([self.counts, sizes])
        self.used += len(ids)
        self.known.update(zip(keys[order].tolist(), range(base, base + len(order))))

    def with_bytes(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters (ids from the vocabulary's size on) as byte pieces."""
        odd = np.flatnonzero(ids >= self.vocabulary.size)
        if not len(odd):
            return ids, sizes
        lengths = np.ones(len(ids), np.int64)
        chars = [chr(c if c < 0x110000 else ord(MARK)).encode() for c in (ids[odd] - self.vocabulary.size).tolist()]
        lengths[odd] = list(map(len, chars))
        out = np.repeat(ids, lengths)
        begin = np.cumsum(lengths) - lengths
        out[spread(begin[odd], lengths[odd])] = self.vocabulary.byte_ids[np.frombuffer(b"".join(chars), np.uint8)]
        return out, np.add.reduceat(np.append(lengths, 0), np.cumsum(sizes) - sizes) if len(sizes) else sizes

    def encode(self, texts: pa.Array, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after each other, and where each text's ids begin. ``docs`` tells documents apart."""
        data, offsets = buffers(texts)
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.int32)
        at = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
        chars = np.where(chars == ord(MARK), 0x110000, np.where(chars == 32, ord(MARK), chars))
        filled = np.flatnonzero(np.diff(at))
        chars = np.insert(chars, at[filled], ord(MARK))  # the dummy space before every text
        if not len(chars):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        first = at[filled] + np.arange(len(filled))
        space = chars == ord(MARK)
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[first] = True
        begin = np.flatnonzero(begins)
        counts = np.diff(np.append(begin, len(chars)))
        text = np.searchsorted(first, begin, side="right") - 1
        owner = filled[text]
        number = np.arange(len(begin)) - np.searchsorted(begin, first)[text]
        variant = mix(docs[owner].astype(np.uint64) + number.astype(np.uint64) * _C[1] + self.salt) % self.variants
        keys = mix(Rolling(mix(chars.astype(np.uint64) + np.uint64(1))).hash(begin, begin + counts) ^ mix(variant + self.salt))
        different, where, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.clear()
        rows = np.fromiter(map(self.known.get, different.tolist(), repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(rows < 0)
        if len(new):
            pick = where[new]
            symbols = chars[spread(begin[pick], counts[pick])]
            pieces = self.vocabulary.chars[symbols]
            self.learn(np.where(pieces < 0, symbols + self.vocabulary.size, pieces), counts[pick], different[new])
            rows = np.fromiter(map(self.known.__getitem__, different.tolist()), np.int64, len(different))
        mine = rows[which]
        held = self.counts[mine]
        ids = self.ids[spread(self.starts[mine], held)]
        per_text = np.bincount(owner, held, len(texts)).astype(np.int64)
        return ids, np.append(0, np.cumsum(per_text))


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts; the dummy space in front of each goes."""
    lengths = vocabulary.lengths[ids]
    out = vocabulary.data[spread(vocabulary.starts[ids], lengths)]
    at = np.append(0, np.cumsum(lengths))[offsets]
    filled = at[1:] > at[:-1]
    keep = np.ones(len(out), bool)
    heads = at[:-1][filled]
    keep[heads[out[heads] == 32]] = False
    at = np.append(0, np.cumsum(keep))[at]
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out[keep])])
    return raw.cast(pa.large_string()).cast(pa.string())


def encode(
    docs: DataFrame, model: bytes, columns: list[str], seed: int = SEED, dropout: float = DROPOUT, variants: int = VARIANTS, decoded: bool = False
) -> DataFrame:
    """``columns`` of every row and ``piece_ids``, the ids of its text. With ``decoded`` the same task turns the
    ids back and adds the text they give as ``decoded``."""
    document = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model).held)  # as large as the model
    sent, text = sent_text(docs, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(shared.value)
        encoder = Encoder(vocabulary, seed, dropout, variants)
        for part in slices(batches, text, SLICE):
            ids, offsets = encoder.encode(column(part, text), column(part, "__cl_document").to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            texts = [decode_ids(vocabulary, ids, offsets)] if decoded else []
            yield pa.RecordBatch.from_arrays([*(column(part, c) for c in columns), lists, *texts], names)

    names = [*columns, "piece_ids", *["decoded"] * decoded]
    more = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    schema = T.StructType([*(docs.schema[c] for c in columns), *more[: 1 + decoded]])
    return docs.select(*sent, document.alias("__cl_document")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of its ``piece_ids`` (NULL ids: empty)."""

    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model).held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = column(part, "piece_ids")
                counts = np.array(lists.value_lengths().fill_null(0))
                texts = decode_ids(vocabulary, lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
