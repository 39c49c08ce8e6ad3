"""Alignment of the tokens of two tokenizers over the same bytes (operator 13).

A text's tokens under both tokenizers are intervals of bytes. Interval coalescing: the intervals of A and B
are sorted together by their start (``lexsort``); a running maximum of ends (``maximum.accumulate``) shows
where a group ends, namely where the next start reaches it; within a group every A token is linked to the B
tokens whose bytes it overlaps, found by position in the sorted ends and starts.

A single space between two other characters is a border for both tokenizers (``parts_at_spaces`` proves it
from the two vocabularies, else texts stay whole): no token holds it inside, so a text is the sequence of
its parts, each aligned as a text of its own, and groups never cross it. Parts are remembered, up to
``REMEMBERED`` (a bound on memory, some 100 MB a task; those met once are forgotten first and aligned again). Memory follows a slice
of texts or one single text that is longer; tokenizers see no more at once than a run without such a space.

Then the corpus is counted: in how many documents does an id pair occur? Documents keep their distinct pairs
with multiplicities in the shared folder, so texts are tokenised once. The most frequent pairs (at most
``BROADCAST_PAIRS``, a bound of some 16 MB) are looked up in the task that reads the document; what is
rarer joins by shuffle, where no key is hot, because each such pair is rarer than all those sent.

Cases: NULL and empty texts, and texts whose tokens do not give back their bytes (a literal U+2581), have no
tokens: zeros and an empty digest. Special strings are ordinary text. Repeated rows count as documents of
their own. An empty table gives no rows. Columns of other names are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.batches import column, slices
from corpuslens.llm.shared import keep, text_of
from corpuslens.llm.tokens import MARK, load

#: Characters of remembered parts, and so many more for each.
REMEMBERED, EACH = 1 << 24, 50
BROADCAST_PAIRS = 1 << 20
SLICE_BYTES = 1 << 18

#: A space that both tokenizers begin a token with: between characters that no tokenizer takes for white space.
_BORDER = re.compile(r"(?<=[^\s\u180e\u200b]) (?=[^\s\u180e\u200b])")
_WHITE = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() or c in "\u180e\u200b")
#: New parts that the tokenizers get in one call, joined by spaces again.
AT_ONCE = 1024


def byte_of_sign() -> dict[str, int]:
    """The signs that stand for bytes in byte-level vocabularies: printable ones for themselves, the others
    by turns from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def parts_at_spaces(a: str, b: bytes) -> bool:
    """Do both vocabularies let a text be cut at a single space between other characters?

    A must take its words by the usual byte-level pattern, in which a space belongs to what follows it, and
    change nothing before; B must put a space before a text, change no white space, and have no piece with a
    space behind another character.
    """
    a_is = json.loads(a)
    words = a_is.get("pre_tokenizer") or {}
    plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
    plain = plain and a_is.get("normalizer") is None and not any(t["lstrip"] or t["rstrip"] for t in a_is["added_tokens"])
    library = load(b)
    pieces = (library.id_to_piece(i) for i in range(library.get_piece_size()))
    kept = "".join(library.encode("  a  b ", out_type=str)) == f"{MARK}{MARK}{MARK}a{MARK}{MARK}b{MARK}"
    return bool(plain and kept and not any(MARK in p.lstrip(MARK) for p in pieces))


class Tokens:
    """Both tokenizers, and the bytes of every id."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a), load(b)
        self.a.no_truncation(), self.a.no_padding()
        self.a.encode_special_tokens = True
        signs, size = byte_of_sign(), self.b.get_piece_size()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for entry, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(signs[c] for c in entry) if all(c in signs for c in entry) else entry.encode()
        piece = self.b.id_to_piece
        self.b_bytes = [
            bytes([int(piece(i)[3:-1], 16)]) if self.b.is_byte(i) else piece(i).replace(MARK, " ").encode() for i in range(size)
        ]
        self.a_size, self.b_size = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))

    def alone(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of the texts one by one, A with a space before; none where their bytes are not those of the text."""
        a = [found.ids for found in self.a.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        of_a, of_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for i, text in enumerate(texts):
            held = b" " + text.encode()
            if b"".join(map(of_a, a[i])) != held or b"".join(map(of_b, b[i])) != held:
                a[i], b[i] = [], []
        return a, b

    def together(self, parts: list[str]) -> tuple[list[int], np.ndarray, list[int], np.ndarray] | None:
        """Ids of parts that have borders between them, in one call, and how many each has; None if one of them
        does not give back its bytes."""
        text = " ".join(parts)
        held = b" " + text.encode()
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        found = []
        for ids, data, sizes in (
            (self.a.encode(f" {text}", add_special_tokens=False).ids, self.a_bytes, self.a_size),
            (self.b.encode(text), self.b_bytes, self.b_size),
        ):
            if b"".join(map(data.__getitem__, ids)) != held:
                return None
            token_ends = np.cumsum(sizes[ids])
            upto = np.searchsorted(token_ends, ends, "right")
            if (token_ends[upto - 1] != ends).any():
                return None
            found += [ids, np.diff(upto, prepend=0)]
        return tuple(found)

    def encode(self, parts: list[str], cut: bool) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The parts in another order, the ids of A in that order and how many each has, those of B and how many."""
        single = [p for p in parts if p[0] in _WHITE or p[-1] in _WHITE] if cut else list(parts)
        apart = set(single)
        inner = [p for p in parts if p not in apart] if apart else parts
        order, found = [], []
        for start in range(0, len(inner), AT_ONCE):
            some = inner[start : start + AT_ONCE]
            ids = self.together(some)
            if ids is None:
                single += some
            else:
                order += some
                found.append(ids)
        if single:
            a, b = self.alone(single)
            order += single
            count = lambda x: np.array(list(map(len, x)), np.int64)
            found.append((list(chain.from_iterable(a)), count(a), list(chain.from_iterable(b)), count(b)))
        flat = [np.concatenate([np.asarray(f[k], np.int64) for f in found]) for k in range(4)]
        return order, *flat


def coalesce(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two sequences of tokens, given by their sizes, over the same bytes.

    Gives the group of each A and of each B token, and the links as places in A and in B.
    """
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    a_start, b_start = a_end - a_size, b_end - b_size
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((np.arange(len(start)), start))
    reach = np.maximum.accumulate(end[order])
    opens = np.ones(len(order), bool)
    opens[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    # B tokens that end behind the start of an A token and start before its end
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    count = high - low
    of_a = np.repeat(np.arange(len(a_size)), count)
    of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(count) - count, count) + low[of_a]
    return group[: len(a_size)], group[len(a_size) :], of_a, of_b


class Written:
    """Ids as text with what follows them: a comma, bar, semicolon or line end."""

    def __init__(self, a: int, b: int):
        said = lambda n: np.array([[f"{i}{sign}" for i in range(n)] for sign in ",|;\n"], object)
        self.a, self.b = said(a), said(b)

    def parts(self, flat_a, group_a, flat_b, group_b, part_of: np.ndarray) -> list[str]:
        """One text for every part that has tokens; ``part_of`` gives the part of each group."""
        n = len(part_of)
        have_a, have_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        ends_part = np.ones(n, bool)
        ends_part[:-1] = part_of[1:] != part_of[:-1]
        last_a, last_b = np.cumsum(have_a) - 1, np.cumsum(have_b) - 1
        sign_a, sign_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        sign_a[last_a], sign_b[last_b] = 1, np.where(ends_part, 3, 2)
        # in each group the tokens of A, then those of B
        out = np.empty(len(flat_a) + len(flat_b), object)
        out[np.arange(len(flat_a)) + (np.cumsum(have_b) - have_b)[group_a]] = self.a[sign_a, flat_a]
        out[np.arange(len(flat_b)) + np.cumsum(have_a)[group_b]] = self.b[sign_b, flat_b]
        return "".join(out.tolist()).split("\n")[:-1]


class Parts:
    """Aligned parts by text: what each holds, pairs of ids in one array."""

    def __init__(self, tokens: Tokens, remembered: int, cut: bool):
        self.tokens, self.remembered, self.cut = tokens, remembered, cut
        self.written = Written(len(tokens.a_bytes), len(tokens.b_bytes))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.weight = 0
        self.met = np.zeros(0, np.int64)  # how often, since others were forgotten
        self.said: list[str] = []
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.pairs, self.upto = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, texts: list[str]) -> None:
        """New parts, coalesced side by side: each begins where the one before ends, at a border of both."""
        texts, flat_a, n_a, flat_b, n_b = self.tokens.encode(texts, self.cut)
        of_a, of_b, left, right = coalesce(self.tokens.a_size[flat_a], self.tokens.b_size[flat_b])
        owner = np.repeat(np.arange(len(texts)), n_a)
        n_links = np.bincount(owner[left], minlength=len(texts))
        part_of = np.zeros(int(of_a[-1]) + 1 if len(of_a) else 0, np.int64)
        part_of[of_a] = owner
        n_groups = np.bincount(part_of, minlength=len(texts))
        said = iter(self.written.parts(flat_a, of_a, flat_b, of_b, part_of))
        self.place.update(zip(texts, range(len(self.said), len(self.said) + len(texts))))
        self.said += [next(said) if n else "" for n in n_a.tolist()]
        self.numbers = np.concatenate([self.numbers, np.stack([n_a, n_b, n_groups, n_links], 1)])
        self.pairs = np.concatenate([self.pairs, flat_a[left] << 32 | flat_b[right]])
        self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(n_links)])
        self.weight += sum(map(len, texts)) + EACH * len(texts)

    def forget(self) -> None:
        """Keeps the parts met again since the last time, as long as they are at most half of what may be kept."""
        held = np.flatnonzero(self.met > 1)
        texts = list(self.place)
        weight = sum(len(texts[i]) + EACH for i in held.tolist())
        if 2 * weight > self.remembered:
            self.clear()
            return
        size = np.diff(self.upto)[held]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.upto[held], size)
        self.place = {texts[i]: k for k, i in enumerate(held.tolist())}
        self.said = [self.said[i] for i in held.tolist()]
        self.numbers, self.pairs, self.upto = self.numbers[held], self.pairs[at], np.concatenate([[0], np.cumsum(size)])
        self.weight, self.met = weight, np.zeros(len(held), np.int64)

    def places(self, parts: list[str]) -> np.ndarray:
        """Where each part stands; unknown ones are added, others forgotten before that if there are too many."""
        if self.weight > self.remembered:
            self.forget()
        at = np.array(list(map(self.place.get, parts, repeat(-1))), np.int64)
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self.add(list(dict.fromkeys(map(parts.__getitem__, new))))
            at[new] = [self.place[parts[i]] for i in new]
        self.met = np.bincount(at, minlength=len(self.place)) + np.pad(self.met, (0, len(self.place) - len(self.met)))
        return at


def _align(parts: Parts, texts: list[str]) -> dict[str, np.ndarray | list]:
    """What a slice of texts holds: numbers, the groups' digest, distinct pairs with multiplicities."""
    pieces = [(_BORDER.split(t) if parts.cut else [t]) if t else [] for t in texts]
    at = parts.places([p for some in pieces for p in some])
    count = np.array(list(map(len, pieces)), np.int64)
    begin = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(texts)), count)
    sums = np.zeros((len(at) + 1, 5), np.int64)
    np.cumsum(np.column_stack([parts.numbers[at], parts.numbers[at, 0] == 0]), axis=0, out=sums[1:])
    numbers = sums[begin + count] - sums[begin]
    lost = numbers[:, 4] > 0  # a part without tokens is one whose bytes they do not give back
    numbers = np.where(lost[:, None], 0, numbers[:, :4])
    digests = []
    for i, (first, n) in enumerate(zip(begin.tolist(), count.tolist())):
        said = "" if lost[i] or not n else ";".join(map(parts.said.__getitem__, at[first : first + n].tolist()))
        digests.append(sha256(said.encode()).hexdigest() if said else "")
    # a part that comes again in a text counts its links as often
    live = ~lost[owner]
    key, times = np.unique(owner[live] << 32 | at[live], return_counts=True)
    doc, part = key >> 32, key & 0xFFFFFFFF
    size = parts.upto[part + 1] - parts.upto[part]
    of = np.repeat(np.arange(len(part)), size)
    pair = parts.pairs[np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + parts.upto[part][of]]
    order = np.lexsort((pair, doc[of]))
    doc, pair, weight = doc[of][order], pair[order], times[of][order]
    first = np.ones(len(pair), bool)
    first[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(first)
    return {
        "numbers": numbers, "digest": digests, "pair": pair[first], "times": np.add.reduceat(weight, first) if len(first) else first,
        "upto": np.searchsorted(doc[first], np.arange(len(texts) + 1)),
    }


def _lists(upto: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(values, kind))


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def align(docs: DataFrame, a: str, b: bytes, columns: Iterable[str] = ("doc_id",), cut: bool | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """``columns``, the four numbers, ``groups_sha256``, and the distinct linked id pairs ``pairs`` (A's id in the
    upper 32 bits, B's in the lower) with their multiplicities ``times``; one narrow stage.

    ``a`` is a byte-level tokenizer as JSON, ``b`` a SentencePiece model that puts a space before a text.
    """
    cut = parts_at_spaces(a, b) if cut is None else cut
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(Tokens(a, b), remembered, cut)
        for piece in slices(batches, "__cl_text", SLICE_BYTES):
            found = _align(parts, column(piece, "__cl_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(piece, c) for c in columns),
                    *(pa.array(np.ascontiguousarray(x)) for x in found["numbers"].T),
                    pa.array(found["digest"], pa.string()),
                    _lists(found["upto"], found["pair"], pa.int64()),
                    _lists(found["upto"], found["times"], pa.int32()),
                ],
                [*columns, *_NUMBERS, "groups_sha256", "pairs", "times"],
            )

    given = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    numbers = ", ".join(f"{n} long" for n in _NUMBERS)
    # the text goes last: what a caller names beside it may be called the same
    texts = docs.select(*columns, text_of().alias("__cl_text"))
    return texts.mapInArrow(run, f"{given}, {numbers}, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, docs``: in how many documents an id pair is linked. Combined in the reading task."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least count of pairs that may be sent to all tasks: at most ``most`` pairs have it or a higher one.

    Read from a histogram by binary order of size, at most 64 rows.
    """
    orders = counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("order")).agg(F.count(F.lit(1)).alias("n"))
    have, least = 0, None
    for row in sorted(orders.collect(), key=lambda r: -r["order"]):
        if have + row["n"] > most:
            break
        have, least = have + row["n"], 1 << row["order"]
    return least if least is not None else 1 << 62


def alignment_counts(aligned: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of the pairs; ``aligned`` is read three times."""
    spark = aligned.sparkSession
    counts = keep(pair_counts(aligned), "pairs")
    # one number for each id of A at most
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most")).toArrow()
    best_of = np.zeros(max(best["a"].to_pylist(), default=0) + 1, np.int64)
    best_of[best["a"].to_numpy()] = best["most"].to_numpy()
    least = _frequent(counts, most)
    sent = counts.filter(F.col("docs") >= least).toArrow().sort_by("pair")
    rare = counts.filter(F.col("docs") < least)
    shared = spark.sparkContext.broadcast((sent["pair"].to_numpy(), sent["docs"].to_numpy(), best_of))
    some_rare = bool(rare.limit(1).count())
    columns = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best_of = shared.value
        for batch in batches:
            held = column(batch, "pairs")
            key, times = held.flatten().to_numpy(), column(batch, "times").flatten().to_numpy().astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
            at = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
            known = pairs[at] == key if len(pairs) else np.zeros(len(key), bool)
            n = np.where(known, docs[at], 0) if len(pairs) else np.zeros(len(key), np.int64)
            total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[upto])
            missed = ~known
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(batch, c) for c in columns),
                    pa.array(total(np.where(known & (n == best_of[key >> 32]), times, 0))),
                    pa.array(total(n * times)),
                    _lists(np.concatenate([[0], np.cumsum(missed)])[upto], key[missed], pa.int64()),
                    _lists(np.concatenate([[0], np.cumsum(missed)])[upto], times[missed].astype(np.int32), pa.int32()),
                ],
                [*columns, "n_best", "count_sum", "pairs", "times"],
            )

    kinds = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in columns)
    found = aligned.mapInArrow(run, f"{kinds}, n_best long, count_sum long, pairs array<long>, times array<int>")
    if not some_rare:
        return found.drop("pairs", "times")

    # rare pairs meet their counts in a shuffle and come back as one row a document
    found = keep(found.withColumn("__cl_row", F.monotonically_increasing_id()), "found")
    loose = found.select("__cl_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("__cl_row", "p.pairs", "p.times")
    tops = spark.createDataFrame(best.rename_columns(["a", "most"])) if best.num_rows else spark.createDataFrame([], "a long, most long")
    rare = rare.join(F.broadcast(tops), F.shiftright("pair", 32) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    more = (
        loose.join(rare, F.col("pairs") == F.col("pair"))
        .groupBy(F.col("__cl_row").alias("__cl_of"))
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("docs") * F.col("times")).alias("more_sum"))
    )
    joined = found.join(more, F.col("__cl_row") == F.col("__cl_of"), "left")
    add = lambda name, extra: (F.col(name) + F.coalesce(F.col(extra), F.lit(0))).cast("long").alias(name)
    return joined.select(*columns, add("n_best", "more_best"), add("count_sum", "more_sum"))


def alignments(docs: DataFrame, a: str, b: bytes, most: int = BROADCAST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row."""
    found = alignment_counts(keep(align(docs, a, b), "aligned"), most)
    return found.select("doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256")
