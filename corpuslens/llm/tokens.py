"""Token counts of a SentencePiece BPE vocabulary by the whole-token shortcut (operator 2).

Offline, on the driver, the library itself proves which vocabulary strings it encodes alone as one
token. No piece of such a vocabulary holds a space mark behind another character, so no merge crosses
from a word to the spaces before the next one: a text is the sum of its pre-tokens, each a run of
spaces and what follows. Tasks count pre-tokens that are proven strings directly; only the rest are
merged, by the library, and remembered per task up to ``REMEMBERED`` strings (a bound on memory; a
forgotten string is merged again).

Cases: NULL counts as empty; empty text has 0 tokens; special strings are ordinary text; repeated rows
are counted alike; columns of other names are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.batches import column, slices
from corpuslens.llm.shared import text_of

MAX_TOKENS = 4096
REMEMBERED = 1_000_000
MARK = "▁"

_RUNS = re.compile(r" +[^ ]+| +")


def read_model(path: str) -> bytes:
    """The model file, read once on the driver: executors need no copy of it."""
    with open(path, "rb") as file:
        return file.read()


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def whole_tokens(model: bytes) -> frozenset[str]:
    """The pre-tokens, without their first space, that the library encodes as exactly one token.

    Fails if the vocabulary does not let pre-tokens stand alone.
    """
    library = load(model)
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("pieces of this vocabulary cross words")
    if "".join(library.encode("  a  b ", out_type=str)) != f"{MARK}{MARK}{MARK}a{MARK}{MARK}b{MARK}":
        raise ValueError("this vocabulary changes white space")
    texts = [p[1:].replace(MARK, " ") for p in pieces if p.startswith(MARK)]
    return frozenset(t for t, ids in zip(texts, library.encode(texts)) if len(ids) == 1)


class _Counts(dict):
    """Tokens by pre-token without its first space."""

    def __init__(self, model: bytes, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.library = whole, load(model)

    def __missing__(self, word: str) -> int:
        n = self.merged(word)
        if len(word) <= 64:
            if len(self) > REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[word] = n
        return n

    def merged(self, word: str) -> int:
        # alone, an empty string has no dummy space; here it stands for one
        return len(self.library.encode(word)) if word else 1

    def of(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        words = text.split(" ")
        if "" in words:
            words = [run[1:] for run in _RUNS.findall(" " + text)]
        return sum(map(self.__getitem__, words))


def count_tokens(docs: DataFrame, model: bytes, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; one narrow stage, no shuffle."""
    whole = whole_tokens(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(model, whole)
        for part in slices(batches):
            n = [counts.of(text) for text in column(part, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), column(part, "n_bytes"), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    texts = docs.select("doc_id", text_of().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = texts.select("doc_id", "text", "n_bytes").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)
