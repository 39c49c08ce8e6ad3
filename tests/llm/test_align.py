import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpuslens.llm import align as op
from corpuslens.llm.tokens import read_model

A = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
B = read_model(public_tokenizers.path("piece_bpe_32k.model"))


class Brute:
    """Whole texts through the libraries, every pair of tokens compared."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_str(A), SentencePieceProcessor(model_proto=B)
        self.a.encode_special_tokens, self.signs = True, op.byte_of_sign()

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, self.bytes_a(i)) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, self.bytes_b(i)) for i in self.b.encode(text)]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def bytes_a(self, i):
        return bytes(self.signs[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    def spans(tokens):
        at, out = 0, []
        for i, held in tokens:
            out.append((i, at, at + len(held)))
            at += len(held)
        return out

    def one(self, text):
        a, b = map(self.spans, self.tokens(text))
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, _ in x if low <= s < cut) for x in (a, b)))
            low = cut
        return len(a), len(b), len(groups), links, sha256(";".join(groups).encode()).hexdigest() if groups else ""

    def all(self, rows):
        held = [(doc, *self.one(text)) for doc, text in rows]
        docs = Counter(pair for *_, links, _ in held for pair in set(links))
        most = {}
        for (i, _), n in docs.items():
            most[i] = max(n, most.get(i, 0))
        for doc, n_a, n_b, n_groups, links, digest in held:
            yield doc, n_a, n_b, n_groups, len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), digest


ROWS = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, " "), (5, "   two  spaces   and\ttabs\n\nlines  \r\n"),
    (6, "Fußgängerübergänge für Ärzte, naïve café œuvre"), (7, "日本語のテキスト と 한국어 😀😀👩‍👩‍👧"), (8, "<s> <|endoftext|> </s> <unk> <0x41> [INST]"),
    (9, "a literal ▁ sign ▁▁"), (10, "don't we'll I'M 12345 3.14 x=1;y=2"), (11, " nbsp   wide ​zero ᠎ mong \u0085 nel \x1c fs \x00 nul"),
    (12, "The quick brown fox jumps over the lazy dog."), (12, "again"), (None, "no id"), (13, "é combining ́ alone ﬁ ligature ＡＢ"), (14, "x" * 300 + " " + "y z " * 50),
]


def rows_of(found):
    return sorted(map(str, found))


@pytest.mark.parametrize("most", [op.BROADCAST_PAIRS, 40, 0])
def test_every_row_as_by_hand(docs, most):
    found = op.alignments(docs(ROWS), A, B, most)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(tuple(r) for r in found.collect()) == rows_of(Brute().all(ROWS))


def test_parts_are_the_text(docs):
    draw = random.Random(3)
    signs = ["a", "the", " ", "  ", "\n", "é", "漢", "'s", "1", ".", "\t", " ", "　", "Z", "▁", "​", "=", "😀"]
    rows = [(i, "".join(draw.choice(signs) for _ in range(draw.randint(0, 60)))) for i in range(300)]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.to_json(F.struct("pairs", "times"))]
    both = [op.align(docs(rows), A, B, cut=cut, remembered=n).select(*columns).collect() for cut, n in ((True, 1 << 20), (True, 0), (False, 1 << 20))]
    assert sorted(both[0]) == sorted(both[1]) == sorted(both[2])
    brute = Brute()
    expected = {i: brute.one(t) for i, t in rows}
    for r in both[0]:
        n_a, n_b, n_groups, links, digest = expected[r["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (n_a, n_b, n_groups, len(links), digest)


def test_coalesce_by_hand():
    # bytes 0-3 | 3-8: A 1+2, 4+1; B 3, 2+3
    a, b, left, right = op.coalesce(np.array([1, 2, 4, 1]), np.array([3, 2, 3]))
    assert a.tolist() == [0, 0, 1, 1] and b.tolist() == [0, 1, 1]
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (1, 0), (2, 1), (2, 2), (3, 2)]


def test_borders_are_proven():
    assert op.parts_at_spaces(A, B)
    assert not op.parts_at_spaces(A.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'), B)
    assert not op.parts_at_spaces(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read(), B)


def test_very_long_text_and_empty_table(docs):
    text = "Some words, and 7 numbers; again. " * 30_000
    brute = Brute()
    found = op.alignments(docs([(1, text), (2, "word")]), A, B).orderBy("doc_id").first()
    a, b = brute.tokens(text)
    assert (found["n_a"], found["n_b"]) == (len(a), len(b))
    assert op.alignments(docs([]), A, B).collect() == []


def test_forgotten_parts_are_aligned_again():
    draw, tokens = random.Random(5), op.Tokens(A, B)
    few, all_ = op.Parts(tokens, 3000, True), op.Parts(tokens, 1 << 30, True)
    for _ in range(60):
        parts = [f"w{int(draw.expovariate(0.02))}" for _ in range(40)] + draw.choices(["a ", " b", "x ▁", "▁", "naïve"], k=3)
        for held in (few, all_):
            at = held.places(parts)
            pairs = [held.pairs[i:j].tolist() for i, j in zip(held.upto[at], held.upto[at + 1])]
            got = [(held.said[i], held.numbers[i].tolist(), p) for i, p in zip(at.tolist(), pairs)]
            assert held is few or got == before
            before = got
    assert len(few.place) < len(all_.place)
