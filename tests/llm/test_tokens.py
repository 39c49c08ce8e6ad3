import public_tokenizers
import pytest
import sentencepiece

from corpuslens.llm.tokens import _Counts, count_tokens, read_model, whole_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b    c  ", "the of and", "Thethethe nd\n\nof\tit", "日本語 текст é ß", "▁", "a▁b ▁",
    "<s> </s> <unk> <0x0A>", "x" * 3000, " " * 40 + "y", "\x00\x01 z", "😀😀 😀", "a b c", "word " * 5000, "idiot### loser***", "\n", " \n ",
]


def test_same_as_the_library(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = list(enumerate([*TEXTS, None, None, *TEXTS]))
    found = {r.doc_id: r for r in count_tokens(docs(rows), read_model(PATH)).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        n = len(library.encode(text or ""))
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (n, len((text or "").encode()), n > 4096), text


def test_proven_strings_are_one_token():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    whole = whole_tokens(read_model(PATH))
    assert len(whole) > 10_000 and all(len(library.encode(w)) == 1 for w in list(whole)[:2000] if w)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("corpuslens.llm.tokens.REMEMBERED", 1)
    counts = _Counts(read_model(PATH), frozenset())
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in TEXTS:
        assert counts.of(text) == len(library.encode(text))


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), read_model(PATH)).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(Exception):
        whole_tokens(b"no model")
