import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from corpuslens.llm.pieces import Encoder, Vocabulary, agenda, decode, decode_ids, encode
from corpuslens.llm.tokens import read_model
from tests.llm.test_tokens import TEXTS

MODEL = read_model(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(MODEL)


def more_texts():
    rng = random.Random(1)
    letters = "aeionrstlhd é▁日\n.#"
    return [*TEXTS, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(50)), "the" * 90 + " x", "ab" * 600]


def test_without_dropout_it_is_the_library(vocabulary):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    texts = [t for t in more_texts() if "▁" not in t]
    ids, at = Encoder(vocabulary, dropout=0.0).encode(pa.array(texts), np.zeros(len(texts), int))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t), t


def test_lossless_seeded_and_varied(vocabulary):
    texts = more_texts()
    cut = {}
    for seed in (1, 2):
        for variant in (0, 1):
            ids, at = Encoder(vocabulary, seed, 0.3).encode(pa.array(texts), np.full(len(texts), variant))
            assert decode_ids(vocabulary, ids, at).to_pylist() == texts
            cut[seed, variant] = ids.tolist()
            again, _ = Encoder(vocabulary, seed, 0.3).encode(pa.array(texts[::-1]), np.full(len(texts), variant))
            assert sorted(again.tolist()) == sorted(ids.tolist())
    assert len({tuple(c) for c in cut.values()}) == 4
    plain, _ = Encoder(vocabulary, 1, 0.0).encode(pa.array(texts), np.zeros(len(texts), int))
    assert len(cut[1, 0]) > len(plain)


def test_side_by_side_is_the_agenda(vocabulary, monkeypatch):
    texts = more_texts()
    for dropout in (0.0, 0.2, 0.6, 1.0):
        ids, at = Encoder(vocabulary, 5, dropout).encode(pa.array(texts), np.arange(len(texts)) % 3)
        monkeypatch.setattr("corpuslens.llm.pieces.LONG", 0)
        heap, at_heap = Encoder(vocabulary, 5, dropout).encode(pa.array(texts), np.arange(len(texts)) % 3)
        monkeypatch.undo()
        assert (ids == heap).all() and (at == at_heap).all()
    assert agenda(vocabulary, vocabulary.chars[[ord(c) for c in "▁the"]].tolist(), 0, 0.0) == [vocabulary_id("▁the")]


def vocabulary_id(piece):
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL).piece_to_id(piece)


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    texts = more_texts()
    whole, _ = Encoder(vocabulary).encode(pa.array(texts), np.zeros(len(texts), int))
    monkeypatch.setattr("corpuslens.llm.pieces.REMEMBERED", 0)
    encoder = Encoder(vocabulary)
    parts = [encoder.encode(pa.array([t]), np.zeros(1, int))[0] for t in texts]
    assert np.concatenate(parts).tolist() == whole.tolist()


def test_tables(docs, spark):
    rows = [*enumerate(more_texts()), (900, None), (None, "the of"), (901, ""), (3, "the of and"), (3, "the of and")]
    found = decode(encode(docs(rows), MODEL, ["doc_id", "text", "starts"]), MODEL).collect()
    at_once = encode(docs(rows), MODEL, ["doc_id", "text", "starts"], decoded=True).collect()
    assert sorted(map(repr, at_once)) == sorted(map(repr, found))
    assert len(found) == len(rows) and all((r.text or "") == r.decoded for r in found)
    assert {tuple(r.piece_ids) for r in found if not r.text} == {()}
    assert decode(encode(spark.createDataFrame([], "doc_id long, text string"), MODEL, ["doc_id"]), MODEL).collect() == []


def test_occurrences_of_a_word_differ(vocabulary):
    text = " ".join(["international"] * 200)
    ids, at = Encoder(vocabulary, 3, 0.3).encode(pa.array([text, text]), np.array([1, 2]))
    assert decode_ids(vocabulary, ids, at).to_pylist() == [text, text]
    assert ids[at[0] : at[1]].tolist() != ids[at[1] : at[2]].tolist()
    words, word = [], []
    for i in ids[at[0] : at[1]].tolist():
        if word and vocabulary.data[vocabulary.starts[i]] == 32:
            words, word = [*words, tuple(word)], []
        word.append(i)
    assert len({*words, tuple(word)}) > 3


SCRIPT = """
import sys
sys.path[:0] = [{repo!r}]
from workload.check import session
spark = session("2")
import __spark_entry__ as entry
import os
os.chdir({elsewhere!r})
rows = entry.queries()["op6_pieces"](spark, {sf!r}).filter("lossless").count()
print("rows", rows, spark.sparkContext.parallelize([0], 1).map(lambda _: __import__("importlib.util").util.find_spec("corpuslens") is None).first())
"""


def test_executors_need_no_package(tmp_path):
    """In a session whose workers have neither the repository's folder nor its path."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the given tables")
    script = tmp_path / "job.py"
    script.write_text(SCRIPT.format(repo=repo, elsewhere=str(tmp_path), sf=sf))
    kept = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    run = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=kept, capture_output=True, text=True, timeout=300)
    assert "rows 200 True" in run.stdout, run.stderr[-2000:]
