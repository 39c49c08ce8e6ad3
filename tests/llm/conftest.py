import pytest


@pytest.fixture
def docs(spark):
    """``docs([(doc_id, text), ...])`` gives a documents table, with an extra column of a clashing name."""

    def make(rows, columns="doc_id long, text string", **more):
        table = spark.createDataFrame([(*r, "x", None) for r in rows], columns + ", starts string, n_words long")
        return table.repartition(3)

    return make


def filler(seed: int, n: int) -> list[str]:
    """n words that repeat in no other seed."""
    return [f"w{seed}x{i}" for i in range(n)]
