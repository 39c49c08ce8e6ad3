"""Text to vectors, and distances between them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions.text import WORD

DIMENSIONS = 256

# An embedder is a factory run once per task; what it makes takes texts and gives one vector each.
Embedder = Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]


def hashed_embedding(df: DataFrame, text: str, out: str = "embedding", dim: int = DIMENSIONS) -> DataFrame:
    """Words counted in ``dim`` hash buckets, scaled to unit length. Stays in the JVM."""
    from pyspark.ml.feature import CountVectorizerModel, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{WORD}+"), 0)
    bucket = lambda w: F.pmod(F.conv(F.left(F.md5(w), F.lit(6)), 16, 10).cast("int"), F.lit(dim)).cast("string")
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], "_buckets", "_counts")
    counted = counter.transform(df.withColumn("_buckets", F.transform(words, bucket)))
    return (
        Normalizer(inputCol="_counts", outputCol="_unit")
        .transform(counted)
        .withColumn(out, vector_to_array("_unit", "float32"))
        .drop("_buckets", "_counts", "_unit")
    )


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, out: str = "embedding", dim: int = DIMENSIONS) -> DataFrame:
    """Vectors for a text column: by ``embedder`` in Arrow batches, or the hashed default."""
    if embedder is None:
        return hashed_embedding(df, text, out, dim)

    def run(batches):
        model = embedder()
        for texts in batches:
            import pandas as pd

            yield pd.Series([list(map(float, v)) for v in model(list(texts.fillna("")))])

    from collections.abc import Iterator

    import pandas as pd

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance as an expression, for a few rows; searches use operators/search.py."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap)


def relevance(distance: Column) -> Column:
    """1 for the same unit vector, 0 for a right angle, -1 for the opposite."""
    return 1.0 - distance / 2.0
