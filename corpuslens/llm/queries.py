"""The registered queries of this package, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.llm.shared import documents
from corpuslens.llm.sql import OP1, OP8, OP9, OP11

#: Where the vocabulary lies on this machine; a parameter, as the operators take the model itself.
PIECES = "piece_bpe_32k.model"
BYTE_LEVEL = "byte_bpe_50k.json"


def _model() -> bytes:
    import public_tokenizers

    from corpuslens.llm.tokens import read_model

    return read_model(public_tokenizers.path(PIECES))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.jaccard import jaccard_components

    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_copies")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.tokens import count_tokens

    return count_tokens(documents(spark, sf_dir), _model())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.quality import judge

    found = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.licenses import scan

    return scan(documents(spark, sf_dir))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.pieces import encode

    found = encode(documents(spark, sf_dir), _model(), ["doc_id", "text"], decoded=True)
    return found.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids",
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("lossless"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.suffixes import dedup_suffixes

    return dedup_suffixes(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.substrings import dedup_substrings

    return dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.spotsigs import fingerprints

    return fingerprints(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.merkle import manifest

    # what tampering changes: one more character where 7 divides the checksum of the key
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    return manifest(documents(spark, sf_dir), changed={"n_chars": F.when(hit, n_chars + 1).otherwise(n_chars).cast("decimal(20,0)")})


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.llm.pages import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpuslens.llm.align import alignments

    with open(public_tokenizers.path(BYTE_LEVEL), encoding="utf-8") as file:
        byte_level = file.read()
    return alignments(documents(spark, sf_dir), byte_level, _model())


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_pieces": op6_pieces,
    "op7_source_mixing": op7_source_mixing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_spotsigs": op10_spotsigs,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_html_extraction": op12_html_extraction,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE = {
    "op1_jaccard_join": OP1,
    "op8_suffix_dedup": OP8,
    "op9_substring_dedup": OP9,
    "op11_merkle_manifest": OP11,
}
