"""The named queries of the package, with production settings, over whole tables."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.llm import ann, bpe_codec, byte_bpe, exact_dedup, line_dedup, merkle, mixing, oracles, simhash, suffix_dedup, surrogates, token_counts, toxicity, whitening

#: The folder that holds the library.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies, also if the driver's path was set after its start."""
    paths = spark.sparkContext.environment
    known = [path for path in paths.get("PYTHONPATH", "").split(os.pathsep) if path]
    if ROOT not in known:
        paths["PYTHONPATH"] = os.pathsep.join([*known, ROOT])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), path, limit=512)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels"))
    return toxicity.with_scores(documents, model).select(
        "doc_id",
        (~toxicity.learnable(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of the run would come from a secret store; the query has a fixed one, so that reruns agree."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(documents, b"query key")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_codec.code_digests(_table(spark, sf_dir, "documents"), path)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_repeated_lines(documents)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every hundredth id, against all rows."""
    embeddings = _table(spark, sf_dir, "embeddings")
    return ann.nearest(embeddings, embeddings.where("vec_id % 100 = 0"), k=10)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where the exact value has no place in a long (from some ten million vectors on)."""
    whitened = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return whitened.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has a checksum that 5 divides are tampered with; a null id is not."""
    fifth = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered=fifth)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.code_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES = {
    fn.__name__: fn
    for fn in (op1_token_counts, op2_toxicity, op3_simhash, op4_surrogates, op5_bpe_codec, op6_exact_dedup, op7_mixing, op8_line_dedup, op9_suffix_dedup, op10_nearest, op11_whitening, op12_manifest, op13_byte_bpe)
}
ORACLES: dict[str, str] = {
    "op6_exact_dedup": oracles.OP6,
    "op7_mixing": oracles.OP7,
    "op8_line_dedup": oracles.OP8,
    "op12_manifest": oracles.OP12,
}
