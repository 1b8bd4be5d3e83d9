"""One registered query for each numbered operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import decontam, divergence, fim, html_extract, langid, media, ngram_join, packing, quality, secrets, sentencepieces, substring, url_filter
from basketry.llm.common import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_groups(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def held_out(id_col: str = "doc_id"):
    """The fold that no model learns from; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langid.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    return langid.identify(docs, filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    known = quality.labelled_rows(docs.where(learned), table(spark, sf_dir, "labels"))
    scored = quality.score(docs, *quality.train(docs, known))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_files() -> dict:
    """Where the public vocabulary lies; its path is a parameter of the operators."""
    import public_tokenizers

    return {
        "tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer_files())


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL["op11_fill_in_middle"] = fim.DIGEST_SQL


def piece_model() -> str:
    """Where the public merge-type model lies; its path is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = sentencepieces.decode(sentencepieces.encode(table(spark, sf_dir, "documents"), piece_model()), piece_model())
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_source_divergence"] = divergence.AUDIT_SQL
