"""Queries of this package, as the driver's registry takes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


#: The rules of the url contract.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_digest

    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import cross_checked

    return cross_checked(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeats_digest

    return repeats_digest(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import link

    return link(table(spark, sf_dir, "documents"), n=2)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_store import store_digest

    return store_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_digest

    return find_digest(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings")).drop("centroid")


def op11_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .class_lm import score

    return score(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {"op1_url_filter": sql.url_filter(URL_RULES), "op3_near_dup": sql.NEAR_DUP, "op7_suffix_dedup": sql.REPEATS, "op9_decontaminate": sql.CONTAMINATION, "op12_divergence": sql.DIVERGENCE, "op13_centroids": sql.centroids()}
