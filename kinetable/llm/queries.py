"""The corpus queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm import codes, decontaminate, exactdup, extract, fim, language, licenses, mixing, neardup, pii, secrets, vectors, warc
from kinetable.llm.common import table


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digest(found: DataFrame, base: list[str]) -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans, and all spans, in the order they come."""

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    own, counts = of(*base), [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.summary(warc.read(warc.write(pages), payloads=False), pages.schema["page_id"].dataType.simpleString())


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(pii.find_personal_data(table(spark, sf_dir, "documents")), list(pii.KINDS))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(secrets.find_secrets(table(spark, sf_dir, "documents")), [r.kind for r in secrets.BASE_RULES])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.duplicates(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.summary(fim.transform(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_source_mixing": op3_source_mixing,
    "op4_warc": op4_warc,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_personal_data": op6_personal_data,
    "op7_secret_scan": op7_secret_scan,
    "op8_language_id": op8_language_id,
    "op9_main_text": op9_main_text,
    "op10_near_dedup": op10_near_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": licenses.sql(),
    "op3_source_mixing": mixing.SQL,
    "op5_vector_dedup": vectors.SQL,
    "op10_near_dedup": neardup.SQL,
    "op11_exact_dedup": exactdup.SQL,
    "op12_vector_codes": codes.SQL,
    "op13_fill_in_middle": fim.SQL,
}
