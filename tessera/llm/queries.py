"""The pN_ queries: each runs one operator, with its production parameters, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import codetext, conversations, forms, language, packing, pairs, subjects, tokens


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    documents = _t(spark, sf, "documents")
    model = language.train(documents)
    records = language.records(documents, _t(spark, sf, "translation_items"), _t(spark, sf, "language_settings"))
    found = language.segment(records, model, mislabelled=True)
    return found.dropDuplicates(["record_kind", "record_key", "seg"]).select("record_kind", "record_key", "seg", "lang")


def p1_runs(spark: SparkSession, sf: str) -> DataFrame:
    documents = _t(spark, sf, "documents")
    records = language.records(documents, _t(spark, sf, "translation_items"), _t(spark, sf, "language_settings"))
    return language.segment(records, language.train(documents)).dropDuplicates(["record_kind", "record_key", "seg"])


def p1_confidence(spark: SparkSession, sf: str) -> DataFrame:
    documents = _t(spark, sf, "documents")
    return language.confidence_error(documents, language.train(documents))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.assemble_backlog(spark, f"{sf}/translation_items.parquet")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.first_defect(pairs.defects(_t(spark, sf, "translation_items")))


def p3_defects(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defects(_t(spark, sf, "translation_items")).select("fact_id", F.posexplode("defects").alias("rank", "defect"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return forms.same_looking_pairs(_t(spark, sf, "translation_items"), ["original_lines", "translation_lines"])


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    return forms.same_looking_classes(_t(spark, sf, "translation_items"), ["original_lines", "translation_lines"])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return codetext.natural_spans(_t(spark, sf, "plugin_source_files")).select("file_id", "start_index", "lang")


def p5_shares(spark: SparkSession, sf: str) -> DataFrame:
    return codetext.shares(codetext.natural_spans(_t(spark, sf, "plugin_source_files")))


def p5_literals(spark: SparkSession, sf: str) -> DataFrame:
    return codetext.literal_languages(_t(spark, sf, "plugin_source_candidates"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    documents = _t(spark, sf, "documents")
    return tokens.encode(documents, tokens.build_lexicon(documents))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    documents = _t(spark, sf, "documents")
    return packing.sizes_table(tokens.token_counts(documents, tokens.build_lexicon(documents)))


def p7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.by_patterns(_sizes(spark, sf), _t(spark, sf, "token_budgets"))


def p7_harmonic(spark: SparkSession, sf: str) -> DataFrame:
    return packing.harmonic(_sizes(spark, sf), _t(spark, sf, "token_budgets"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    budgets = _t(spark, sf, "token_budgets")
    sizes = _sizes(spark, sf)
    close, classes = packing.by_patterns(sizes, budgets), packing.harmonic(sizes, budgets)
    return packing.fill(close, budgets).withColumn("method", F.lit("patterns")).unionByName(packing.fill(classes, budgets).withColumn("method", F.lit("harmonic")))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.subjects(_t(spark, sf, "documents"), _t(spark, sf, "subject_labels"), _t(spark, sf, "subject_areas"))


def queries() -> dict:
    """Every pN_ query of this module by name."""
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are tested against brute force."""
    return {}
