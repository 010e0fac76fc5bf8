"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import handwritten, mixing, oracles, packing, pii, syntax, truncation
from codeloom.llm.tokens import token_counter
from codeloom.session import materialize, spread, table

FILL = 0.9  # what is asked of packing
P1_FIELDS, P1_SOURCES = ["intro", "closing_summary"], ["config_id", "origin"]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of enrichments whose end was lost."""
    return truncation.find_truncated(table(spark, sf, "enrichments"), "enrichment_id", P1_FIELDS, P1_SOURCES).select("enrichment_id", "field_name").distinct()


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of lost ends per model configuration and per origin."""
    e = table(spark, sf, "enrichments")
    lost = truncation.materialize(truncation.find_truncated(e, "enrichment_id", P1_FIELDS, P1_SOURCES))
    return truncation.truncation_rates(e, lost, P1_FIELDS, "config_id").unionByName(truncation.truncation_rates(e, lost, P1_FIELDS, "origin"))


def p1_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths at which fields are cut, beside the token limit of the model configuration."""
    limits = table(spark, sf, "llm_configs").select(F.col("config_id").cast("string").alias("source"), "max_tokens")
    return truncation.field_limits(table(spark, sf, "enrichments"), "enrichment_id", P1_FIELDS, P1_SOURCES, limits)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that nobody wrote by hand."""
    return handwritten.classify_files(table(spark, sf, "source_files")).where("reason is not null").select("file_id")


def p4_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Files per repository and reason; hand-written ones have the reason 'hand'."""
    c = handwritten.classify_files(table(spark, sf, "source_files"))
    return c.groupBy("repo", F.coalesce("reason", F.lit("hand")).alias("reason")).agg(F.count(F.lit(1)).alias("n_files"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that their language rejects."""
    return syntax.parse_errors(table(spark, sf, "source_files")).select("file_id")


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of files with syntax errors per repository and language."""
    f = table(spark, sf, "source_files")
    return syntax.error_rates(f, syntax.parse_errors(f))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return packing.pack_documents(packing.size_documents(docs, token_counter()), table(spark, sf, "pack_sizes"))


def p6_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Window of every text in every kind of container."""
    return _packed(spark, sf)


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Windows and unused space per kind of container."""
    return packing.packing_report(_packed(spark, sf))


def p6_faults(spark: SparkSession, sf: str) -> DataFrame:
    """What must not happen in packing, counted, and whether at least nine tenths of the space are used."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    sized = packing.size_documents(docs, token_counter())
    packed = materialize(packing.pack_documents(sized, table(spark, sf, "pack_sizes")))
    fill = packing.packing_report(packed).select("container", (F.col("fill") > FILL).alias("filled"))
    return packing.packing_faults(packed, sized).join(fill, "container")


def _sized_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return materialize(docs.select("doc_id", "source", token_counter()(F.col("text")).alias("n_tokens")))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Texts drawn, with their copies, so that sources have their target shares."""
    return mixing.mix(_sized_sources(spark, sf), table(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of every source."""
    sized, targets = _sized_sources(spark, sf), table(spark, sf, "mix_targets")
    return mixing.mix_report(sized, targets, materialize(mixing.mix(sized, targets)))


def p7_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Per source of the targets: texts to draw from, texts drawn too often, and whether its tokens are those of its share
    but for one text.

    A source without texts has none of its share, and the others keep their proportions.
    """
    sized, targets = _sized_sources(spark, sf), table(spark, sf, "mix_targets")
    drawn = materialize(mixing.mix(sized, targets))
    often = drawn.join(F.broadcast(targets.select("source", "max_repeats")), "source").groupBy("source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("n_often"))
    r = mixing.mix_report(sized, targets, drawn)
    possible = r.agg(F.sum(F.when(F.col("n_docs") > 0, F.col("target_share"))).alias("possible"))
    longest = sized.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    r = r.join(F.broadcast(possible), F.lit(True)).join(F.broadcast(drawn.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("total"))), F.lit(True)).join(longest, "source", "left").join(often, "source", "left")
    off = F.abs(F.col("drawn_tokens") - F.when(F.col("n_docs") > 0, F.col("target_share") / F.col("possible") * F.col("total")).otherwise(0.0))
    return r.select("source", F.col("n_docs").cast("long").alias("n_docs"), F.coalesce("n_often", F.lit(0)).alias("n_often"), (off <= F.coalesce("longest", F.lit(0))).alias("reached"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in documents: kind and place of each item."""
    return pii.find_personal(table(spark, sf, "documents")).select("doc_id", "kind", "start_pos")


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with typed placeholders instead of personal data."""
    return pii.redact_personal(table(spark, sf, "documents"))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p1_limits": p1_limits, "p4_found": p4_found, "p4_reasons": p4_reasons, "p5_found": p5_found, "p5_rates": p5_rates, "p6_packing": p6_packing, "p6_report": p6_report, "p6_faults": p6_faults, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_faults": p7_faults, "p8_found": p8_found, "p8_redacted": p8_redacted}
ORACLE: dict[str, str] = oracles.ORACLE
