"""Queries of the problems on text and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, chunking, language, mixing
from palimpsest.llm.documents import unique_documents
from palimpsest.llm.syntax import check
from palimpsest.sources.tables import table


#: The wanted total of the tempered mixtures: half the tokens of the target sources, more than the targets allow.
PASSES = 0.5
#: The wanted entropy of the even mixtures: halfway from that of the natural shares to that of equal ones.
EVENNESS = 0.5


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_documents(table(spark, sf_dir, "documents"))


def p1_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.diagnostics(table(spark, sf_dir, "file_versions"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_diagnostics(spark, sf_dir).select("file_id", "valid_from_sequence").distinct()


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.rates(table(spark, sf_dir, "file_versions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_chunks(spark, sf_dir).where("oversized and piece = 0").select("doc_id")


def p2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "chunk_profiles"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_tempered_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"), passes=PASSES)


def p9_tempered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"), passes=PASSES)


def p9_even_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"), evenness=EVENNESS)


def p9_even_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"), evenness=EVENNESS)


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.assign(_documents(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(p10_languages(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_diagnostics": p1_diagnostics,
    "p1_rates": p1_rates,
    "p2_found": p2_found,
    "p2_chunks": p2_chunks,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_tempered_mix": p9_tempered_mix,
    "p9_tempered_shares": p9_tempered_shares,
    "p9_even_mix": p9_even_mix,
    "p9_even_shares": p9_even_shares,
    "p10_found": p10_found,
    "p10_languages": p10_languages,
}

SQL = {
    "p2_found": """
select doc_id from documents join chunk_profiles using (profile)
where text is not null and strlen(text) + coalesce(list_sum(list_transform(context, lambda x: coalesce(strlen(x), 0))), 0) > max_bytes""",
}
