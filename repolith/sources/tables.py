"""Parquet tables, read with column pruning left to Catalyst, and their deduplicated forms.

Tables hold repeated rows and rows written again later. The latest row of a key wins; rows with a null key are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the given order. Spark cuts each partition down to its first rows before the shuffle."""
    ranked = df.where(" and ".join(f"`{k}` is not null" for k in keys)).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def narrow(rows: DataFrame, kept: list[str], derived: dict[str, Column]) -> DataFrame:
    """The kept and the derived columns if there are derived ones, else all. They are computed before repeated rows are found, so that contents aren't shuffled."""
    return rows.select(*kept, *(c.alias(name) for name, c in derived.items())) if derived else rows


def documents(spark: SparkSession, sf_dir: str, **derived: Column) -> DataFrame:
    """Knowledge documents, the latest indexed row of each doc_id; narrow with derived columns."""
    rows = narrow(table(spark, sf_dir, "knowledge_docs"), ["doc_id", "repo_id", "indexed_at", "title", "source_path"], derived)
    return latest(rows, ["doc_id"], F.col("indexed_at").desc_nulls_last(), F.col("title"), F.col("source_path"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned files, the latest scan of each path of a repository."""
    return latest(table(spark, sf_dir, "files"), ["repo_id", "path"], F.col("scanned_at").desc_nulls_last(), F.col("size_bytes"), F.col("extension"), F.col("is_key_file"))


def key_files(spark: SparkSession, sf_dir: str, **derived: Column) -> DataFrame:
    """Stored key files, one row for each path of a repository; narrow with derived columns. Repeated rows have the same content, which is no part of the order, so that queries over paths don't read it."""
    rows = narrow(table(spark, sf_dir, "key_files"), ["repo_id", "path", "size_bytes", "truncated"], derived)
    return latest(rows, ["repo_id", "path"], F.col("size_bytes").desc_nulls_last(), F.col("truncated"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories, the latest fetch of each."""
    return latest(table(spark, sf_dir, "repos"), ["full_name"], F.col("fetched_at").desc_nulls_last(), F.col("stargazers_count").desc_nulls_last(), F.col("html_url"))


def config_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "config_summaries"), ["repo_id", "source_path"], F.col("summary"), F.col("config_kind"), F.col("language_scope"))


# Keys whose rows lie in a second table under the same name, for SQL that reads the same forms.
SQL_FORMS = {
    "documents_once": ("knowledge_docs", "doc_id", "indexed_at DESC NULLS LAST, title NULLS FIRST, source_path NULLS FIRST"),
    "files_once": ("files", "repo_id, path", "scanned_at DESC NULLS LAST, size_bytes NULLS FIRST, extension NULLS FIRST, is_key_file NULLS FIRST"),
    "key_files_once": ("key_files", "repo_id, path", "size_bytes DESC NULLS LAST, truncated NULLS FIRST"),
    "repos_once": ("repos", "full_name", "fetched_at DESC NULLS LAST, stargazers_count DESC NULLS LAST, html_url NULLS FIRST"),
    "configs_once": ("config_summaries", "repo_id, source_path", "summary NULLS FIRST, config_kind NULLS FIRST, language_scope NULLS FIRST"),
}


def sql_with(*names: str) -> str:
    """WITH clauses of the deduplicated forms, ready to be followed by a comma or a SELECT."""
    parts = []
    for name in names:
        source, keys, order = SQL_FORMS[name]
        present = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
        parts.append(f"{name} AS (SELECT * FROM {source} WHERE {present} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1)")
    return "WITH " + ",\n".join(parts)
