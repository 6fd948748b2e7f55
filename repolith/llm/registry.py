"""The pN_ queries, each over the whole of its tables, and SQL counterparts where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import bpe, leakage, neardup, provenance, secrets, sentences, splitting, syntax
from repolith.session import broadcast_if_small, spread
from repolith.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _near_duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "knowledge_docs").select(F.lit("knowledge_doc").alias("kind"), F.col("doc_id").alias("key"), F.col("content").alias("text"))
    readmes = table(spark, sf_dir, "repos").select(F.lit("repo_readme").alias("kind"), F.col("full_name").alias("key"), F.col("readme").alias("text"))
    return docs.union(readmes).where("key is not null")


def _near_duplicates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.class_links(_near_duplicate_texts(spark, sf_dir), width=3, percent=70, min_words=20)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one kind that share at least 70 % of their runs of three words."""
    return neardup.linked_keys(*_near_duplicates(spark, sf_dir)).withColumnRenamed("kind", "item_kind")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with its class of equal shingle sets and the number of records it is similar to."""
    return neardup.linked_members(*_near_duplicates(spark, sf_dir)).toDF("item_kind", "item_key", "class_id", "links")


def _code_and_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "key_files").select(F.lit("key_file").alias("item_kind"), F.concat_ws("::", "repo_id", "path").alias("item_key"), "content")
    docs = table(spark, sf_dir, "knowledge_docs").select(F.lit("knowledge_doc").alias("item_kind"), F.col("doc_id").alias("item_key"), "content")
    return files.union(docs)


#: Repeated keys up to which they are broadcast.
MAX_REPEATED = 2_000_000


def _once(rows: DataFrame, *keys: str) -> DataFrame:
    """rows without repeated ones. Only the rows of keys that come more than once, found on the keys alone, are compared and shuffled as a whole."""
    key = F.xxhash64(*keys)
    repeated = broadcast_if_small(rows.select(key.alias("__key")).groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key"), MAX_REPEATED)
    keyed = rows.withColumn("__key", key)
    single = keyed.join(repeated, "__key", "left_anti").drop("__key")
    return single.union(keyed.join(repeated, "__key", "left_semi").drop("__key").dropDuplicates())


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every key file and knowledge document."""
    return splitting.split(_once(_code_and_documents(spark, sf_dir), "item_kind", "item_key"), ["item_kind", "item_key"], "content")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that come out in more than one piece."""
    made = splitting.split(_code_and_documents(spark, sf_dir), ["item_kind", "item_key"], "content")
    return made.where("piece_no = 2 and length(piece) > overlap").select("item_kind", "item_key").distinct()


P2_SQL = """
SELECT DISTINCT item_kind, item_key FROM (
  SELECT 'key_file' AS item_kind, repo_id || '::' || path AS item_key, content FROM key_files
  UNION ALL SELECT 'knowledge_doc', doc_id, content FROM knowledge_docs) WHERE length(content) > 1800
"""


def _searched_for_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing, text = F.lit(None).cast("int"), "text"
    key = lambda path: F.concat_ws("::", "repo_id", path).alias("key")
    extension = F.regexp_extract(F.lower("path"), r"\.(\w+)$", 1).alias("extension")
    files = table(spark, sf_dir, "key_files").select(F.lit("key_file").alias("kind"), key("path"), nothing.alias("part"), extension, F.col("content").alias(text))
    docs = table(spark, sf_dir, "knowledge_docs").select(F.lit("knowledge_doc").alias("kind"), F.col("doc_id").alias("key"), nothing.alias("part"), F.lit("").alias("extension"), F.col("content").alias(text))
    entries = table(spark, sf_dir, "config_summaries").select(F.lit("config").alias("kind"), key("source_path"), F.posexplode("env_vars").alias("part", text))
    return spread(files.union(docs).union(entries.select("kind", "key", F.col("part") + 1, F.lit("").alias("extension"), text)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines and entries on which a usable secret value starts."""
    return secrets.secret_lines(_searched_for_secrets(spark, sf_dir)).toDF("item_kind", "item_key", "line_no")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text and entry with its secret values overwritten."""
    return secrets.redacted(_once(_searched_for_secrets(spark, sf_dir), "kind", "key", "part")).toDF("item_kind", "item_key", "entry_no", "secrets", "text")


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key file of a checked language, with the furthest failure and its cause where it isn't valid."""
    return syntax.failures(table(spark, sf_dir, "key_files")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key files with a syntax error in the language that their path names."""
    return syntax.failures(table(spark, sf_dir, "key_files")).where("position is not null").select("repo_id", "path").distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of invalid files per repository and language, per each alone and over all."""
    return syntax.rates(syntax.failures(table(spark, sf_dir, "key_files")))


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source file with its notice, the forest's probability and the verdict."""
    sources = provenance.source_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "key_files"))
    return provenance.scored(sources, provenance.fit(sources))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that are generated, minified, vendored or data."""
    return p5_files(spark, sf_dir).where("found").select("repo_id", "path")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


#: Words in a row that give a held-out answer away.
LEAKED_WORDS = 25


def p7_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a case with a seed in common, with its exact run and its tolerant overlap."""
    return leakage.overlaps(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_cases"), "case_id", "reference_answer").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_overlaps(spark, sf_dir).where(F.col("run_words") >= LEAKED_WORDS).select("doc_id", "case_id").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of every sentence unit of every document."""
    return sentences.sentence_ends(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").distinct()


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_classes": p1_classes, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_files": p4_files, "p4_rates": p4_rates, "p5_files": p5_files, "p5_found": p5_found, "p6_ids": p6_ids, "p7_overlaps": p7_overlaps, "p7_found": p7_found, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL}
