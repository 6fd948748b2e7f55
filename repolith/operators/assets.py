"""Which artefacts of a repository exist, and what that means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["clone", "report", "knowledge", "vector"]


def presence(**kinds: DataFrame) -> DataFrame:
    """(repo_id, has_<kind> ...): the full outer union of several tables' repositories."""
    rows = [df.select("repo_id", F.lit(kind).alias("kind")).where("repo_id is not null").distinct() for kind, df in kinds.items()]
    flags = [F.coalesce(F.bool_or(F.col("kind") == kind), F.lit(False)).alias(f"has_{kind}") for kind in kinds]
    return reduce(DataFrame.union, rows).groupBy("repo_id").agg(*flags)


def status(clone: Column, report: Column, knowledge: Column, vector: Column) -> Column:
    """The state that the flags add up to, by the first rule that holds."""
    return (
        F.when(clone & (report | knowledge | vector), "完整")
        .when(clone, "仅 Clone")
        .when(vector & (report | knowledge), "孤儿索引+资产")
        .when(vector, "仅索引残留")
        .when(knowledge & report, "孤儿知识+报告")
        .when(knowledge, "仅知识残留")
        .when(report, "仅报告残留")
        .otherwise("空")
    )


def orphans(flags: DataFrame) -> DataFrame:
    return flags.where("not has_clone and (has_report or has_knowledge or has_vector)")


def report_name_to_repo(name: Column) -> Column:
    """owner/name of a report's file name owner__name.<kind>; null where there is no owner."""
    bare = F.regexp_replace(name, r"\.(?:llm\.txt|pdf|json|md)$", "")
    return F.when(F.instr(bare, "__") > 1, F.regexp_replace(bare, r"^(.*?)__", "$1/"))
