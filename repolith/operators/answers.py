"""Evidence for answers: which hits come first, which of their lines speak to the question, and whether claims are supported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import text as T


def prioritized(hits: DataFrame, priorities: dict[str, int], default: int = 9) -> DataFrame:
    """hits in reading order: by the priority of their type, then score, then id."""
    rank = F
    for kind, value in priorities.items():
        rank = rank.when(F.col("doc_type") == kind, value)
    order = Window.partitionBy("query_id").orderBy(rank.otherwise(default) if priorities else F.lit(default), F.desc("score"), "doc_id")
    return hits.withColumn("position", F.row_number().over(order))


# How directly the lines of a document type answer, 0 for others.
LINE_BONUS = {
    "function_body_chunk": 4,
    "route_handler_chunk": 4,
    "class_body_chunk": 3,
    "config_chunk": 3,
    "function_summary": 3,
    "api_route_summary": 3,
    "class_summary": 2,
    "entrypoint_summary": 2,
    "config_summary": 2,
    "readme_summary": 1,
    "repo_summary": 1,
    "subproject_summary": 1,
}
LONG_LINE = 180
CODE_MARKS = ["def ", "class ", "return ", "@", "function ", "async "]


def line_bonus(doc_type: Column) -> Column:
    chain = F
    for kind, value in LINE_BONUS.items():
        chain = chain.when(doc_type == kind, value)
    return chain.otherwise(0)


def precise_bonus(line: Column, tokens: Column) -> Column:
    """Two for each token of at least three characters that names a path, symbol or route and stands in the line."""
    low = F.lower(line)
    return F.size(F.filter(tokens, lambda t: (F.length(t) >= 3) & t.rlike("[/._]") & F.contains(low, t))) * 2


def line_score(line: Column, tokens: Column, doc_type: Column) -> Column:
    """What a line says about a question: its document's type, the question's tokens in it, more for precise ones, one less for a long line."""
    low = F.lower(line)
    return line_bonus(doc_type) + F.size(F.filter(tokens, lambda t: F.contains(low, t))) + precise_bonus(line, tokens) - F.when(F.length(line) > LONG_LINE, 1).otherwise(0)


def selected_lines(hits: DataFrame, top_hits: int = 4, top_lines: int = 4) -> DataFrame:
    """(query_id, rank, line, score): the best lines of the first hits by line_score; lines without points are left out, equal ones count once, the first stays.

    hits: query_id, query, position, doc_type, content.
    """
    chosen = hits.where(F.col("position") <= top_hits)
    tokens = T.tokenize(F.col("query"))
    rows = chosen.select("query_id", "position", "doc_type", tokens.alias("tokens"), F.posexplode(T.lines(F.col("content"))).alias("k", "raw"))
    stripped = rows.withColumn("line", T.strip(F.col("raw"))).where("line <> ''")
    scored = stripped.withColumn("score", line_score(F.col("line"), F.col("tokens"), F.col("doc_type"))).where("score > 0")
    once = Window.partitionBy("query_id", "line").orderBy(F.desc("score"), "position", "k")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "position", "k")
    first = scored.withColumn("__n", F.row_number().over(once)).where("__n = 1")
    return first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_lines).select("query_id", "rank", "line", "score")


def block_lines(content: Column, most: int = 4) -> Column:
    """The first lines of the first fenced block that aren't blank, stripped."""
    return F.slice(F.filter(F.transform(F.split(T.fenced_block(content), "\n"), T.strip), lambda x: x != ""), 1, most)


def chunk_lines(hits: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, doc_id, rank, line, score): the best source lines of each hit with a fenced block, with two more points for being source and two for a mark of code.

    hits: query_id, query, doc_id, doc_type, content.
    """
    rows = hits.select("query_id", "doc_id", "doc_type", T.tokenize(F.col("query")).alias("tokens"), F.posexplode(block_lines(F.col("content"))).alias("k", "line"))
    low = F.lower("line")
    marked = F.when(F.exists(F.array(*map(F.lit, CODE_MARKS)), lambda m: F.contains(low, m)), 2).otherwise(0)
    scored = rows.withColumn("score", line_bonus(F.col("doc_type")) + 2 + F.size(F.filter("tokens", lambda t: F.contains(low, t))) + precise_bonus(F.col("line"), F.col("tokens")) + marked)
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "k")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "doc_id", "rank", "line", "score")


def chunk_evidence(documents: DataFrame) -> DataFrame:
    """(doc_id, evidence): a line of evidence for each document with a source chunk: its type and path, its location and its first two source lines."""
    kinds = ["function_body_chunk", "class_body_chunk", "route_handler_chunk", "config_chunk"]
    place = F.coalesce(F.nullif(T.prefixed_value(F.col("content"), "代码位置："), F.lit("")), F.lit("未知位置"))
    preview = F.array_join(block_lines(F.col("content"), 2), " | ")
    line = F.concat(F.lit("["), "doc_type", F.lit(" | "), F.coalesce("source_path", F.lit("仓库级文档")), F.lit("] 代码位置："), place, F.when(preview != "", F.concat(F.lit("；源码片段："), preview)).otherwise(""))
    return documents.where(F.col("doc_type").isin(kinds)).select("doc_id", line.alias("evidence"))


def cleaned_items(items: Column) -> Column:
    """Items without white space and closing marks at their ends, without empty ones and the placeholder 无."""
    ends = r"^[。；;，, ]+|[。；;，, ]+$"
    return F.filter(F.transform(items, lambda x: F.regexp_replace(T.strip(x), ends, "")), lambda x: (x != "") & (x != "无"))


def merged_evidence(first: Column, more: Column) -> Column:
    """The first lines and those of the others that are new and not empty, in order."""
    return F.concat(first, F.filter(F.array_except(more, first), lambda x: x != ""))


def related_values(values: Column, content: Column) -> Column:
    """The values that occur in a content in any case of letters, or the first three where none does."""
    low = F.lower(T.text(content))
    found = F.filter(values, lambda v: F.contains(low, F.lower(v)))
    return F.when(F.size(found) > 0, found).otherwise(F.slice(values, 1, 3))


def collected_prefixed(documents: DataFrame, prefix: str, limit: int) -> DataFrame:
    """(repo_id, value, rank): the first distinct values behind a prefix at a line's start, in order of documents and lines."""
    rows = documents.select("repo_id", "doc_id", F.posexplode(T.lines(F.col("content"))).alias("k", "line")).where(F.ltrim("line").startswith(prefix))
    values = rows.withColumn("value", T.strip(F.substring(F.ltrim("line"), len(prefix) + 1, 1_000_000))).where("value <> ''")
    first = values.groupBy("repo_id", "value").agg(F.min(F.struct("doc_id", "k")).alias("at"))
    order = Window.partitionBy("repo_id").orderBy("at", "value")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("repo_id", "value", "rank")


def supported(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, best_shared, supported): whether some evidence text of the claim's group holds at least two of the claim's tokens (one
    for claims of less than three). claims: claim_id, group, text; evidence: group, evidence_id, text."""
    asked = claims.select("claim_id", "group", T.tokenize_verify(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens"))
    wanted = asked.select("claim_id", "group", "n", F.explode("tokens").alias("token"))
    # the evidence keeps the tokens of its group's claims alone, before it is exploded
    pool = wanted.groupBy("group").agg(F.collect_set("token").alias("pool"))
    held = evidence.join(pool, "group").select("group", "evidence_id", F.explode(F.array_intersect(T.tokenize_verify(F.col("text")), F.col("pool"))).alias("token"))
    shared = wanted.join(held, ["group", "token"]).groupBy("claim_id", "evidence_id").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("claim_id").agg(F.max("shared").alias("best_shared"))
    rated = asked.join(best, "claim_id", "left").withColumn("best_shared", F.coalesce("best_shared", F.lit(0)))
    return rated.select("claim_id", "best_shared", (F.col("best_shared") >= F.when(F.col("n") < 3, 1).otherwise(2)).alias("supported"))


def verdict(checked: DataFrame) -> DataFrame:
    """claims checked, supported, their share and passed, warning or failed."""
    counts = checked.agg(F.count(F.lit(1)).alias("checked"), F.count_if("supported").alias("supported"))
    score = F.when(F.col("checked") > 0, F.col("supported") / F.col("checked")).otherwise(0.0)
    return counts.withColumn("score", F.round(score, 2)).withColumn("verdict", F.when(score >= 0.8, "passed").when(score >= 0.45, "warning").otherwise("failed"))
