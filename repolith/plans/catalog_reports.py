"""Queries over reports, manifests, rule matches and further joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolith.functions import text as T
from repolith.operators import codeindex, graph, profile, reports, search
from repolith.plans import catalog_code as code
from repolith.plans import catalog_text as texts
from repolith.sources import tables

with_ = tables.sql_with


def sink_json_report(spark, d):
    return reports.json_reports(tables.repos(spark, d), tables.documents(spark, d))


def sink_llm_context(spark, d):
    return reports.context_excerpts(tables.key_files(spark, d))


def readme_highlights(spark, d):
    return reports.readme_highlights(tables.repos(spark, d))


def package_json(spark, d):
    return reports.package_manifests(tables.key_files(spark, d))


def pyproject(spark, d):
    return reports.toml_manifests(tables.key_files(spark, d))


def embed_service(spark, d):
    return reports.hashed_embeddings(tables.documents(spark, d), "doc_id", "content")


def relation_chains(spark, d):
    edges = code._dir_edges(spark, d)
    roots = tables.table(spark, d, "files").where("repo_id is not null").select(F.concat("repo_id", F.lit(":")).alias("node")).distinct()
    return reports.chains(edges, roots, 2)


def doc_type_filter(spark, d):
    kinds = ["function_summary", "function_body_chunk", "class_summary", "class_body_chunk", "api_route_summary", "route_handler_chunk", "entrypoint_summary", "key_file_summary", "config_summary", "subproject_summary"]
    return tables.documents(spark, d).where(F.col("doc_type").isin(kinds)).groupBy("repo_id", "doc_type").agg(F.count(F.lit(1)).alias("documents"))


def semi_repo(spark, d):
    """Documents of the repositories that an evaluation case names."""
    named = texts._cases(spark, d).select(F.col("expected_repo_id").alias("repo_id")).where("repo_id is not null").distinct()
    return tables.documents(spark, d).join(named, "repo_id", "left_semi").select("doc_id", "repo_id")


def set_except(spark, d):
    return tables.repos(spark, d).select(F.col("full_name").alias("repo_id")).exceptAll(tables.table(spark, d, "config_summaries").select("repo_id").where("repo_id is not null").distinct())


def set_intersect(spark, d):
    have = tables.table(spark, d, "documents").select("repo_id").where("repo_id is not null")
    return tables.table(spark, d, "knowledge_docs").select("repo_id").intersect(have)


def join_file_structure(spark, d):
    """Symbols, classes and relations of each key file, counted on its own row."""
    kinds = {name: codeindex.line_kinds(F.col("path"), F.col("content"), rules) for name, rules in (("symbols", codeindex.SYMBOL_RULES), ("relations", codeindex.RELATION_RULES))}
    size = lambda values: F.size(values).cast("bigint")
    return tables.key_files(spark, d, **kinds).select("repo_id", "path", size("symbols").alias("symbols"), size(F.filter("symbols", lambda k: k == "class")).alias("classes"), size("relations").alias("relations"))


def role_priority(spark, d):
    called = graph.call_edges(tables.documents(spark, d)).select("called").distinct()
    return called.select("called", codeindex.role_priority(F.col("called")).alias("priority"))


def line_window(spark, d):
    """Two lines around each first definition of a Python file."""
    files = codeindex.of_language(tables.key_files(spark, d), "py")
    first = codeindex.symbols(tables.key_files(spark, d), "py").groupBy("repo_id", "path").agg(F.min("line_number").alias("at"))
    rows = codeindex.numbered_lines(files).join(first, ["repo_id", "path"])
    return rows.where("line_number between at - 2 and at + 2").select("repo_id", "path", "line_number", "line")


def score_coverage(spark, d):
    asked = texts._cases(spark, d).select("case_id", T.tokenize(F.col("query")).alias("q"), T.tokenize(F.col("reference_answer")).alias("a"))
    covered = F.size(F.array_intersect("q", "a"))
    return asked.select("case_id", F.round(search.coverage(covered, F.size("q")), 6).alias("score"))


def fmt_datetime(spark, d):
    return tables.repos(spark, d).select("full_name", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


def confirmed_filter(spark, d):
    return code.signal_argmax(spark, d).groupBy("repo_id").agg(F.count_if(profile.level_rank(F.col("evidence_level")) >= 2).alias("confirmed"), F.count_if(F.col("evidence_level") == "weak").alias("weak"))


_PACKAGES = " UNION ALL ".join(f"SELECT repo_id, path, '{s}' AS section, e.key AS name, e.value AS value FROM (SELECT repo_id, path, unnest(map_entries(json_transform(content->'{s}', '\"MAP(VARCHAR, VARCHAR)\"'))) AS e FROM v)" for s in ("scripts", "dependencies", "devDependencies"))

QUERIES = {
    "sink_json_report": (
        sink_json_report,
        f"{with_('repos_once', 'documents_once')}, c AS (SELECT repo_id, count(*) AS documents, count(DISTINCT doc_type) AS types FROM documents_once GROUP BY 1) SELECT full_name AS repo_id, "
        "'{\"repo\":\"' || full_name || '\",\"stars\":' || coalesce(stargazers_count, 0) || ',\"documents\":' || coalesce(documents, 0) || ',\"types\":' || coalesce(types, 0) || '}' AS report FROM repos_once LEFT JOIN c ON c.repo_id = full_name",
    ),
    "sink_llm_context": (sink_llm_context, f"{with_('key_files_once')} SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY size_bytes DESC NULLS LAST, path) AS INT) AS rank, path, content[1:3000] AS excerpt FROM key_files_once WHERE content IS NOT NULL QUALIFY rank <= 8"),
    "readme_highlights": (
        readme_highlights,
        f"{with_('repos_once')}, e AS (SELECT full_name AS repo_id, unnest(range(0, len(p))) AS k, regexp_replace(unnest(p), '^\\s+|\\s+$', '', 'g') AS line FROM (SELECT full_name, {code._SPLIT.replace('content', 'readme')} AS p FROM repos_once)), "
        "f AS (SELECT repo_id, line, min(k) AS k FROM e WHERE NOT regexp_matches(line, '^(?:#|```|>|\\||!\\[|<)') AND length(line) >= 8 GROUP BY 1, 2) SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY k) AS INT) AS rank, line FROM f QUALIFY rank <= 3",
    ),
    "package_json": (package_json, f"{with_('key_files_once')}, v AS MATERIALIZED (SELECT repo_id, path, content FROM key_files_once WHERE regexp_matches(path, '(^|/)package\\.json$') AND json_valid(content)) {_PACKAGES}"),
    "pyproject": (pyproject, None),
    "embed_service": (embed_service, None),
    "relation_chains": (
        relation_chains,
        "WITH d AS (SELECT DISTINCT repo_id, string_split(path, '/') AS p FROM files WHERE repo_id IS NOT NULL AND path IS NOT NULL) SELECT DISTINCT repo_id || ':' AS root, repo_id || ': -> ' || repo_id || ':' || p[1] || CASE WHEN len(p) > 1 THEN ' -> ' || repo_id || ':' || p[1] || '/' || p[2] ELSE '' END AS chain FROM d",
    ),
    "doc_type_filter": (doc_type_filter, f"{with_('documents_once')} SELECT repo_id, doc_type, count(*) AS documents FROM documents_once WHERE doc_type IN ('function_summary', 'function_body_chunk', 'class_summary', 'class_body_chunk', 'api_route_summary', 'route_handler_chunk', 'entrypoint_summary', 'key_file_summary', 'config_summary', 'subproject_summary') GROUP BY 1, 2"),
    "semi_repo": (semi_repo, f"{with_('documents_once')} SELECT doc_id, repo_id FROM documents_once WHERE repo_id IN (SELECT expected_repo_id FROM eval_cases)"),
    "set_except": (set_except, f"{with_('repos_once')} SELECT full_name AS repo_id FROM repos_once EXCEPT SELECT repo_id FROM config_summaries"),
    "set_intersect": (set_intersect, "SELECT repo_id FROM knowledge_docs INTERSECT SELECT repo_id FROM documents WHERE repo_id IS NOT NULL"),
    "join_file_structure": (
        join_file_structure,
        f"{code._CODE}, s AS ({code._ALL_SYMBOLS}), r AS ({code._ALL_RELATIONS}), sc AS (SELECT repo_id, path, count(*) AS symbols, count(*) FILTER (symbol_type = 'class') AS classes FROM s GROUP BY 1, 2), rc AS (SELECT repo_id, path, count(*) AS relations FROM r GROUP BY 1, 2) "
        "SELECT repo_id, path, coalesce(symbols, 0) AS symbols, coalesce(classes, 0) AS classes, coalesce(relations, 0) AS relations FROM key_files_once LEFT JOIN sc USING (repo_id, path) LEFT JOIN rc USING (repo_id, path)",
    ),
    "role_priority": (role_priority, f"{code._TARGETS} SELECT DISTINCT called, CASE WHEN regexp_matches(called, 'repository|repo|dao') THEN 4 WHEN regexp_matches(called, 'service|svc') THEN 3 WHEN regexp_matches(called, 'handler|controller|view|endpoint') THEN 2 ELSE 0 END AS priority FROM calls"),
    "line_window": (line_window, f"{code._CODE}, s AS ({code._symbol_sql('py')}), f AS (SELECT repo_id, path, min(line_number) AS at_line FROM s GROUP BY 1, 2) SELECT l.repo_id, l.path, CAST(l.line_number AS INT) AS line_number, l.line FROM lines l JOIN f ON f.repo_id = l.repo_id AND f.path = l.path WHERE l.line_number BETWEEN at_line - 2 AND at_line + 2"),
    "score_coverage": (score_coverage, f"SELECT case_id, round(CASE WHEN c > 0 THEN least(c, 4) * 0.9::DOUBLE + CASE WHEN c >= least(n, 2) THEN 1.2::DOUBLE ELSE 0 END ELSE 0 END, 6) AS score FROM (SELECT case_id, len(list_intersect({texts.tok('query')}, {texts.tok('reference_answer')})) AS c, len({texts.tok('query')}) AS n FROM eval_cases)"),
    "fmt_datetime": (fmt_datetime, f"{with_('repos_once')} SELECT full_name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM repos_once"),
    "confirmed_filter": (confirmed_filter, f"{code._SIGNALS} SELECT repo_id, count(*) FILTER (lv >= 2) AS confirmed, count(*) FILTER (evidence_level = 'weak') AS weak FROM best GROUP BY 1"),
}
