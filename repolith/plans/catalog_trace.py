"""Queries that follow calls from document to document, gather evidence, and work on stored documents and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from repolith.functions import text as T
from repolith.operators import answers, codegraph, graph, trace, vectors
from repolith.operators import search as S
from repolith.plans import catalog_code as code
from repolith.plans import catalog_text as texts
from repolith.plans.catalog_graph import _EDGES, LINES
from repolith.session import cut
from repolith.sources import tables

with_ = tables.sql_with


def infer_focus(spark, d):
    return texts._cases(spark, d).select("case_id", trace.infer_focus(F.col("query")).alias("focus"))


def follow_targets(spark, d):
    return trace.follow_targets(tables.documents(spark, d)).select("doc_id", "target_ref", "relation_type")


def follow_rank(spark, d):
    return trace.followed(tables.documents(spark, d)).select("doc_id", "target_ref", "next_doc", "match", "rank")


def _asked_hits(spark, d):
    hits = code._hits(spark, d)
    return hits.join(texts._asked(spark, d).select("query_id", "query"), "query_id")


def root_rank(spark, d):
    return trace.best_roots(_asked_hits(spark, d).select("query_id", "query", "doc_id", "score"), tables.documents(spark, d))


def _traces(spark, d):
    """A trace from every document that leads somewhere."""
    docs = tables.documents(spark, d)
    roots = trace.follow_targets(docs).select(F.col("doc_id").alias("query_id"), "doc_id").distinct()
    return trace.traces(roots, docs), docs


def investigate(spark, d):
    return _traces(spark, d)[0].select("query_id", "doc_id", "depth", "step", "parent_doc", "relation_type")


def max_depth(spark, d):
    """How deep the trace of each document goes."""
    return investigate(spark, d).groupBy("query_id").agg(F.max("depth").alias("depth"))


def trace_step(spark, d):
    return trace.trace_lines(*_traces(spark, d))


def parse_trace_line(spark, d):
    return trace.parsed_lines(trace_step(spark, d), ["query_id", "step"], "line")


def _call_steps(spark, d):
    """The calls of each document in order, as steps."""
    own = trace.follow_targets(tables.documents(spark, d)).where("relation_type = 'call'")
    role = F.when(F.lower("target_ref").rlike("repository|repo|dao"), "delegate_repository").when(F.lower("target_ref").rlike("service|svc"), "delegate_service").when(F.lower("target_ref").rlike("^[a-l]"), "call")
    return own.select("doc_id", F.col("seq").alias("step"), "target_ref", role.alias("relation_type"))


def representative_steps(spark, d):
    return trace.representative_steps(_call_steps(spark, d).select("doc_id", "step", "relation_type"), ["doc_id"], 3)


def parse_chain(spark, d):
    """The steps of each document's calls, written as one typed chain and read back."""
    steps = _call_steps(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("step", "target_ref", F.col("relation_type").alias("t")))).alias("s"))  # the calls of one document
    chain = trace.typed_chain(F.concat(F.array(F.element_at(F.split("doc_id", "::"), -1)), F.transform("s", lambda x: x["target_ref"])), F.transform("s", lambda x: x["t"]))
    return steps.select("doc_id", F.posexplode(trace.parsed_chain(chain)).alias("k", "e")).select("doc_id", "k", "e.*")


def chain_rank(spark, d):
    """The chains of at most two calls from each document, the best of each first."""
    keys = lambda column: tables.documents(spark, d, keys=column).select("repo_id", "doc_id", F.explode("keys").alias("key")).where("repo_id is not null")
    calls = cut(keys(graph.keys_called(F.col("metadata"))))
    defined = cut(keys(graph.keys_defined(F.col("doc_id"), F.col("content"))).join(calls.select("repo_id", "key").distinct(), ["repo_id", "key"], "left_semi"))
    return trace.best_chains(calls, defined, 4)


def chunk_lines(spark, d):
    """The source lines of each document's fenced block that speak to its own title."""
    own = tables.documents(spark, d).select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"), "doc_id", "doc_type", "content")
    return answers.chunk_lines(own).drop("query_id")


def chunk_evidence(spark, d):
    return answers.chunk_evidence(tables.documents(spark, d))


def evidence(spark, d):
    """The three best hits of each question."""
    return S.best_per_query(S.batch_scores(tables.documents(spark, d), texts._asked(spark, d)), 3).select("query_id", "rank", "doc_id")


def line_bonus(spark, d):
    """The best line of each document for its own title, by the score of lines."""
    rows = tables.documents(spark, d).select("doc_id", "doc_type", T.tokenize(F.col("title")).alias("tokens"), F.posexplode(T.lines(F.col("content"))).alias("k", "raw"))
    scored = rows.withColumn("line", T.strip(F.col("raw"))).where("line <> ''").withColumn("score", answers.line_score(F.col("line"), F.col("tokens"), F.col("doc_type")))
    return scored.groupBy("doc_id").agg(F.max("score").alias("best"), F.count_if(F.col("score") > answers.line_bonus(F.col("doc_type"))).alias("lines_that_speak"))


def clean_items(spark, d):
    own = tables.config_summaries(spark, d).select("repo_id", "source_path", F.posexplode(answers.cleaned_items(F.col("key_points"))).alias("k", "item"))
    return own


def merge_evidence(spark, d):
    """What a configuration provides and depends on, merged in order."""
    lists = [F.coalesce(c, F.array().cast("array<string>")) for c in ("service_dependencies", "env_vars")]
    own = tables.config_summaries(spark, d).select("repo_id", "source_path", F.posexplode(answers.merged_evidence(*lists)).alias("k", "line"))
    return own


def pick_related(spark, d):
    own = tables.config_summaries(spark, d).join(tables.key_files(spark, d).select("repo_id", F.col("path").alias("source_path"), "content"), ["repo_id", "source_path"])
    return own.where("env_vars is not null").select("repo_id", "source_path", F.array_join(answers.related_values(F.col("env_vars"), F.col("content")), ",").alias("related"))


KEPT_CHARS, SHOWN_CHARS = 4000, 3000


def _cut(spark, d, chars):
    own = tables.key_files(spark, d).where("content is not null")
    return own.select("repo_id", "path", F.substring("content", 1, chars).alias("content"), (F.coalesce("truncated", F.lit(False)) | (F.length("content") > chars)).alias("truncated"))


def json_key_content(spark, d):
    return _cut(spark, d, KEPT_CHARS)


def llm_snippet(spark, d):
    return _cut(spark, d, SHOWN_CHARS)


def sink_markdown(spark, d):
    """A report of each repository: its facts and its first key files and configurations, with the caps of the report."""
    repos, files, configs = tables.repos(spark, d), tables.files(spark, d), tables.config_summaries(spark, d)

    def section(rows, path, cap):
        ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("repo_id").orderBy(path))).where(F.col("n") <= cap)
        return ranked.groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(path)), lambda p: F.concat(F.lit("- "), p)), "\n").alias(f"{path}_lines"))  # at most cap of each repository

    keys = section(files.where("is_key_file").select("repo_id", "path"), "path", 40)
    kinds = section(configs.select("repo_id", "source_path"), "source_path", 20)
    own = repos.select(F.col("full_name").alias("repo_id"), "primary_language", "stargazers_count", "license_name").join(keys, "repo_id", "left").join(kinds, "repo_id", "left")
    none = F.lit("无")
    text = F.concat(
        F.lit("# "), "repo_id", F.lit("\n\n## 基础信息\n- 主语言："), F.coalesce("primary_language", none), F.lit("\n- Stars："), F.coalesce(F.col("stargazers_count").cast("string"), none), F.lit("\n- 许可证："), F.coalesce("license_name", none),
        F.lit("\n\n## 关键文件\n"), F.coalesce("path_lines", none), F.lit("\n\n## 配置\n"), F.coalesce("source_path_lines", none),
    )
    return own.select("repo_id", text.alias("report"))


def kb_delete(spark, d):
    """Documents that are left after those of the repositories without a clone have been deleted, per repository."""
    docs = tables.documents(spark, d)
    gone = docs.select("repo_id").distinct().join(tables.table(spark, d, "key_files").select("repo_id").distinct(), "repo_id", "left_anti")
    return vectors.deleted(docs, gone).groupBy("repo_id").agg(F.count(F.lit(1)).alias("documents"))


def vec_delete(spark, d):
    """Rows of the corpus that are left after deleting the repositories that evaluation cases name."""
    rows = tables.table(spark, d, "documents").select("doc_id", "repo_id")
    return vectors.deleted(rows, texts._cases(spark, d).select(F.col("expected_repo_id").alias("repo_id"))).select("doc_id", "repo_id")


def vec_list(spark, d):
    return tables.table(spark, d, "documents").select("repo_id").where("repo_id is not null").distinct()


def vec_count(spark, d):
    return tables.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("repo_id").alias("repos"))


def serialize_metadata(spark, d):
    """Metadata as JSON text and what reading it back gives: the same fields and values."""
    docs = tables.documents(spark, d).select("doc_id", F.to_json("metadata").alias("metadata_json"))
    back = docs.withColumn("m", F.from_json("metadata_json", "map<string,array<string>>"))
    return back.select("doc_id", "metadata_json", F.size(F.map_keys("m")).alias("fields"), F.size(F.flatten(F.map_values("m"))).alias("values"))


def kb_file_repo_id(spark, d):
    """The name that each stored JSON file gives itself, null where it is malformed or blank."""
    own = tables.key_files(spark, d).where("path like '%.json'")
    valid = F.when(F.try_parse_json("content").isNotNull(), F.get_json_object("content", "$.name"))
    return own.select("repo_id", "path", F.nullif(F.trim(valid), F.lit("")).alias("name"))


def rerank_topk(spark, d):
    """Nearest vectors by the index: candidates of the probed lists, re-ranked exactly."""
    rows = tables.table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.candidates(rows, rows.where("vec_id % 20 = 0"), 5)


def line_from_offset(spark, d):
    """The line on which the first return of each file stands."""
    own = tables.key_files(spark, d).withColumn("at", F.instr("content", "return ")).where("at > 0")
    before = F.substring("content", F.lit(1), F.col("at") - 1)
    return own.select("repo_id", "path", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int").alias("line_number"))


def split_args(spark, d):
    """The arguments of each definition, split at commas that no bracket or quote encloses."""
    own = codegraph.definitions(tables.key_files(spark, d)).where("kind <> 'class'")
    inside = F.regexp_extract("signature", r"^[^(]*\((.*)\)[^)]*$", 1)
    return own.select("repo_id", "path", "qualified_name", "line_start", F.posexplode(T.split_arguments(inside)).alias("k", "argument"))


def format_edge(spark, d):
    """Edges as text, and their second word read back as names are."""
    own = codegraph.edges(tables.key_files(spark, d))
    text = F.concat("relation_type", F.lit(" "), "source_ref", F.lit(" -> "), "target_ref", F.lit(" @L"), F.col("line_number").cast("string"))
    return own.select("repo_id", text.alias("text"), F.get(F.split(text, r"\s+"), F.lit(1)).alias("name")).distinct()


def format_symbol(spark, d):
    own = codegraph.definitions(tables.key_files(spark, d))
    return own.select("repo_id", "path", F.concat("kind", F.lit(" "), "qualified_name", F.lit(" @L"), F.col("line_start").cast("string")).alias("text"))


def source_snippet(spark, d):
    """The first lines of each definition, at most eight."""
    files = tables.key_files(spark, d)
    own = codegraph.definitions(files).join(files.select("repo_id", "path", "content"), ["repo_id", "path"])
    last = F.least(F.col("line_end"), F.col("line_start") + 7)
    lines = F.slice(T.lines(F.col("content")), F.col("line_start"), F.greatest(last - F.col("line_start") + 1, F.lit(0)))
    return own.select("repo_id", "path", "qualified_name", "line_start", F.array_join(lines, "\n").alias("snippet"))


def context_lines(spark, d):
    """The first six lines of context of each trace, in order of steps."""
    return trace_step(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("step"))).where("n <= 6").select("query_id", "n", "line")


_D, _K, _C, _R = with_("documents_once"), with_("key_files_once"), with_("configs_once"), with_("repos_once")
_NL = "chr(10)"
_STEPS = f"""{_D}, raw AS (SELECT doc_id, coalesce(metadata['called_symbols'], []) AS l FROM documents_once), st0 AS (SELECT doc_id, list_filter(l, lambda x, i: trim(x) <> '' AND list_position(l, x) = i) AS l FROM (SELECT doc_id, list_filter(l, lambda x: trim(x) <> '') AS l FROM raw)),
st AS (SELECT doc_id, unnest(range(0, len(l))) AS step, unnest(l) AS target_ref FROM st0),
sr AS (SELECT *, CASE WHEN regexp_matches(lower(target_ref), 'repository|repo|dao') THEN 'delegate_repository' WHEN regexp_matches(lower(target_ref), 'service|svc') THEN 'delegate_service' WHEN regexp_matches(lower(target_ref), '^[a-l]') THEN 'call' END AS relation_type FROM st)"""
_XKEYS = "list_distinct(list_filter(list_transform([s, string_split(s, '.')[-1], string_split(s, ':')[-1], string_split(s, '/')[-1], string_split(s, '->')[-1]], lambda x: trim(x)), lambda x: length(x) > 0))"
_KEYED = lambda c: _XKEYS.replace("s,", f"{c},").replace("(s,", f"({c},").replace("[s", f"[{c}")
_FOLLOW = f"""{_STEPS},
wt AS (SELECT d.repo_id, s.doc_id, d.source_path, s.target_ref, s.step AS seq, unnest({_XKEYS}) AS key FROM (SELECT *, trim(replace(lower(target_ref), '()', '')) AS s FROM st) s JOIN documents_once d USING (doc_id)),
nm0 AS (SELECT repo_id, doc_id, doc_type, source_path, string_split(doc_id, '::')[-1] AS symbol FROM documents_once WHERE len(string_split(doc_id, '::')) >= 4 UNION ALL SELECT repo_id, doc_id, doc_type, source_path, unnest(regexp_split_to_array(trim(regexp_extract(content, '(?m)^[ \\t]*symbols:([^\\n]*)$', 1)), ',\\s*')) FROM documents_once),
nm AS (SELECT DISTINCT repo_id, doc_id, doc_type, source_path, trim(symbol) AS symbol FROM nm0 WHERE trim(symbol) <> ''),
kn AS (SELECT repo_id, doc_id AS next_doc, doc_type AS next_type, source_path AS next_path, symbol, ks AS keys, unnest(ks) AS key FROM (SELECT *, {_XKEYS} AS ks FROM (SELECT *, trim(replace(lower(symbol), '()', '')) AS s FROM nm))),
mt AS (SELECT wt.*, kn.next_doc, kn.next_type, kn.next_path, CASE WHEN lower(target_ref) = lower(symbol) THEN 6 ELSE 4 END AS m FROM wt JOIN kn ON wt.repo_id = kn.repo_id AND wt.key = kn.key WHERE wt.doc_id <> kn.next_doc),
fl AS (SELECT repo_id, doc_id, target_ref, seq, next_doc, max(m) AS match, any_value(next_type) AS next_type, max(coalesce(next_path = source_path, false)) AS same_file FROM mt GROUP BY ALL),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id, doc_id, target_ref ORDER BY match DESC, same_file DESC, coalesce(nullif(list_position(['function_body_chunk', 'function_summary', 'route_handler_chunk', 'api_route_summary', 'class_body_chunk', 'class_summary'], next_type), 0), 10), next_doc) AS INT) AS rank FROM fl)"""
_LINE = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_BONUS = "CASE WHEN doc_type IN ('function_body_chunk', 'route_handler_chunk') THEN 4 WHEN doc_type IN ('class_body_chunk', 'config_chunk', 'function_summary', 'api_route_summary') THEN 3 WHEN doc_type IN ('class_summary', 'entrypoint_summary', 'config_summary') THEN 2 WHEN doc_type IN ('readme_summary', 'repo_summary', 'subproject_summary') THEN 1 ELSE 0 END"
_POINTS = "len(list_filter(toks, lambda t: contains(lower(line), t))) + 2 * len(list_filter(toks, lambda t: length(t) >= 3 AND regexp_matches(t, '[/._]') AND contains(lower(line), t)))"
_BLOCK = "list_filter(list_transform(string_split(regexp_extract(coalesce(content, ''), '(?s)(?:^|\\n)```[^\\n]*\\n(.*?)\\n?```', 1), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_CODE_TOKENS = "list_filter(list_distinct(list_concat(regexp_extract_all(t, '[\\p{L}\\p{N}_\\-./]+'), list_concat(list_transform(range(1, length(h)), lambda i: substr(h, i, 2)), regexp_extract_all(t, '/[a-z0-9_\\-/{}/:]+')))), lambda x: length(x) >= 2)"
_FOCUS = """CASE WHEN regexp_matches(q, '\\b(get|post|put|delete|patch|options|head)\\b\\s+/[a-z0-9_\\-/{}/:]+') OR (regexp_matches(q, '/[a-z0-9_\\-/{}/:]+') AND regexp_matches(q, '接口|路由|api|endpoint')) THEN 'api' WHEN regexp_matches(q, '实现|代码|源码|函数|方法|类|具体功能') THEN 'implementation' WHEN regexp_matches(q, '架构|模块|依赖关系|调用链|子项目|monorepo|workspace') THEN 'architecture' WHEN regexp_matches(q, '启动|运行|命令|run|start') THEN 'startup'
 WHEN regexp_matches(q, '入口|main|entrypoint') THEN 'entrypoint' WHEN regexp_matches(q, '环境变量|env|配置项') THEN 'env' WHEN regexp_matches(q, '数据库|缓存|redis|mysql|postgres|服务依赖') THEN 'service' WHEN regexp_matches(q, '配置|构建|打包|依赖') THEN 'config' WHEN regexp_matches(q, '做什么|是什么|介绍|概述|overview|purpose|用途|功能') THEN 'overview' ELSE 'generic' END"""
_ROOT = """CASE focus WHEN 'api' THEN CASE doc_type WHEN 'route_handler_chunk' THEN 5 WHEN 'api_route_summary' THEN 4 WHEN 'function_body_chunk' THEN 4 WHEN 'function_summary' THEN 3 WHEN 'class_body_chunk' THEN 2 WHEN 'class_summary' THEN 2 ELSE 0 END
 WHEN 'implementation' THEN CASE doc_type WHEN 'function_body_chunk' THEN 5 WHEN 'function_summary' THEN 4 WHEN 'class_body_chunk' THEN 4 WHEN 'class_summary' THEN 3 WHEN 'api_route_summary' THEN 2 WHEN 'route_handler_chunk' THEN 2 ELSE 0 END
 WHEN 'architecture' THEN CASE WHEN doc_type IN ('route_handler_chunk', 'api_route_summary', 'key_file_summary') THEN 4 WHEN doc_type IN ('entrypoint_summary', 'config_summary', 'config_chunk', 'function_body_chunk', 'function_summary', 'class_body_chunk', 'class_summary') THEN 3 ELSE 0 END ELSE 0 END"""

QUERIES = {
    "infer_focus": (infer_focus, f"SELECT case_id, {_FOCUS} AS focus FROM (SELECT case_id, lower(coalesce(query, '')) AS q FROM eval_cases)"),
    "follow_targets": (follow_targets, f"{_STEPS} SELECT doc_id, target_ref, 'call' AS relation_type FROM st"),
    "follow_rank": (follow_rank, f"{_FOLLOW} SELECT doc_id, target_ref, next_doc, match, rank FROM fr"),
    "root_rank": (
        root_rank,
        texts._BATCH + f", h AS (SELECT r.query_id, r.doc_id, r.doc_type, r.score, {_FOCUS.replace('(q,', '(lower(c.query),')} AS focus, lower(c.query) AS t, array_to_string(regexp_extract_all(lower(c.query), '[一-鿿]'), '') AS h, lower(string_split(r.doc_id, '::')[-1] || ' ' || coalesce(d.source_path, '') || ' ' || array_to_string(coalesce(d.metadata['called_symbols'], []), ' ')) AS said "
        f"FROM ranked r JOIN documents_once d USING (doc_id) JOIN eval_cases c ON c.case_id = r.query_id WHERE r.rank <= 8) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_ROOT} DESC, len(list_filter({_CODE_TOKENS}, lambda x: contains(said, x))) DESC, score DESC, doc_id) AS INT) AS root_rank FROM h",
    ),
    "investigate": (investigate, None),
    "max_depth": (max_depth, None),
    "trace_step": (trace_step, None),
    "parse_trace_line": (parse_trace_line, None),
    "context_lines": (context_lines, None),
    "representative_steps": (
        representative_steps,
        f"{_STEPS}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id, relation_type ORDER BY step DESC) AS last, min(step) OVER (PARTITION BY doc_id) AS first FROM sr) "
        "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n <= 3 THEN 0 WHEN step = first THEN 0 WHEN last = 1 AND relation_type IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN n <= 3 THEN step ELSE -step END) AS INT) AS position, step, relation_type FROM n QUALIFY position <= 3",
    ),
    "parse_chain": (parse_chain, f"{_STEPS} SELECT doc_id, CAST(step AS INT) AS k, trim(coalesce(lag(target_ref) OVER (PARTITION BY doc_id ORDER BY step), string_split(doc_id, '::')[-1])) AS source, relation_type, trim(target_ref) AS target FROM sr"),
    "chain_rank": (
        chain_rank,
        f"{code._TARGETS}, l AS (SELECT DISTINCT source_doc AS s, target_doc AS t FROM targets), c AS (SELECT l.s AS root, l.s || ' -> ' || l.t || CASE WHEN m.t IS NOT NULL THEN ' -> ' || m.t ELSE '' END AS chain, [l.s, l.t] || CASE WHEN m.t IS NOT NULL THEN [m.t] ELSE [] END AS p FROM l LEFT JOIN l m ON m.s = l.t AND m.t <> l.s WHERE m.t IS NOT NULL OR l.t NOT IN (SELECT s FROM l)), "
        "d AS (SELECT DISTINCT root, chain, list_transform(p, lambda x: string_split(x, '::')[-1]) AS labels FROM c), "
        "sc AS (SELECT root, chain, (len(labels) - 1) * 10 + list_sum(list_transform(labels, lambda x: CASE WHEN regexp_matches(lower(x), 'repository|repo|dao') THEN 4 WHEN regexp_matches(lower(x), 'service|svc') THEN 3 WHEN regexp_matches(lower(x), 'handler|controller|view|endpoint') THEN 2 ELSE 0 END)) + CASE WHEN contains(labels[1], '/') THEN 2 ELSE 0 END AS score FROM d) "
        "SELECT root, chain, CAST(score AS INT) AS score, CAST(row_number() OVER (PARTITION BY root ORDER BY score DESC, chain) AS INT) AS rank FROM sc QUALIFY rank <= 4",
    ),
    "chunk_lines": (
        chunk_lines,
        f"{_D}, b AS (SELECT doc_id, doc_type, {texts.tok('title')} AS toks, {_BLOCK}[1:4] AS l FROM documents_once), e AS (SELECT doc_id, doc_type, toks, unnest(range(0, len(l))) AS k, unnest(l) AS line FROM b), "
        f"s AS (SELECT *, {_BONUS} + 2 + {_POINTS} + CASE WHEN regexp_matches(lower(line), 'def |class |return |@|function |async ') THEN 2 ELSE 0 END AS score FROM e) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS INT) AS rank, line, CAST(score AS INT) AS score FROM s QUALIFY rank <= 3",
    ),
    "chunk_evidence": (
        chunk_evidence,
        f"{_D}, b AS (SELECT *, array_to_string({_BLOCK}[1:2], ' | ') AS preview, trim(regexp_extract(coalesce(content, ''), '(?m)^[ \\t]*代码位置：(.*)$', 1)) AS place FROM documents_once WHERE doc_type IN ('function_body_chunk', 'class_body_chunk', 'route_handler_chunk', 'config_chunk')) "
        "SELECT doc_id, '[' || doc_type || ' | ' || coalesce(source_path, '仓库级文档') || '] 代码位置：' || coalesce(nullif(place, ''), '未知位置') || CASE WHEN preview <> '' THEN '；源码片段：' || preview ELSE '' END AS evidence FROM b",
    ),
    "evidence": (evidence, texts._BATCH + " SELECT query_id, CAST(rank AS INT) AS rank, doc_id FROM ranked WHERE rank <= 3"),
    "line_bonus": (
        line_bonus,
        f"{_D}, p AS (SELECT doc_id, doc_type, {texts.tok('title')} AS toks, unnest({code._SPLIT}) AS raw FROM documents_once), l AS (SELECT doc_id, doc_type, toks, {_LINE('raw')} AS line FROM p), s AS (SELECT doc_id, {_BONUS} AS bonus, {_BONUS} + {_POINTS} - CASE WHEN length(line) > 180 THEN 1 ELSE 0 END AS score FROM l WHERE line <> '') SELECT doc_id, CAST(max(score) AS INT) AS best, count(*) FILTER (score > bonus) AS lines_that_speak FROM s GROUP BY 1",
    ),
    "clean_items": (
        clean_items,
        f"{_C}, l AS (SELECT repo_id, source_path, list_filter(list_transform(list_filter(coalesce(key_points, []), lambda x: x IS NOT NULL), lambda x: regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^[。；;，, ]+|[。；;，, ]+$', '', 'g')), lambda x: x <> '' AND x <> '无') AS l FROM configs_once) SELECT repo_id, source_path, CAST(unnest(range(0, len(l))) AS INT) AS k, unnest(l) AS item FROM l",
    ),
    "merge_evidence": (
        merge_evidence,
        f"{_C}, l AS (SELECT repo_id, source_path, coalesce(service_dependencies, []) AS a, coalesce(env_vars, []) AS b FROM configs_once), m AS (SELECT repo_id, source_path, list_concat(a, list_filter(b, lambda x, i: x <> '' AND NOT list_contains(a, x) AND list_position(b, x) = i)) AS l FROM l) SELECT repo_id, source_path, CAST(unnest(range(0, len(l))) AS INT) AS k, unnest(l) AS line FROM m",
    ),
    "pick_related": (
        pick_related,
        f"{with_('configs_once', 'key_files_once')}, r AS (SELECT c.repo_id, c.source_path, c.env_vars, list_filter(c.env_vars, lambda v: contains(lower(coalesce(k.content, '')), lower(v))) AS f FROM configs_once c JOIN key_files_once k ON k.repo_id = c.repo_id AND k.path = c.source_path WHERE c.env_vars IS NOT NULL) SELECT repo_id, source_path, coalesce(array_to_string(CASE WHEN len(f) > 0 THEN f ELSE env_vars[1:3] END, ','), '') AS related FROM r",
    ),
    "json_key_content": (json_key_content, f"{_K} SELECT repo_id, path, content[1:4000] AS content, coalesce(truncated, false) OR length(content) > 4000 AS truncated FROM key_files_once WHERE content IS NOT NULL"),
    "llm_snippet": (llm_snippet, f"{_K} SELECT repo_id, path, content[1:3000] AS content, coalesce(truncated, false) OR length(content) > 3000 AS truncated FROM key_files_once WHERE content IS NOT NULL"),
    "sink_markdown": (
        sink_markdown,
        f"{with_('repos_once', 'files_once', 'configs_once')}, k AS (SELECT repo_id, string_agg('- ' || path, {_NL} ORDER BY path) AS t FROM (SELECT repo_id, path FROM files_once WHERE is_key_file QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) <= 40) GROUP BY 1), c AS (SELECT repo_id, string_agg('- ' || source_path, {_NL} ORDER BY source_path) AS t FROM (SELECT repo_id, source_path FROM configs_once QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY source_path) <= 20) GROUP BY 1) "
        f"SELECT full_name AS repo_id, '# ' || full_name || {_NL} || {_NL} || '## 基础信息' || {_NL} || '- 主语言：' || coalesce(primary_language, '无') || {_NL} || '- Stars：' || coalesce(stargazers_count::VARCHAR, '无') || {_NL} || '- 许可证：' || coalesce(license_name, '无') || {_NL} || {_NL} || '## 关键文件' || {_NL} || coalesce(k.t, '无') || {_NL} || {_NL} || '## 配置' || {_NL} || coalesce(c.t, '无') AS report FROM repos_once r LEFT JOIN k ON k.repo_id = full_name LEFT JOIN c ON c.repo_id = full_name",
    ),
    "kb_delete": (kb_delete, f"{_D} SELECT repo_id, count(*) AS documents FROM documents_once WHERE repo_id IN (SELECT repo_id FROM key_files) OR repo_id IS NULL GROUP BY 1"),
    "vec_delete": (vec_delete, "SELECT doc_id, repo_id FROM documents WHERE repo_id IS NULL OR repo_id NOT IN (SELECT expected_repo_id FROM eval_cases WHERE expected_repo_id IS NOT NULL)"),
    "vec_list": (vec_list, "SELECT DISTINCT repo_id FROM documents WHERE repo_id IS NOT NULL"),
    "vec_count": (vec_count, "SELECT count(*) AS rows, count(DISTINCT repo_id) AS repos FROM documents"),
    "serialize_metadata": (serialize_metadata, f"{_D} SELECT doc_id, CAST(to_json(metadata) AS VARCHAR) AS metadata_json, CAST(len(map_keys(metadata)) AS INT) AS fields, CAST(len(flatten(map_values(metadata))) AS INT) AS \"values\" FROM documents_once"),
    "kb_file_repo_id": (kb_file_repo_id, f"{_K} SELECT repo_id, path, CASE WHEN json_valid(content) THEN nullif(trim(json_extract_string(content, '$.name')), '') END AS name FROM key_files_once WHERE path LIKE '%.json'"),
    "rerank_topk": (rerank_topk, None),
    "line_from_offset": (line_from_offset, f"{_K} SELECT repo_id, path, CAST(length(b) - length(replace(b, chr(10), '')) + 1 AS INT) AS line_number FROM (SELECT repo_id, path, content[1:instr(content, 'return ') - 1] AS b FROM key_files_once WHERE instr(content, 'return ') > 0)"),
    "split_args": (split_args, None),
    "format_edge": (format_edge, f"{_EDGES} SELECT DISTINCT repo_id, relation_type || ' ' || source_ref || ' -> ' || target_ref || ' @L' || line_number AS text, regexp_split_to_array(relation_type || ' ' || source_ref || ' -> ' || target_ref || ' @L' || line_number, '\\s+')[2] AS name FROM e"),
    "format_symbol": (format_symbol, f"{LINES} SELECT repo_id, path, kind || ' ' || qualified_name || ' @L' || line_start AS text FROM defs"),
    "source_snippet": (
        source_snippet,
        f"{LINES}, sp AS (SELECT repo_id, path, regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS p FROM key_files_once), tp AS (SELECT repo_id, path, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM sp) SELECT repo_id, path, qualified_name, line_start, array_to_string(p[line_start:least(line_end, line_start + 7)], chr(10)) AS snippet FROM defs JOIN tp USING (repo_id, path)",
    ),
}
