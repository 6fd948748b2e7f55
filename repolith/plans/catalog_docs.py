"""Queries over documents of code. Paths are joined to their subproject in SQL by prefix comparison, not by exploded directories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from repolith.operators import codedocs, codegraph, documents, profile, signals
from repolith.plans import catalog_code as code
from repolith.plans import catalog_signals
from repolith.plans.catalog_graph import _RELATIONS, LINES
from repolith.session import cut
from repolith.sources import tables


def _sources(spark, d):
    return tables.key_files(spark, d), profile.subprojects(tables.config_summaries(spark, d))


def _shown(df):
    return df.select("doc_id", "doc_type", "title", "content")


def doc_function_summary(spark, d):
    return _shown(codedocs.function_summaries(*_sources(spark, d)))


def doc_class_summary(spark, d):
    return _shown(codedocs.class_summaries(*_sources(spark, d)))


def doc_function_body_chunk(spark, d):
    return _shown(codedocs.body_chunks(*_sources(spark, d))).where("doc_type = 'function_body_chunk'")


def doc_class_body_chunk(spark, d):
    return _shown(codedocs.body_chunks(*_sources(spark, d))).where("doc_type = 'class_body_chunk'")


def doc_api_route_summary(spark, d):
    return _shown(codedocs.route_summaries(*_sources(spark, d)))


def doc_route_handler_chunk(spark, d):
    return _shown(codedocs.route_chunks(*_sources(spark, d)))


def function_edges(spark, d):
    """The edges that documents of functions carry in their metadata, read back from the aligned lists."""
    own = codedocs.function_summaries(*_sources(spark, d))
    field = lambda f: F.try_element_at("metadata", F.lit(f))
    zipped = F.arrays_zip(field("code_relation_sources").alias("source_ref"), field("code_relation_targets").alias("target_ref"), field("code_relation_types").alias("relation_type"))
    return own.select("doc_id", F.explode(zipped).alias("e")).select("doc_id", "e.*").distinct()


def _subprojects(spark, d):
    return signals.subprojects(tables.files(spark, d), tables.key_files(spark, d))


def _profiles(spark, d):
    files = tables.key_files(spark, d)
    own = codegraph.definitions(files).select("repo_id")
    return documents.profiles(tables.repos(spark, d), catalog_signals.all_signals(spark, d), signals.entry_points(tables.files(spark, d)), _subprojects(spark, d), own, codegraph.relations(files).select("repo_id"))


def doc_repo_summary(spark, d):
    return _shown(documents.repo_summaries(_profiles(spark, d)))


def doc_repo_fact(spark, d):
    return _shown(documents.repo_facts(_profiles(spark, d)))


def doc_readme_summary(spark, d):
    return _shown(documents.readme_summaries(tables.repos(spark, d)))


def doc_config_summary(spark, d):
    return _shown(documents.config_documents(tables.config_summaries(spark, d)))


def doc_config_chunk(spark, d):
    return _shown(documents.config_chunks(tables.config_summaries(spark, d), tables.key_files(spark, d)))


def _file_lines(files):
    """Symbols and relations of files as text."""
    line = lambda kind, name, at: F.concat(kind, F.lit(" "), name, F.lit(" @L"), at.cast("string"))
    symbols = codegraph.definitions(files).select("repo_id", "path", line(F.col("kind"), F.col("qualified_name"), F.col("line_start")).alias("text"))
    return symbols, codegraph.relations(files).select("repo_id", "path", line(F.col("relation_type"), F.col("target"), F.col("line_number")).alias("text"))


def doc_key_file_summary(spark, d):
    files = tables.key_files(spark, d)
    return _shown(documents.key_file_documents(files, *_file_lines(files)))


def doc_subproject_summary(spark, d):
    own = _subprojects(spark, d)
    return _shown(documents.subproject_documents(own, signals.entry_subprojects(signals.entry_points(tables.files(spark, d)), own)))


def _entries(spark, d):
    own = signals.entry_summaries(tables.key_files(spark, d)).withColumnRenamed("source_path", "path")
    roots = _subprojects(spark, d).select("repo_id", F.col("root_path").alias("root"))
    placed = profile.longest_prefix(own.select("repo_id", "path"), roots, ["repo_id"], "path").withColumnRenamed("root", "subproject_root")
    return own.join(placed, ["repo_id", "path"]).withColumnRenamed("path", "source_path")


def doc_entrypoint_summary(spark, d):
    return _shown(documents.entrypoint_documents(_entries(spark, d)))


def embedding_text(spark, d):
    docs = tables.documents(spark, d)
    return docs.select("doc_id", documents.embedding_text(docs).alias("text"))


def join_dependent_configs(spark, d):
    """For each subproject the first eight key files whose name is one of its language's configurations, or that are workflows."""
    own = _subprojects(spark, d)
    files = tables.key_files(spark, d).select("repo_id", "path")
    placed = profile.longest_prefix(files, own.select("repo_id", F.col("root_path").alias("root")), ["repo_id"], "path").where("root is not null")
    kind = signals.config_identity(F.col("path"))
    liked = placed.join(own.select("repo_id", F.col("root_path").alias("root"), "language_scope"), ["repo_id", "root"]).where((kind["language"] == F.col("language_scope")) | (kind["kind"] == "ci"))
    order = Window.partitionBy("repo_id", "root").orderBy("path")
    return liked.withColumn("k", F.row_number().over(order) - 1).where("k < 8").select("repo_id", "root", "k", "path")


def capped_collect(spark, d):
    """The first five different commands of each subproject in order of letters, ranked before they are collected."""
    rows = tables.config_summaries(spark, d).select("repo_id", F.coalesce("subproject_root", F.lit("")).alias("root"), F.explode("scripts_or_commands").alias("command"))
    return documents.capped(rows, ["repo_id", "root"], "command", 5, "commands")


def union_docs(spark, d):
    """Number and length of the documents of every builder; each is counted on its own, so that no plan holds all of them."""
    files, places = _sources(spark, d)
    narrow = lambda df: cut(df.groupBy("doc_type").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("content")).alias("chars")))
    told = cut(_profiles(spark, d))
    own = [documents.repo_summaries(told), documents.repo_facts(told)] + [q(spark, d) for q in (doc_readme_summary, doc_config_summary, doc_config_chunk, doc_entrypoint_summary, doc_subproject_summary, doc_key_file_summary)]
    facts = cut(codedocs.facts_of(files, places))
    own += [codedocs.function_summaries(files, places, facts), codedocs.class_summaries(files, places, facts), codedocs.body_chunks(files, places, facts), codedocs.route_summaries(files, places), codedocs.route_chunks(files, places)]
    return documents.union(*map(narrow, own))


_FACTS = f"""{LINES},
configs_once AS (SELECT * FROM config_summaries WHERE repo_id IS NOT NULL AND source_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id, source_path ORDER BY summary NULLS FIRST, config_kind NULLS FIRST, language_scope NULLS FIRST) = 1),
roots AS (SELECT DISTINCT repo_id, coalesce(nullif(subproject_root, ''), '.') AS root FROM configs_once),
pr AS (SELECT p.repo_id, p.path, arg_max(r.root, CASE WHEN r.root = '.' THEN 0 ELSE length(r.root) END) AS subproject FROM (SELECT DISTINCT repo_id, path FROM defs) p JOIN roots r ON r.repo_id = p.repo_id AND (r.root = '.' OR p.path = r.root OR starts_with(p.path, r.root || '/')) GROUP BY ALL),
cj AS (SELECT repo_id, path, qualified_name, line_start, string_agg(called, ', ' ORDER BY call_no) AS calls FROM cl GROUP BY ALL),
r0 AS (SELECT repo_id, path, inside.name AS qualified_name, inside.ln AS line_start, regexp_extract(line, '^\\s*return\\s+(.*?);?\\s*$', 1) AS v, min(line_number) AS n FROM li WHERE inside.name IS NOT NULL GROUP BY ALL),
r1 AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, qualified_name, line_start ORDER BY n, v) AS k FROM r0 WHERE v <> ''),
rj AS (SELECT repo_id, path, qualified_name, line_start, string_agg(v, ', ' ORDER BY k) AS rets FROM (SELECT DISTINCT repo_id, path, qualified_name, line_start, trim(v) AS v, k FROM r1 WHERE k <= 6) GROUP BY ALL),
sg AS (SELECT repo_id, path, line_number AS line_start, trim(regexp_replace(line, '\\s*[:{{]\\s*$', '')) AS signature FROM li WHERE qualified_name IS NOT NULL),
f AS (SELECT d.*, CASE WHEN regexp_matches(d.path, '\\.py$') THEN 'python' ELSE 'nodejs' END AS scope, coalesce(cj.calls, '无') AS calls, coalesce(rj.rets, '无') AS rets, coalesce(pr.subproject, '无') AS subproject, sg.signature,
  'L' || line_start || CASE WHEN line_end = line_start THEN '' ELSE '-L' || line_end END AS place FROM defs d LEFT JOIN pr USING (repo_id, path) LEFT JOIN cj USING (repo_id, path, qualified_name, line_start) LEFT JOIN rj USING (repo_id, path, qualified_name, line_start) LEFT JOIN sg USING (repo_id, path, line_start))"""
_SHOWN_LIST = lambda c: f"coalesce(nullif(replace({c}, ',', ', '), ''), '无')"
_NL = "chr(10)"
_CHUNKS = """,
sp AS (SELECT repo_id, path, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM (SELECT repo_id, path, regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS p FROM key_files_once WHERE content <> '')),
ch AS (SELECT f.*, greatest(line_start - 1, 1) AS b, least(greatest(line_start - 1, 1) + 23, line_end + 2, len(sp.p)) AS e, sp.p FROM f JOIN sp USING (repo_id, path)),
cx AS (SELECT *, array_to_string(list_transform(range(b, e + 1), lambda k: 'L' || k || ': ' || p[k]), chr(10)) AS c0 FROM ch WHERE e >= b),
cc AS (SELECT *, CASE WHEN length(c0) > 1800 THEN regexp_replace(c0[1:1797], '\\s+$', '') || '...' ELSE c0 END AS chunk FROM cx)"""


def _chunk_sql(kind: str, word: str, condition: str) -> str:
    return (
        f"{_FACTS}{_CHUNKS} SELECT repo_id || '::{kind}::' || path || '::' || qualified_name AS doc_id, '{kind}' AS doc_type, repo_id || '::' || qualified_name || ' {word}源码片段' AS title, "
        f"'仓库 ' || repo_id || ' 中的{word}源码片段。' || {_NL} || '来源文件：' || path || {_NL} || '限定名：' || qualified_name || {_NL} || '语言范围：' || scope || {_NL} || '代码位置：L' || b || CASE WHEN n = 1 THEN '' ELSE '-L' || (b + n - 1) END || {_NL} || '函数签名：' || signature || {_NL} || '调用：' || calls || {_NL} || '所属子项目：' || subproject "
        f"|| {_NL} || '源码片段：' || {_NL} || '```text' || {_NL} || chunk || {_NL} || '```' AS content FROM (SELECT *, len(string_split(chunk, chr(10))) AS n FROM cc) WHERE chunk <> '' AND {condition}"
    )


_R, _C, _K, _D = (tables.sql_with(n) for n in ("repos_once", "configs_once", "key_files_once", "documents_once"))
_SUBS = catalog_signals._SUBS
_UNIQUE = lambda c: f"(SELECT coalesce(nullif(array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i), ', '), ''), '无') FROM (SELECT list_transform(list_filter(coalesce({c}, []), lambda x: x IS NOT NULL), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS l))"
_SIGNALS_AND_SUBS = catalog_signals._ALL + "," + _SUBS[_SUBS.index(" rt(key") :]
_FACET = lambda c, n: f"coalesce(string_agg(DISTINCT CASE WHEN category = '{c}' THEN name END, ', ' ORDER BY CASE WHEN category = '{c}' THEN name END), '') AS {n}"
_PROFILE = f"""{_SIGNALS_AND_SUBS}, fc AS (SELECT repo_id, {', '.join(_FACET(c, n) for c, n in (('language', 'languages'), ('framework', 'frameworks'), ('runtime', 'runtimes'), ('build_tool', 'build_tools'), ('package_manager', 'package_managers'), ('test_tool', 'test_tools'), ('ci_cd', 'ci_cd_tools'), ('deploy_tool', 'deploy_tools')))}, string_agg(DISTINCT name, ', ' ORDER BY name) AS stack FROM best WHERE evidence_level <> 'weak' GROUP BY 1),
en AS (SELECT repo_id, string_agg(path, ', ' ORDER BY path) AS entrypoints FROM (SELECT DISTINCT repo_id, path FROM files_once WHERE {catalog_signals._ENTRY} QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) <= 50) GROUP BY 1),
sd AS (SELECT repo_id, string_agg(s, ', ' ORDER BY s) AS subs FROM (SELECT repo_id, root_path || '(' || language_scope || '/' || project_kind || ')' AS s FROM sub QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY s) <= 50) GROUP BY 1)"""
_OR = lambda c, none="无": f"coalesce(nullif({c}, ''), '{none}')"
_CFG_HEAD = f"'来源文件：' || source_path || {_NL} || '配置类型：' || coalesce(config_kind, '') || {_NL} || '语言范围：' || coalesce(language_scope, '') || {_NL} || '所属子项目：' || {_OR('subproject_root')}"

QUERIES = {
    "doc_function_summary": (
        doc_function_summary,
        f"{_FACTS} SELECT repo_id || '::function_summary::' || path || '::' || qualified_name AS doc_id, 'function_summary' AS doc_type, repo_id || '::' || qualified_name || ' 函数摘要' AS title, '仓库 ' || repo_id || ' 中的函数/方法实现摘要。' || {_NL} || '来源文件：' || path || {_NL} || '符号名称：' || name || {_NL} || '限定名：' || qualified_name || {_NL} || '语言范围：' || scope || {_NL} "
        f"|| '代码位置：' || place || {_NL} || '所属类：' || coalesce(owner_class, '无') || {_NL} || '函数签名：' || signature || {_NL} || '装饰器：无' || {_NL} || '参数：' || {_SHOWN_LIST('parameters')} || {_NL} || '调用：' || calls || {_NL} || '返回线索：' || rets || {_NL} || '所属子项目：' || subproject AS content FROM f WHERE kind <> 'class'",
    ),
    "doc_class_summary": (
        doc_class_summary,
        f"{_FACTS}, m AS (SELECT repo_id, path, owner_class AS qualified_name, name, min(line_start) AS place FROM defs WHERE kind = 'method' GROUP BY ALL), j AS (SELECT repo_id, path, qualified_name, string_agg(name, ', ' ORDER BY place, name) AS methods FROM m GROUP BY ALL) "
        f"SELECT repo_id || '::class_summary::' || path || '::' || qualified_name AS doc_id, 'class_summary' AS doc_type, repo_id || '::' || qualified_name || ' 类摘要' AS title, '仓库 ' || repo_id || ' 中的类实现摘要。' || {_NL} || '来源文件：' || path || {_NL} || '类名称：' || name || {_NL} || '限定名：' || qualified_name || {_NL} || '语言范围：' || scope || {_NL} "
        f"|| '代码位置：' || place || {_NL} || '继承：' || {_SHOWN_LIST('bases')} || {_NL} || '装饰器：无' || {_NL} || '方法：' || coalesce(methods, '无') || {_NL} || '所属子项目：' || subproject AS content FROM f LEFT JOIN j USING (repo_id, path, qualified_name) WHERE kind = 'class'",
    ),
    "doc_function_body_chunk": (doc_function_body_chunk, _chunk_sql("function_body_chunk", "函数", "kind <> 'class'")),
    "doc_class_body_chunk": (doc_class_body_chunk, _chunk_sql("class_body_chunk", "类", "kind = 'class'")),
    "doc_api_route_summary": (doc_api_route_summary, None),
    "doc_route_handler_chunk": (doc_route_handler_chunk, None),
    "function_edges": (
        function_edges,
        f"{LINES} SELECT DISTINCT repo_id || '::function_summary::' || path || '::' || qualified_name AS doc_id, source_ref, target_ref, relation_type FROM (SELECT repo_id, path, qualified_name, path AS source_ref, qualified_name AS target_ref, 'contain_symbol' AS relation_type FROM defs WHERE kind <> 'class' UNION ALL SELECT repo_id, path, qualified_name, owner_class, qualified_name, 'define_method' FROM defs WHERE kind = 'method' "
        "UNION ALL SELECT repo_id, path, qualified_name, qualified_name, called, CASE WHEN regexp_matches(lower(called), 'repository|repo|dao') THEN 'delegate_repository' WHEN regexp_matches(lower(called), 'service|svc') THEN 'delegate_service' ELSE 'call' END FROM cl)",
    ),
    "doc_repo_fact": (
        doc_repo_fact,
        f"{_PROFILE} SELECT full_name || '::repo_fact' AS doc_id, 'repo_fact' AS doc_type, full_name || ' 仓库事实' AS title, 'repo_id: ' || full_name || {_NL} || 'default_branch: ' || coalesce(default_branch, '') || {_NL} || 'primary_language: ' || {_OR('primary_language', '未指定')} || {_NL} "
        + " ".join(f"|| '{n}: ' || {_OR('fc.' + n)} || {_NL}" for n in ("languages", "frameworks", "runtimes", "build_tools", "package_managers", "test_tools", "ci_cd_tools", "deploy_tools"))
        + f" || 'entrypoints: ' || coalesce(entrypoints, '无') || {_NL} || 'subprojects: ' || coalesce(subs, '无') || {_NL} || 'topics: ' || {_UNIQUE('topics')} || {_NL} || 'stars: ' || coalesce(stargazers_count::VARCHAR, '0') || {_NL} || 'license: ' || {_OR('license_name')} AS content FROM repos_once r LEFT JOIN fc ON fc.repo_id = full_name LEFT JOIN en ON en.repo_id = full_name LEFT JOIN sd ON sd.repo_id = full_name",
    ),
    "doc_repo_summary": (
        doc_repo_summary,
        f"{_PROFILE},\n{LINES[LINES.index('raw AS') :]}{_RELATIONS[: _RELATIONS.index(',' + chr(10) + 'ps AS')]}, sc AS (SELECT repo_id, count(*) AS n FROM defs GROUP BY 1), rc AS (SELECT repo_id, count(*) AS n FROM rl GROUP BY 1) "
        f"SELECT full_name || '::repo_summary' AS doc_id, 'repo_summary' AS doc_type, full_name || ' 仓库摘要' AS title, '仓库 ' || full_name || ' 的项目概览。' || {_NL} || '主语言：' || {_OR('primary_language', '未识别')} || {_NL} || '技术栈：' || {_OR('stack')} || {_NL} || '框架：' || {_OR('fc.frameworks')} || {_NL} || '运行时：' || {_OR('fc.runtimes')} || {_NL} || '构建工具：' || {_OR('fc.build_tools')} || {_NL} "
        f"|| '包管理器：' || {_OR('fc.package_managers')} || {_NL} || '入口文件：' || coalesce(entrypoints, '无') || {_NL} || '子项目：' || coalesce(subs, '无') || {_NL} || '关键符号数量：' || coalesce(sc.n, 0) || {_NL} || '模块依赖关系数量：' || coalesce(rc.n, 0) AS content FROM repos_once r LEFT JOIN fc ON fc.repo_id = full_name LEFT JOIN en ON en.repo_id = full_name LEFT JOIN sd ON sd.repo_id = full_name LEFT JOIN sc ON sc.repo_id = full_name LEFT JOIN rc ON rc.repo_id = full_name",
    ),
    "doc_readme_summary": (doc_readme_summary, f"{_R} SELECT full_name || '::readme_summary' AS doc_id, 'readme_summary' AS doc_type, full_name || ' README 摘要' AS title, '仓库 ' || full_name || ' 的 README 摘要候选内容。' || {_NL} || '以下内容来自 README 原文截断，可用于后续检索与 LLM 精炼。' || {_NL} || {_NL} || (regexp_replace(readme, '^\\s+|\\s+$', '', 'g'))[1:2000] AS content FROM repos_once WHERE regexp_matches(readme, '\\S')"),
    "doc_config_summary": (
        doc_config_summary,
        f"{_C} SELECT repo_id || '::config_summary::' || source_path AS doc_id, 'config_summary' AS doc_type, repo_id || '::' || source_path || ' 配置摘要' AS title, '仓库 ' || repo_id || ' 的配置摘要。' || {_NL} || {_CFG_HEAD} || {_NL} || '包管理器：' || {_UNIQUE('package_managers')} || {_NL} || '关键结论：' || {_UNIQUE('key_points')} || {_NL} || '脚本或命令：' || {_UNIQUE('scripts_or_commands')} || {_NL} "
        f"|| '外部服务依赖：' || {_UNIQUE('service_dependencies')} || {_NL} || '环境变量：' || {_UNIQUE('env_vars')} || {_NL} || '摘要：' || coalesce(summary, '') AS content FROM configs_once",
    ),
    "doc_config_chunk": (
        doc_config_chunk,
        f"{code._CONFIG_CHUNK} SELECT repo_id || '::config_chunk::' || source_path AS doc_id, 'config_chunk' AS doc_type, repo_id || '::' || source_path || ' 配置片段' AS title, '仓库 ' || repo_id || ' 中的配置文件片段。' || {_NL} || {_CFG_HEAD} || {_NL} || '脚本或命令：' || {_UNIQUE('scripts_or_commands')} || {_NL} || '环境变量：' || {_UNIQUE('env_vars')} || {_NL} || '配置片段：' || {_NL} || '```text' || {_NL} || {code._CHUNK} || {_NL} || '```' AS content FROM j JOIN configs_once USING (repo_id, source_path) WHERE c <> ''",
    ),
    "doc_key_file_summary": (
        doc_key_file_summary,
        f"{LINES}{_RELATIONS}, st AS (SELECT DISTINCT repo_id, path, kind || ' ' || qualified_name || ' @L' || line_start AS t FROM defs), sj AS (SELECT repo_id, path, string_agg(t, ', ' ORDER BY t) AS s FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY t) <= 8) GROUP BY ALL), "
        "rt AS (SELECT DISTINCT repo_id, path, relation_type || ' ' || target || ' @L' || line_number AS t FROM rl), rj AS (SELECT repo_id, path, string_agg(t, ', ' ORDER BY t) AS r FROM (SELECT * FROM rt QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY t) <= 8) GROUP BY ALL), "
        f"b AS (SELECT *, coalesce(nullif(content, ''), '<空内容>') AS body FROM key_files_once) SELECT repo_id || '::key_file::' || path AS doc_id, 'key_file_summary' AS doc_type, repo_id || '::' || path AS title, '仓库 ' || repo_id || ' 的关键文件 ' || path || ' 摘要候选内容。' || {_NL} || '文件大小：' || coalesce(size_bytes::VARCHAR, '') || ' 字节。' || {_NL} || '是否截断：' || CASE WHEN coalesce(truncated, false) OR length(body) > 2000 THEN '是' ELSE '否' END || '。' || {_NL} "
        f"|| '关键符号：' || coalesce(s, '无') || '。' || {_NL} || '模块依赖：' || coalesce(r, '无') || '。' || {_NL} || '以下内容来自关键文件原文截断，可用于后续检索与 LLM 精炼。' || {_NL} || {_NL} || body[1:2000] AS content FROM b LEFT JOIN sj USING (repo_id, path) LEFT JOIN rj USING (repo_id, path)",
    ),
    "doc_subproject_summary": (
        doc_subproject_summary,
        f"{_SUBS}, mk AS (SELECT sub.*, concat_ws(', ', CASE WHEN starts_with(lower(root_path), 'packages/') THEN 'package' END, CASE WHEN starts_with(lower(root_path), 'apps/') THEN 'app' END, CASE WHEN starts_with(lower(root_path), 'services/') THEN 'service' END, CASE WHEN starts_with(lower(root_path), 'cmd/') THEN 'command' END, CASE WHEN ws.repo_id IS NOT NULL THEN 'monorepo_workspace' END) AS markers FROM sub LEFT JOIN ws USING (repo_id, root_path)), "
        f"e0 AS (SELECT DISTINCT repo_id, path FROM files_once WHERE {catalog_signals._ENTRY}), e1 AS (SELECT e0.repo_id, arg_max(sub.root_path, CASE WHEN sub.root_path = '.' THEN 0 ELSE length(sub.root_path) END) AS root_path, e0.path FROM e0 JOIN sub ON sub.repo_id = e0.repo_id AND (sub.root_path = '.' OR starts_with(e0.path, sub.root_path || '/')) GROUP BY e0.repo_id, e0.path), "
        "ej AS (SELECT repo_id, root_path, string_agg(path, ', ' ORDER BY path) AS entries FROM (SELECT * FROM e1 QUALIFY row_number() OVER (PARTITION BY repo_id, root_path ORDER BY path) <= 50) GROUP BY ALL) "
        f"SELECT repo_id || '::subproject_summary::' || root_path AS doc_id, 'subproject_summary' AS doc_type, repo_id || '::' || root_path || ' 子项目摘要' AS title, '仓库 ' || repo_id || ' 的子项目摘要。' || {_NL} || '子项目根目录：' || root_path || {_NL} || '语言范围：' || language_scope || {_NL} || '子项目类型：' || project_kind || {_NL} || '子项目标签：' || {_OR('markers')} || {_NL} || '配置文件：' || replace(config_paths, ',', ', ') || {_NL} || '入口文件：' || coalesce(entries, '无') AS content FROM mk LEFT JOIN ej USING (repo_id, root_path)",
    ),
    "doc_entrypoint_summary": (
        doc_entrypoint_summary,
        f"{_SUBS}, k(key, entry_kind, scope) AS (VALUES {catalog_signals._ENTRIES}), sv(word, name) AS (VALUES {catalog_signals._SERVICES}), e AS (SELECT f.repo_id, f.path, k.scope, coalesce(f.content, '') AS content, CASE WHEN regexp_matches(lower(content), 'argparse|typer|click|commander|yargs') THEN 'cli' WHEN regexp_matches(lower(content), 'fastapi|flask|django|uvicorn|express|nestjs|http\\.handlefunc') THEN 'web_api' "
        f"WHEN regexp_matches(lower(content), 'reactdom\\.createroot|createroot\\(|createapp\\(|render\\(|vite/client') THEN 'frontend' WHEN regexp_matches(lower(content), 'celery|worker|consumer|bullmq|rq worker') THEN 'worker' WHEN regexp_matches(lower(content), 'langgraph|stategraph|workflow') THEN 'workflow' ELSE entry_kind END AS kind FROM key_files_once f JOIN k ON key = {catalog_signals._NAME} WHERE content <> ''), "
        "pr AS (SELECT e.repo_id, e.path, arg_max(s.root_path, CASE WHEN s.root_path = '.' THEN 0 ELSE length(s.root_path) END) AS root FROM e JOIN sub s ON s.repo_id = e.repo_id AND (s.root_path = '.' OR starts_with(e.path, s.root_path || '/')) GROUP BY 1, 2), "
        "o(name, n) AS (SELECT name, min(n) FROM (SELECT name, row_number() OVER () AS n FROM sv) GROUP BY 1), se AS (SELECT repo_id, path, string_agg(name, ', ' ORDER BY n) AS services FROM (SELECT DISTINCT e.repo_id, e.path, sv.name FROM e JOIN sv ON contains(lower(e.content), sv.word)) JOIN o USING (name) GROUP BY 1, 2) "
        f"SELECT e.repo_id || '::entrypoint_summary::' || e.path AS doc_id, 'entrypoint_summary' AS doc_type, e.repo_id || '::' || e.path || ' 入口摘要' AS title, '仓库 ' || e.repo_id || ' 的入口摘要。' || {_NL} || '来源文件：' || e.path || {_NL} || '入口类型：' || kind || {_NL} || '语言范围：' || scope || {_NL} || '所属子项目：' || coalesce(root, '无') || {_NL} || '外部服务依赖：' || coalesce(services, '无') AS content FROM e LEFT JOIN pr USING (repo_id, path) LEFT JOIN se USING (repo_id, path)",
    ),
    "embedding_text": (
        embedding_text,
        f"{_D} SELECT doc_id, concat_ws({_NL}, '标题: ' || coalesce(title, ''), '类型: ' || coalesce(doc_type, ''), '仓库: ' || coalesce(repo_id, ''), CASE WHEN source_path <> '' THEN '路径: ' || source_path END, "
        + ", ".join(f"CASE WHEN {_UNIQUE('metadata[' + repr(f) + ']')} <> '无' THEN '{f}: ' || {_UNIQUE('metadata[' + repr(f) + ']')} END" for f in ("subproject_root", "called_symbols"))
        + ", '正文:', coalesce(content, '')) AS text FROM documents_once",
    ),
    "join_dependent_configs": (
        join_dependent_configs,
        f"{_SUBS}, kd(key, kind, language) AS (VALUES {catalog_signals._KINDS}), p AS (SELECT f.repo_id, f.path, arg_max(s.root_path, CASE WHEN s.root_path = '.' THEN 0 ELSE length(s.root_path) END) AS root FROM key_files_once f JOIN sub s ON s.repo_id = f.repo_id AND (s.root_path = '.' OR starts_with(f.path, s.root_path || '/')) GROUP BY 1, 2) "
        "SELECT p.repo_id, p.root, CAST(row_number() OVER (PARTITION BY p.repo_id, p.root ORDER BY p.path) - 1 AS INT) AS k, p.path FROM p JOIN sub ON sub.repo_id = p.repo_id AND sub.root_path = p.root JOIN kd ON kd.key = lower(string_split(p.path, '/')[-1]) AND kd.language = sub.language_scope QUALIFY k < 8",
    ),
    "capped_collect": (capped_collect, f"{_C}, e AS (SELECT DISTINCT repo_id, coalesce(subproject_root, '') AS root, unnest(scripts_or_commands) AS command FROM configs_once), r AS (SELECT * FROM e WHERE command IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id, root ORDER BY command) <= 5) SELECT repo_id, root, string_agg(command, ', ' ORDER BY command) AS commands FROM r GROUP BY 1, 2"),
    "union_docs": (union_docs, None),
}
