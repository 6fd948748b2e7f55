"""Queries over code rows, the code graph, profiles, built documents, vectors, assets and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolith.operators import answers, assets, codeindex, graph, profile, signals, vectors
from repolith.operators import search as S
from repolith.plans import catalog_text as texts
from repolith.sources import tables
from repolith.streaming import ingest

with_ = tables.sql_with


def _symbols(language):
    return lambda spark, d: codeindex.symbols(tables.key_files(spark, d), language)


def _relations(language):
    return lambda spark, d: codeindex.relations(tables.key_files(spark, d), language)


_LINES = "lines AS (SELECT repo_id, path, unnest(range(1, len(p) + 1)) AS line_number, unnest(p) AS line FROM (SELECT repo_id, path, regexp_split_to_array(content, '\\r\\n|[\\n\\r]') AS p FROM key_files_once WHERE content <> ''))"
_CODE = f"{with_('key_files_once')}, {_LINES}"


def _rule_sql(language, rules, kind, name):
    suffix = "|".join(codeindex.SUFFIXES[language])
    pick = lambda index: "CASE " + " ".join(f"WHEN regexp_extract(line, $r${pattern}$r$, 1) <> '' THEN " + (f"'{what}'" if index else f"trim(regexp_extract(line, $r${pattern}$r$, 1))") for what, pattern in rules) + " END"
    return f"SELECT repo_id, path, {kind}, {name}, line_number FROM (SELECT repo_id, path, {pick(1)} AS {kind}, {pick(0)} AS {name}, CAST(line_number AS INT) AS line_number FROM lines WHERE regexp_matches(path, '\\.(?:{suffix})$')) WHERE {kind} IS NOT NULL"


def _symbol_sql(language):
    return _rule_sql(language, codeindex.SYMBOL_RULES[language], "symbol_type", "name")


def _relation_sql(language):
    return _rule_sql(language, codeindex.RELATION_RULES[language], "relation_type", "target")


_ALL_SYMBOLS = " UNION ALL ".join(_symbol_sql(x) for x in codeindex.SYMBOL_RULES)
_ALL_RELATIONS = " UNION ALL ".join(_relation_sql(x) for x in codeindex.RELATION_RULES)


def py_ast(spark, d):
    own = codeindex.python_trees(tables.key_files(spark, d))
    return own.select("repo_id", "path", "symbol_type", "qualified_name", "line_start", "line_end", F.array_join("parameters", ",").alias("parameters"), F.array_join("called_symbols", ",").alias("calls"))


def relation_of_call(spark, d):
    return graph.call_edges(tables.documents(spark, d))


def join_call_target(spark, d):
    return graph.call_targets(tables.documents(spark, d))


def rezip_edges(spark, d):
    return graph.rezipped(tables.documents(spark, d), "called_symbols", "line_start")


def _dir_edges(spark, d):
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.col("repo_id"), F.lit(":"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    pairs = tables.table(spark, d, "files").where("repo_id is not null and path is not null").select("repo_id", dirs.alias("d"))
    zipped = F.arrays_zip(F.concat(F.array(F.concat(F.col("repo_id"), F.lit(":"))), "d").alias("source"), F.col("d").alias("target"))
    return pairs.select(F.explode(zipped).alias("e")).select("e.source", "e.target").where("target is not null").distinct()


def waves(spark, d):
    return graph.levels(_dir_edges(spark, d)).groupBy("level").agg(F.count(F.lit(1)).alias("nodes"))


def reachability(spark, d):
    """Directories within two steps of each repository's root."""
    edges = _dir_edges(spark, d)
    roots = tables.table(spark, d, "files").where("repo_id is not null").select(F.concat("repo_id", F.lit(":")).alias("node")).distinct()
    return graph.reachable(edges, roots, 2).groupBy("root", "distance").agg(F.count(F.lit(1)).alias("nodes"))


def signal_argmax(spark, d):
    return profile.strongest(profile.language_signals(tables.repos(spark, d), tables.files(spark, d)))


def facet_collect(spark, d):
    return profile.facets(signal_argmax(spark, d))


def primary_language(spark, d):
    return profile.first_signal(signal_argmax(spark, d))


def join_signal_rules(spark, d):
    targets = graph.all_relations(tables.key_files(spark, d)).select("repo_id", "target").distinct()
    named = tables.key_files(spark, d).select("repo_id", F.explode(signals.services(F.col("content"))).alias("target"))
    names = tables.config_summaries(spark, d).select("repo_id", F.explode("service_dependencies").alias("target")).unionByName(targets).unionByName(named)
    ruled = names.withColumn("rule", profile.rule_of(F.col("target")))
    return ruled.groupBy(F.coalesce(F.col("rule.name"), F.lit("none")).alias("signal")).agg(F.count(F.lit(1)).alias("n_targets"))


def infer_subprojects(spark, d):
    return profile.subprojects(tables.config_summaries(spark, d))


def join_subproject_lpm(spark, d):
    roots = profile.subprojects(tables.config_summaries(spark, d)).select("repo_id", F.col("root_path").alias("root"))
    return profile.longest_prefix(tables.files(spark, d), roots, ["repo_id"], "path")


def cosine_knn(spark, d):
    rows = tables.table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(rows, rows.where("vec_id % 20 = 0"), 5)


def distance_to_score(spark, d):
    near = cosine_knn(spark, d)
    return near.select("query_id", "vec_id", F.round(vectors.distance_to_score(1 - F.col("cosine")), 5).alias("score"))


def vec_upsert(spark, d):
    rows = tables.table(spark, d, "knowledge_docs").where("doc_id is not null").select("doc_id", "repo_id", "indexed_at")
    first = rows.groupBy("doc_id", "repo_id").agg(F.min("indexed_at").alias("indexed_at"))
    again = rows.groupBy("doc_id", "repo_id").agg(F.max("indexed_at").alias("indexed_at"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return vectors.upserted(first, again, "doc_id")


def vec_health(spark, d):
    docs = tables.documents(spark, d).select("doc_id", "repo_id")
    corpus = tables.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "repo_id")
    return vectors.health(docs, corpus)


def _presence(spark, d):
    reports = tables.repos(spark, d).where("readme is not null and trim(readme) <> ''").select(F.col("full_name").alias("repo_id"))
    return assets.presence(clone=tables.table(spark, d, "key_files"), report=reports, knowledge=tables.table(spark, d, "knowledge_docs"), vector=tables.table(spark, d, "documents"))


def join_assets(spark, d):
    return _presence(spark, d)


def asset_status(spark, d):
    return _presence(spark, d).select("repo_id", assets.status(*(F.col(f"has_{k}") for k in assets.KINDS)).alias("status"))


def anti_orphans(spark, d):
    return assets.orphans(_presence(spark, d)).select("repo_id")


def report_name_to_repo(spark, d):
    names = tables.repos(spark, d).select("full_name", F.concat(F.replace("full_name", F.lit("/"), F.lit("__")), F.lit(".llm.txt")).alias("report"))
    return names.select("full_name", assets.report_name_to_repo(F.col("report")).alias("repo"))


def status_windows(spark, d):
    return ingest.status_windows(tables.table(spark, d, "events"))


#: Order in which hits are read for an overview.
PRIORITIES = {"readme_summary": 0, "entrypoint_summary": 1, "config_summary": 2, "function_summary": 3}


def _hits(spark, d):
    return S.best_per_query(S.batch_scores(tables.documents(spark, d), texts._asked(spark, d)), 8)


def prioritize_hits(spark, d):
    return answers.prioritized(_hits(spark, d), PRIORITIES).select("query_id", "doc_id", "position")


def select_lines(spark, d):
    ranked = answers.prioritized(_hits(spark, d), PRIORITIES)
    own = ranked.where("position <= 4").join(tables.documents(spark, d).select("doc_id", "content"), "doc_id").join(texts._asked(spark, d).select("query_id", "query"), "query_id")
    return answers.selected_lines(own)


def collect_prefixed(spark, d):
    return answers.collected_prefixed(tables.documents(spark, d), "symbols:", 5)


def verify(spark, d):
    claims = texts._cases(spark, d).where("expected_repo_id is not null").select(F.col("case_id").alias("claim_id"), F.col("expected_repo_id").alias("group"), F.col("reference_answer").alias("text"))
    evidence = tables.documents(spark, d).select(F.col("repo_id").alias("group"), F.col("doc_id").alias("evidence_id"), F.col("content").alias("text"))
    return answers.supported(claims, evidence)


def support_score(spark, d):
    return answers.verdict(verify(spark, d))


def status_by_hour(spark, d):
    """Worst status of the events of each hour and user: any error makes it failed."""
    rows = tables.table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("hour"), "user_id", "event_type")
    return rows.groupBy("hour", "user_id").agg(F.when(F.bool_or(F.col("event_type") == "error"), "failed").otherwise("success").alias("status"))


_D, _K, _C, _R = with_("documents_once"), with_("key_files_once"), with_("configs_once"), with_("repos_once")
_META = texts._META_VALUES
_KEYS = "list_distinct(list_filter(list_transform([s, string_split(s, '.')[-1], string_split(s, ':')[-1], string_split(s, '/')[-1], string_split(s, '->')[-1]], lambda x: trim(x)), lambda x: length(x) > 0))"
_TARGETS = f"""{_D},
calls AS (SELECT DISTINCT repo_id, doc_id, unnest({_META.format('called_symbols')}) AS called FROM documents_once),
ck AS (SELECT repo_id, doc_id, unnest({_KEYS}) AS key FROM (SELECT repo_id, doc_id, replace(called, '()', '') AS s FROM calls)),
dn AS (SELECT repo_id, doc_id, string_split(doc_id, '::')[-1] AS s FROM documents_once WHERE len(string_split(doc_id, '::')) >= 4 UNION ALL SELECT repo_id, doc_id, unnest(regexp_split_to_array(trim(regexp_extract(content, '(?m)^[ \t]*symbols:([^\n]*)$', 1)), ',\\s*')) FROM documents_once),
dk AS (SELECT DISTINCT repo_id, doc_id, unnest({_KEYS}) AS key FROM (SELECT repo_id, doc_id, trim(replace(lower(s), '()', '')) AS s FROM dn)),
targets AS (SELECT DISTINCT ck.repo_id, ck.doc_id AS source_doc, dk.doc_id AS target_doc FROM ck JOIN dk ON ck.repo_id = dk.repo_id AND ck.key = dk.key WHERE ck.doc_id <> dk.doc_id)"""
_ROLE = "CASE WHEN regexp_matches(called, 'repository|repo|dao') THEN 'delegate_repository' WHEN regexp_matches(called, 'service|svc') THEN 'delegate_service' ELSE 'call' END"
_SIGNALS = f"""{with_('repos_once', 'files_once')},
signals AS (SELECT full_name AS repo_id, primary_language AS name, 'strong' AS evidence_level, 'metadata' AS evidence_source, 0 AS seq, 3 AS lv FROM repos_once WHERE primary_language IS NOT NULL
 UNION ALL SELECT full_name, unnest(map_keys(languages)), 'medium', 'languages', 1, 2 FROM repos_once
 UNION ALL SELECT DISTINCT repo_id, CASE WHEN e = 'py' THEN 'Python' WHEN e IN ('ts', 'tsx') THEN 'TypeScript' WHEN e IN ('js', 'jsx', 'mjs') THEN 'JavaScript' WHEN e = 'go' THEN 'Go' WHEN e = 'rs' THEN 'Rust' WHEN e = 'java' THEN 'Java' END AS name, 'weak', 'extension', 2, 1
 FROM (SELECT repo_id, lower(regexp_extract(path, '\\.(\\w+)$', 1)) AS e FROM files_once)),
best AS (SELECT repo_id, 'language' AS category, name, evidence_level, evidence_source, lv FROM signals WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id, lower(name) ORDER BY lv DESC, seq) = 1)"""
_RULES = " ".join(f"WHEN t = '{k}' THEN '{n}'" for k, n, _ in profile.SIGNAL_RULES) + " " + " ".join(
    f"WHEN starts_with(t, '{k}.') OR starts_with(t, '{k}/') OR starts_with(t, '{k}-') OR starts_with(t, '{k}_') THEN '{n}'" for k, n, _ in profile.SIGNAL_RULES
) + " WHEN starts_with(t, '@nestjs/') THEN 'NestJS' WHEN starts_with(t, 'react-dom') THEN 'React' WHEN starts_with(t, 'next/') THEN 'Next.js' WHEN starts_with(t, '@vue/') THEN 'Vue' ELSE 'none' END"
_JOIN = "coalesce(nullif(array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i), ', '), ''), '无')"
_JOINED = lambda c: f"(SELECT {_JOIN} FROM (SELECT list_transform(list_filter(coalesce({c}, []), lambda x: x IS NOT NULL), lambda x: trim(x)) AS l))"
_SUB = f"{_C}, sub AS (SELECT repo_id, root_path, max(CASE WHEN k = 1 THEN language_scope END) AS language_scope, count(*) AS config_count FROM (SELECT *, coalesce(nullif(subproject_root, ''), '.') AS root_path, row_number() OVER (PARTITION BY repo_id, coalesce(nullif(subproject_root, ''), '.') ORDER BY source_path) AS k FROM configs_once) GROUP BY 1, 2)"
_CHUNK = "CASE WHEN length(c) > 1800 THEN regexp_replace(c[1:1797], '\\s+$', '') || '...' ELSE c END"
_CONFIG_CHUNK = (
    f"{with_('configs_once', 'key_files_once')}, l AS (SELECT c.repo_id, c.source_path, regexp_split_to_array(k.content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS p FROM configs_once c JOIN key_files_once k ON k.repo_id = c.repo_id AND k.path = c.source_path WHERE k.content <> ''), "
    "n AS (SELECT repo_id, source_path, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM l), "
    "j AS (SELECT repo_id, source_path, array_to_string(list_transform(range(1, least(len(p), 40) + 1), lambda k: 'L' || k || ': ' || p[k]), chr(10)) AS c FROM n)"
)
_PRESENCE = (
    f"{_R}, kinds AS (SELECT DISTINCT repo_id, 'clone' AS kind FROM key_files UNION ALL SELECT full_name, 'report' FROM repos_once WHERE readme IS NOT NULL AND trim(readme, ' ') <> '' UNION ALL SELECT DISTINCT repo_id, 'knowledge' FROM knowledge_docs UNION ALL SELECT DISTINCT repo_id, 'vector' FROM documents), "
    "flags AS (SELECT repo_id, bool_or(kind = 'clone') AS has_clone, bool_or(kind = 'report') AS has_report, bool_or(kind = 'knowledge') AS has_knowledge, bool_or(kind = 'vector') AS has_vector FROM kinds WHERE repo_id IS NOT NULL GROUP BY repo_id)"
)
_STATUS = "CASE WHEN has_clone AND (has_report OR has_knowledge OR has_vector) THEN '完整' WHEN has_clone THEN '仅 Clone' WHEN has_vector AND (has_report OR has_knowledge) THEN '孤儿索引+资产' WHEN has_vector THEN '仅索引残留' WHEN has_knowledge AND has_report THEN '孤儿知识+报告' WHEN has_knowledge THEN '仅知识残留' WHEN has_report THEN '仅报告残留' ELSE '空' END"
_KNN = (
    "near AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0), "
    "top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM near QUALIFY rank <= 5)"
)
_POSITION = texts._BATCH + ", pos AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE doc_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITIES.items()) + " ELSE 9 END, score DESC, doc_id) AS position FROM ranked WHERE rank <= 8)"
_SPLIT = "regexp_split_to_array(coalesce(content, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')"
_SUPPORT = (
    f"{_D}, c AS (SELECT case_id AS claim_id, expected_repo_id AS grp, {texts.tok_verify('reference_answer')} AS toks FROM eval_cases WHERE expected_repo_id IS NOT NULL), w AS (SELECT claim_id, grp, unnest(toks) AS token FROM c), "
    f"h AS (SELECT repo_id AS grp, doc_id, unnest({texts.tok_verify('content')}) AS token FROM documents_once), s AS (SELECT claim_id, doc_id, count(*) AS shared FROM w JOIN h USING (grp, token) GROUP BY 1, 2), "
    "b AS (SELECT claim_id, max(shared) AS shared FROM s GROUP BY 1), v AS (SELECT c.claim_id, coalesce(b.shared, 0) AS best_shared, coalesce(b.shared, 0) >= CASE WHEN len(toks) < 3 THEN 1 ELSE 2 END AS supported FROM c LEFT JOIN b USING (claim_id))"
)

QUERIES = {
    "py_regex": (_symbols("py"), f"{_CODE} {_symbol_sql('py')}"),
    "js_regex": (_symbols("js"), f"{_CODE} {_symbol_sql('js')}"),
    "go_index": (_symbols("go"), f"{_CODE} {_symbol_sql('go')}"),
    "rust_index": (_symbols("rs"), f"{_CODE} {_symbol_sql('rs')}"),
    "py_imports": (_relations("py"), f"{_CODE} {_relation_sql('py')}"),
    "js_imports": (_relations("js"), f"{_CODE} {_relation_sql('js')}"),
    "py_ast": (py_ast, None),
    "relation_of_call": (relation_of_call, f"{_TARGETS} SELECT DISTINCT repo_id, doc_id, called, {_ROLE} AS relation_type FROM calls"),
    "join_call_target": (join_call_target, f"{_TARGETS} SELECT repo_id, source_doc, target_doc FROM targets"),
    "rezip_edges": (
        rezip_edges,
        f"{_D}, z AS (SELECT doc_id, coalesce(metadata['called_symbols'], []) AS a, coalesce(metadata['line_start'], []) AS b FROM documents_once) SELECT doc_id, CAST(k - 1 AS INT) AS k, a[k] AS \"left\", b[k] AS \"right\" FROM (SELECT doc_id, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) AS k FROM z)",
    ),
    "waves": (
        waves,
        "WITH d AS (SELECT DISTINCT repo_id, string_split(path, '/') AS p FROM files WHERE repo_id IS NOT NULL AND path IS NOT NULL), n AS (SELECT DISTINCT repo_id, array_to_string(p[1:k], '/') AS node, k AS level FROM (SELECT repo_id, p, unnest(range(0, len(p) + 1)) AS k FROM d)) SELECT CAST(level AS INT) AS level, count(*) AS nodes FROM n GROUP BY level",
    ),
    "reachability": (
        reachability,
        "WITH d AS (SELECT DISTINCT repo_id, string_split(path, '/') AS p FROM files WHERE repo_id IS NOT NULL AND path IS NOT NULL), n AS (SELECT DISTINCT repo_id, array_to_string(p[1:k], '/') AS node, k AS distance FROM (SELECT repo_id, p, unnest(range(0, least(len(p), 2) + 1)) AS k FROM d)) SELECT repo_id || ':' AS root, CAST(distance AS INT) AS distance, count(*) AS nodes FROM n GROUP BY 1, 2",
    ),
    "signal_argmax": (signal_argmax, f"{_SIGNALS} SELECT repo_id, category, name, evidence_level, evidence_source FROM best"),
    "facet_collect": (facet_collect, f"{_SIGNALS} SELECT repo_id, category, string_agg(name, ', ' ORDER BY lv DESC, lower(name), name) AS names FROM best GROUP BY 1, 2"),
    "primary_language": (primary_language, f"{_SIGNALS} SELECT repo_id, name AS primary_language FROM best QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY lv > 1 DESC, lv DESC, lower(name)) = 1"),
    "join_signal_rules": (
        join_signal_rules,
        f"{with_('key_files_once', 'configs_once')}, {_LINES}, r AS ({_ALL_RELATIONS}), u AS (SELECT DISTINCT repo_id, target FROM r UNION ALL SELECT repo_id, unnest(service_dependencies) FROM configs_once UNION ALL SELECT repo_id, name FROM (SELECT DISTINCT k.repo_id, k.path, s.name FROM key_files_once k JOIN (VALUES ('postgres','PostgreSQL'),('psycopg','PostgreSQL'),('mysql','MySQL'),('mariadb','MariaDB'),('sqlite','SQLite'),('redis','Redis'),('mongo','MongoDB'),('rabbitmq','RabbitMQ'),('amqp','RabbitMQ'),('kafka','Kafka'),('bullmq','Redis/BullMQ'),('celery','Celery'),('s3','S3'),('minio','MinIO'),('elasticsearch','Elasticsearch'),('meilisearch','Meilisearch')) s(word, name) ON contains(lower(k.content), s.word))), "
        f"b AS (SELECT trim(regexp_replace(trim(lower(coalesce(target, ''))), '(?s)[\\[<>=~! ].*$', '')) AS t FROM u) SELECT signal, count(*) AS n_targets FROM (SELECT CASE {_RULES} AS signal FROM b) GROUP BY signal",
    ),
    "infer_subprojects": (infer_subprojects, f"{_SUB} SELECT repo_id, root_path, language_scope, config_count FROM sub"),
    "join_subproject_lpm": (
        join_subproject_lpm,
        f"{with_('files_once', 'configs_once')}, roots AS (SELECT DISTINCT repo_id, coalesce(nullif(subproject_root, ''), '.') AS root FROM configs_once) SELECT f.repo_id, f.path, arg_max(r.root, CASE WHEN r.root = '.' THEN 0 ELSE length(r.root) END) AS root FROM files_once f LEFT JOIN roots r ON r.repo_id = f.repo_id AND (r.root = '.' OR f.path = r.root OR starts_with(f.path, r.root || '/')) GROUP BY f.repo_id, f.path",
    ),
    "cosine_knn": (cosine_knn, f"WITH {_KNN} SELECT query_id, vec_id, cosine, CAST(rank AS INT) AS rank FROM top"),
    "distance_to_score": (distance_to_score, f"WITH {_KNN} SELECT query_id, vec_id, round(1 / (1 + (1 - cosine)), 5) AS score FROM top"),
    "vec_upsert": (vec_upsert, "SELECT doc_id, repo_id, max(indexed_at) AS indexed_at FROM knowledge_docs WHERE doc_id IS NOT NULL GROUP BY 1, 2"),
    "vec_health": (vec_health, "SELECT (SELECT count(DISTINCT repo_id) FROM knowledge_docs) AS local_repos, (SELECT count(DISTINCT doc_id) FROM knowledge_docs) AS local_documents, (SELECT count(DISTINCT repo_id) FROM documents) AS vector_repos, (SELECT count(DISTINCT doc_id) FROM documents) AS vector_documents"),
    "join_assets": (join_assets, f"{_PRESENCE} SELECT * FROM flags"),
    "asset_status": (asset_status, f"{_PRESENCE} SELECT repo_id, {_STATUS} AS status FROM flags"),
    "anti_orphans": (anti_orphans, f"{_PRESENCE} SELECT repo_id FROM flags WHERE NOT has_clone AND (has_report OR has_knowledge OR has_vector)"),
    "report_name_to_repo": (report_name_to_repo, f"{_R} SELECT full_name, regexp_replace(regexp_replace(replace(full_name, '/', '__') || '.llm.txt', '\\.(?:llm\\.txt|pdf|json|md)$', ''), '^(.*?)__', '\\1/') AS repo FROM repos_once"),
    "prioritize_hits": (prioritize_hits, _POSITION + " SELECT query_id, doc_id, CAST(position AS INT) AS position FROM pos"),
    "select_lines": (
        select_lines,
        _POSITION + f", l AS (SELECT p.query_id, p.position, {texts.tok('c.query')} AS toks, d.doc_type, {_SPLIT.replace('content', 'd.content')} AS parts FROM pos p JOIN documents_once d USING (doc_id) JOIN eval_cases c ON c.case_id = p.query_id WHERE position <= 4), "
        "e AS (SELECT query_id, position, doc_type, toks, unnest(range(0, len(parts))) AS k, regexp_replace(unnest(parts), '^\\s+|\\s+$', '', 'g') AS line FROM l), "
        "sl AS (SELECT *, CASE WHEN doc_type IN ('function_body_chunk', 'route_handler_chunk') THEN 4 WHEN doc_type IN ('class_body_chunk', 'config_chunk', 'function_summary', 'api_route_summary') THEN 3 WHEN doc_type IN ('class_summary', 'entrypoint_summary', 'config_summary') THEN 2 WHEN doc_type IN ('readme_summary', 'repo_summary', 'subproject_summary') THEN 1 ELSE 0 END "
        "+ len(list_filter(toks, lambda t: contains(lower(line), t))) + 2 * len(list_filter(toks, lambda t: length(t) >= 3 AND regexp_matches(t, '[/._]') AND contains(lower(line), t))) - CASE WHEN length(line) > 180 THEN 1 ELSE 0 END AS score FROM e WHERE line <> ''), fl AS (SELECT * FROM sl WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, line ORDER BY score DESC, position, k) = 1) "
        "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position, k) AS INT) AS rank, line, CAST(score AS INT) AS score FROM fl QUALIFY rank <= 4",
    ),
    "collect_prefixed": (
        collect_prefixed,
        f"{_D}, e AS (SELECT repo_id, doc_id, unnest(range(0, len(p))) AS k, unnest(p) AS line FROM (SELECT repo_id, doc_id, {_SPLIT} AS p FROM documents_once)), v AS (SELECT repo_id, doc_id, k, regexp_replace(ltrim(line)[9:], '^\\s+|\\s+$', '', 'g') AS value FROM e WHERE starts_with(ltrim(line), 'symbols:')), "
        "f AS (SELECT repo_id, value, min((doc_id, k)) AS place FROM v WHERE value <> '' GROUP BY 1, 2) SELECT repo_id, value, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY place, value) AS INT) AS rank FROM f QUALIFY rank <= 5",
    ),
    "verify": (verify, f"{_SUPPORT} SELECT claim_id, best_shared, supported FROM v"),
    "support_score": (support_score, f"{_SUPPORT} SELECT count(*) AS checked, count(*) FILTER (supported) AS supported, round(count(*) FILTER (supported)::DOUBLE / count(*), 2) AS score, CASE WHEN count(*) FILTER (supported)::DOUBLE / count(*) >= 0.8 THEN 'passed' WHEN count(*) FILTER (supported)::DOUBLE / count(*) >= 0.45 THEN 'warning' ELSE 'failed' END AS verdict FROM v"),
    "stage_trace_windows": (status_windows, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2"),
    "agent_status": (status_by_hour, "SELECT date_trunc('hour', ts) AS hour, user_id, CASE WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'success' END AS status FROM events GROUP BY 1, 2"),
}
