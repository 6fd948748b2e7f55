"""Queries over signals and configuration facts. The SQL has its own tables of rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolith.operators import profile, signals
from repolith.sources import tables

with_ = tables.sql_with


def path_rules(spark, d):
    return signals.path_signals(tables.files(spark, d))


def entry_points(spark, d):
    return signals.entry_points(tables.files(spark, d))


def project_markers(spark, d):
    return signals.layout_markers(tables.files(spark, d))


def construct_rules(spark, d):
    return signals.content_signals(tables.key_files(spark, d)).where("evidence_source = 'runtime_call'")


def weak_keywords(spark, d):
    return signals.content_signals(tables.key_files(spark, d)).where("evidence_level = 'weak'")


def cli_signal(spark, d):
    """Stored files by whether they parse command lines."""
    return tables.key_files(spark, d).where("content is not null").groupBy("repo_id", signals.is_command_line(F.col("content")).alias("is_cli")).agg(F.count(F.lit(1)).alias("files"))


def service_deps(spark, d):
    own = tables.key_files(spark, d).select("repo_id", "path", F.explode(signals.services(F.col("content"))).alias("service"))
    return own


def env_vars(spark, d):
    return tables.key_files(spark, d).select("repo_id", "path", F.array_join(signals.env_vars(F.col("content")), ",").alias("variables")).where("variables <> ''")


def regex_values(spark, d):
    """The different first words of all FROM lines and of module lines."""
    own = tables.key_files(spark, d).select("repo_id", "path", F.posexplode(signals.regex_values(F.col("content"), r"(?m)^\s*(?:FROM|module|require)\s+([^\s]+)")).alias("k", "value"))
    return own


def config_identity(spark, d):
    own = tables.files(spark, d).select("repo_id", "path", signals.config_identity(F.col("path")).alias("i")).where("i is not null")
    return own.select("repo_id", "path", F.col("i.kind").alias("config_kind"), F.col("i.language").alias("language_scope"))


def entry_identity(spark, d):
    own = tables.files(spark, d).select("repo_id", "path", signals.entry_identity(F.col("path")).alias("i")).where("i is not null")
    return own.select("repo_id", "path", F.col("i.kind").alias("entry_kind"), F.col("i.language").alias("language_scope"))


def refine_entry_kind(spark, d):
    return signals.entry_summaries(tables.key_files(spark, d)).select("repo_id", "source_path", "entry_kind", "language_scope")


def config_signals(spark, d):
    own = signals.config_signals(tables.key_files(spark, d))
    return own.select("repo_id", "source_path", "config_kind", "language_scope", *(F.array_join(c, "|").alias(c) for c in ("key_points", "scripts", "services", "env_vars")))


def requirements(spark, d):
    """Names on the lines of lists of requirements; setup.cfg and go.sum have the same form."""
    own = tables.key_files(spark, d).where(F.lower("path").rlike(r"(?:requirements\.txt|\.env\.example|makefile)$"))
    return own.select("repo_id", "path", F.posexplode(signals.requirement_names(F.col("content"))).alias("k", "name"))


def _signals(spark, d):
    files, contents = tables.files(spark, d), tables.key_files(spark, d)
    languages = profile.language_signals(tables.repos(spark, d), files).select("repo_id", "name", "category", "evidence_level", "evidence_source", F.lit(None).cast("string").alias("source_path"))
    return languages.unionByName(signals.path_signals(files)).unionByName(signals.content_signals(contents))


def all_signals(spark, d):
    """The strongest evidence of every technology of a repository, of all sources."""
    return signals.strongest(_signals(spark, d))


def signal_sort(spark, d):
    return signals.sorted_signals(all_signals(spark, d)).select("repo_id", "position", "category", "name")


def tech_stack(spark, d):
    return signals.tech_stack(all_signals(spark, d)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("technologies"), F.count_if(F.col("evidence_level") == "weak").alias("weak"))


def subproject_markers(spark, d):
    own = signals.subprojects(tables.files(spark, d), tables.key_files(spark, d))
    return own.select("repo_id", "root_path", "language_scope", "project_kind", F.array_join("config_paths", ",").alias("config_paths"), F.array_join("markers", ",").alias("markers"))


def join_entry_subproject(spark, d):
    files = tables.files(spark, d)
    return signals.entry_subprojects(signals.entry_points(files), signals.subprojects(files, tables.key_files(spark, d)))


_F, _K = with_("files_once"), with_("key_files_once")
_NAME = "lower(string_split(path, '/')[-1])"
_PATH_ROWS = """
('pyproject.toml','Python','language','strong','config'),('requirements.txt','Python','language','strong','config'),('setup.py','Python','language','strong','config'),('setup.cfg','Python','language','strong','config'),
('pyproject.toml','pip','package_manager','medium','config'),('requirements.txt','pip','package_manager','medium','config'),('setup.py','pip','package_manager','medium','config'),('setup.cfg','pip','package_manager','medium','config'),
('poetry.lock','Python','language','strong','lockfile'),('poetry.lock','Poetry','package_manager','strong','lockfile'),('package.json','Node.js','runtime','strong','config'),('package.json','npm','package_manager','medium','config'),
('package-lock.json','Node.js','runtime','strong','lockfile'),('package-lock.json','npm','package_manager','strong','lockfile'),('pnpm-lock.yaml','Node.js','runtime','strong','lockfile'),('pnpm-lock.yaml','pnpm','package_manager','strong','lockfile'),
('yarn.lock','Node.js','runtime','strong','lockfile'),('yarn.lock','Yarn','package_manager','strong','lockfile'),('tsconfig.json','TypeScript','language','strong','config'),
('vite.config.ts','Vite','build_tool','strong','config'),('vite.config.js','Vite','build_tool','strong','config'),('vite.config.mjs','Vite','build_tool','strong','config'),('next.config.ts','Next.js','framework','strong','config'),('next.config.js','Next.js','framework','strong','config'),('next.config.mjs','Next.js','framework','strong','config'),
('dockerfile','Docker','deploy_tool','strong','config'),('docker-compose.yml','Docker','deploy_tool','strong','config'),('docker-compose.yaml','Docker','deploy_tool','strong','config'),('docker-compose.yml','Docker Compose','deploy_tool','strong','config'),('docker-compose.yaml','Docker Compose','deploy_tool','strong','config'),
('pom.xml','Java','language','strong','config'),('pom.xml','Maven','build_tool','strong','config'),('build.gradle','Java','language','strong','config'),('build.gradle','Gradle','build_tool','strong','config'),('build.gradle.kts','Java','language','strong','config'),('build.gradle.kts','Gradle','build_tool','strong','config'),('settings.gradle','Java','language','strong','config'),('settings.gradle','Gradle','build_tool','strong','config'),
('go.mod','Go','language','strong','config'),('go.mod','Go Modules','build_tool','strong','config'),('cargo.toml','Rust','language','strong','config'),('cargo.toml','Cargo','build_tool','strong','config'),('composer.json','PHP','language','strong','config'),('composer.json','Composer','package_manager','strong','config'),('gemfile','Ruby','language','strong','config'),('gemfile','Bundler','package_manager','strong','config')"""
_PATH_SIGNALS = f"""rules(key, name, category, evidence_level, evidence_source) AS (VALUES {_PATH_ROWS}),
ps AS (SELECT DISTINCT f.repo_id, r.name, r.category, r.evidence_level, r.evidence_source, f.path AS source_path FROM files_once f JOIN rules r ON r.key = {_NAME}
 UNION ALL SELECT repo_id, 'GitHub Actions', 'ci_cd', 'strong', 'config', path FROM files_once WHERE starts_with(lower(path), '.github/workflows/'))"""
_WORDS = "('fastapi','FastAPI','framework'),('flask','Flask','framework'),('django','Django','framework'),('langchain','LangChain','framework'),('langgraph','LangGraph','framework'),('llamaindex','LlamaIndex','framework'),('llama_index','LlamaIndex','framework'),('chromadb','Chroma','database'),('qdrant','Qdrant','database'),('faiss','FAISS','database'),('streamlit','Streamlit','framework'),('gradio','Gradio','framework'),('typer','Typer','framework'),('click','Click','framework'),('pydantic','Pydantic','tool'),('uvicorn','Uvicorn','runtime'),('sqlalchemy','SQLAlchemy','database'),('redis','Redis','database'),('celery','Celery','tool'),('react','React','framework'),('vue','Vue','framework'),('express','Express','framework'),('pytest','Pytest','test_tool'),('vitest','Vitest','test_tool'),('jest','Jest','test_tool'),('docker','Docker','deploy_tool')"
_WEAK = f"words(word, name, category) AS (VALUES {_WORDS}), wk AS (SELECT DISTINCT k.repo_id, w.name, w.category, 'weak' AS evidence_level, 'keyword' AS evidence_source, k.path AS source_path FROM key_files_once k JOIN words w ON regexp_matches(lower(k.content), '(^|[^a-z0-9_])' || w.word || '([^a-z0-9_]|$)'))"
_BUILT = """built(pattern, name, category) AS (VALUES ('\\bFastAPI\\s*\\(','FastAPI','framework'),('\\bFlask\\s*\\(','Flask','framework'),('\\btyper\\.Typer\\s*\\(','Typer','framework'),('@click\\.(?:command|group)\\s*\\(','Click','framework'),('\\buvicorn\\.run\\s*\\(','Uvicorn','runtime'),('\\bexpress\\s*\\(','Express','framework'),('\\bcreateRoot\\s*\\(','React','framework'),('\\bcreateApp\\s*\\(','Vue','framework'),('(?i)(^|[^a-z0-9_])pytest([^a-z0-9_]|$)','Pytest','test_tool')),
bt AS (SELECT DISTINCT k.repo_id, b.name, b.category, 'medium' AS evidence_level, 'runtime_call' AS evidence_source, k.path AS source_path FROM key_files_once k JOIN built b ON regexp_matches(k.content, b.pattern))"""
_ALL = f"""{with_('repos_once', 'files_once', 'key_files_once')}, {_PATH_SIGNALS}, {_WEAK}, {_BUILT},
lg AS (SELECT full_name AS repo_id, primary_language AS name, 'language' AS category, 'strong' AS evidence_level, 'metadata' AS evidence_source, NULL AS source_path FROM repos_once WHERE primary_language IS NOT NULL
 UNION ALL SELECT full_name, unnest(map_keys(languages)), 'language', 'medium', 'languages', NULL FROM repos_once
 UNION ALL SELECT DISTINCT repo_id, CASE e WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'tsx' THEN 'TypeScript' WHEN 'js' THEN 'JavaScript' WHEN 'jsx' THEN 'JavaScript' WHEN 'mjs' THEN 'JavaScript' WHEN 'go' THEN 'Go' WHEN 'rs' THEN 'Rust' WHEN 'java' THEN 'Java' END, 'language', 'weak', 'extension', NULL FROM (SELECT repo_id, lower(regexp_extract(path, '\\.(\\w+)$', 1)) AS e FROM files_once) WHERE e IN ('py','ts','tsx','js','jsx','mjs','go','rs','java')),
u AS (SELECT * FROM lg UNION ALL SELECT * FROM ps UNION ALL SELECT * FROM wk UNION ALL SELECT * FROM bt),
best AS (SELECT repo_id, category, name, evidence_level, evidence_source, source_path FROM u QUALIFY row_number() OVER (PARTITION BY repo_id, category, lower(name) ORDER BY CASE evidence_level WHEN 'strong' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, coalesce(nullif(list_position(['metadata','config','lockfile','dependency','import','runtime_call','extension','keyword'], evidence_source), 0), 0 + CASE WHEN evidence_source = 'languages' THEN 0 ELSE 99 END), coalesce(source_path, ''), name) = 1)"""
_SERVICES = "('postgres','PostgreSQL'),('postgresql','PostgreSQL'),('psycopg','PostgreSQL'),('mysql','MySQL'),('mariadb','MariaDB'),('sqlite','SQLite'),('redis','Redis'),('mongo','MongoDB'),('mongodb','MongoDB'),('mongoose','MongoDB'),('rabbitmq','RabbitMQ'),('amqp','RabbitMQ'),('kafka','Kafka'),('bullmq','Redis/BullMQ'),('celery','Celery'),('s3','S3'),('minio','MinIO'),('elasticsearch','Elasticsearch'),('meilisearch','Meilisearch')"
_KINDS = "('pyproject.toml','package_manager','python'),('requirements.txt','package_manager','python'),('package.json','package_manager','nodejs'),('pnpm-lock.yaml','package_manager','nodejs'),('yarn.lock','package_manager','nodejs'),('package-lock.json','package_manager','nodejs'),('tsconfig.json','build','nodejs'),('vite.config.ts','build','nodejs'),('vite.config.js','build','nodejs'),('vite.config.mjs','build','nodejs'),('next.config.js','build','nodejs'),('next.config.mjs','build','nodejs'),('next.config.ts','build','nodejs'),('pom.xml','build','java'),('build.gradle','build','java'),('build.gradle.kts','build','java'),('settings.gradle','build','java'),('go.mod','package_manager','go'),('cargo.toml','package_manager','rust'),('composer.json','package_manager','php'),('gemfile','package_manager','ruby'),('dockerfile','deploy','generic'),('docker-compose.yml','deploy','generic'),('docker-compose.yaml','deploy','generic')"
_ENTRIES = "('main.py','cli','python'),('app.py','web_api','python'),('manage.py','web_api','python'),('cli.py','cli','python'),('__main__.py','cli','python'),('main.go','web_api','go'),('main.rs','cli','rust'),('lib.rs','library','rust'),('program.cs','web_api','csharp'),('server.ts','web_api','nodejs'),('server.js','web_api','nodejs'),('main.ts','frontend','nodejs'),('main.tsx','frontend','nodejs'),('main.jsx','frontend','nodejs'),('workflow.py','workflow','python'),('graph.py','workflow','python')"
_VARS = "list_filter(l, lambda x, i: list_position(l, x) = i)[1:10]"
_VAR_LIST = "regexp_extract_all(c, 'process\\.env\\.([A-Z][A-Z0-9_]+)', 1) || regexp_extract_all(c, 'os\\.getenv\\(\\s*[''\"]([A-Z][A-Z0-9_]+)[''\"]', 1) || regexp_extract_all(c, 'getenv\\(\\s*[''\"]([A-Z][A-Z0-9_]+)[''\"]', 1) || regexp_extract_all(c, '\\$\\{([A-Z][A-Z0-9_]+)\\}', 1) || regexp_extract_all(c, '(?m)^\\s*([A-Z][A-Z0-9_]+)\\s*=', 1) || regexp_extract_all(c, '(?m)^\\s*ENV\\s+([A-Z][A-Z0-9_]+)=', 1)"
_ROOTS = "('package.json','nodejs','workspace'),('pyproject.toml','python','package'),('requirements.txt','python','package'),('go.mod','go','service'),('cargo.toml','rust','package'),('pom.xml','java','service'),('build.gradle','java','service'),('build.gradle.kts','java','service'),('composer.json','php','package'),('gemfile','ruby','package')"
_SUBS = f"""{with_('files_once', 'key_files_once')}, rt(key, language, kind) AS (VALUES {_ROOTS}), sf AS (SELECT f.repo_id, f.path, r.language, r.kind, CASE WHEN contains(f.path, '/') THEN regexp_replace(f.path, '/[^/]*$', '') ELSE '.' END AS root_path FROM files_once f JOIN rt r ON r.key = {_NAME}),
ws AS (SELECT DISTINCT repo_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS root_path FROM key_files_once WHERE ends_with(lower(path), 'package.json') AND json_valid(content) AND json_array_length(content, '$.workspaces') > 0),
sub AS (SELECT repo_id, root_path, min_by(language, path) AS language_scope, min_by(kind, path) AS project_kind, string_agg(DISTINCT path, ',' ORDER BY path) AS config_paths FROM sf GROUP BY ALL)"""
_ENTRY = "lower(path) IN ('src/main.rs', 'src/lib.rs') OR " + _NAME + " IN ('main.py','app.py','manage.py','cli.py','__main__.py','main.go')"

QUERIES = {
    "path_rules": (path_rules, f"{_F}, {_PATH_SIGNALS} SELECT * FROM ps"),
    "entry_points": (entry_points, f"{_F} SELECT DISTINCT repo_id, path FROM files_once WHERE {_ENTRY}"),
    "project_markers": (project_markers, f"{_F} SELECT DISTINCT repo_id, 'monorepo' AS marker FROM files_once WHERE starts_with(lower(path), 'packages/') UNION SELECT DISTINCT repo_id, 'go_cmd_layout' FROM files_once WHERE starts_with(lower(path), 'cmd/')"),
    "construct_rules": (construct_rules, f"{_K}, {_BUILT} SELECT * FROM bt"),
    "weak_keywords": (weak_keywords, f"{_K}, {_WEAK} SELECT * FROM wk"),
    "cli_signal": (cli_signal, f"{_K} SELECT repo_id, regexp_matches(lower(content), '(^|[^a-z0-9_])(?:argparse|typer|click|yargs)([^a-z0-9_]|$)|commander\\.') AS is_cli, count(*) AS files FROM key_files_once WHERE content IS NOT NULL GROUP BY 1, 2"),
    "service_deps": (service_deps, f"{_K}, s(word, name) AS (VALUES {_SERVICES}) SELECT DISTINCT k.repo_id, k.path, s.name AS service FROM key_files_once k JOIN s ON contains(lower(k.content), s.word)"),
    "env_vars": (env_vars, f"{_K}, v AS (SELECT repo_id, path, {_VAR_LIST} AS l FROM (SELECT repo_id, path, coalesce(content, '') AS c FROM key_files_once)) SELECT repo_id, path, array_to_string({_VARS}, ',') AS variables FROM v WHERE len(l) > 0"),
    "regex_values": (regex_values, f"{_K}, v AS (SELECT repo_id, path, regexp_extract_all(content, '(?m)^\\s*(?:FROM|module|require)\\s+([^\\s]+)', 1) AS l FROM key_files_once), u AS (SELECT repo_id, path, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM v) SELECT repo_id, path, CAST(unnest(range(0, len(l))) AS INT) AS k, unnest(l) AS value FROM u"),
    "config_identity": (config_identity, f"{_F}, k(key, config_kind, language_scope) AS (VALUES {_KINDS}) SELECT repo_id, path, config_kind, language_scope FROM files_once JOIN k ON key = {_NAME} UNION ALL SELECT repo_id, path, 'ci', 'generic' FROM files_once WHERE starts_with(lower(path), '.github/workflows/') AND {_NAME} NOT IN (SELECT key FROM k)"),
    "entry_identity": (entry_identity, f"{_F}, k(key, entry_kind, language_scope) AS (VALUES {_ENTRIES}) SELECT repo_id, path, entry_kind, language_scope FROM files_once JOIN k ON key = {_NAME}"),
    "refine_entry_kind": (
        refine_entry_kind,
        f"{_K}, k(key, entry_kind, language_scope) AS (VALUES {_ENTRIES}) SELECT repo_id, path AS source_path, CASE WHEN regexp_matches(lower(content), 'argparse|typer|click|commander|yargs') THEN 'cli' WHEN regexp_matches(lower(content), 'fastapi|flask|django|uvicorn|express|nestjs|http\\.handlefunc') THEN 'web_api' "
        f"WHEN regexp_matches(lower(content), 'reactdom\\.createroot|createroot\\(|createapp\\(|render\\(|vite/client') THEN 'frontend' WHEN regexp_matches(lower(content), 'celery|worker|consumer|bullmq|rq worker') THEN 'worker' WHEN regexp_matches(lower(content), 'langgraph|stategraph|workflow') THEN 'workflow' ELSE entry_kind END AS entry_kind, language_scope FROM key_files_once JOIN k ON key = {_NAME} WHERE content <> ''",
    ),
    "config_signals": (config_signals, None),
    "requirements": (
        requirements,
        f"{_K}, l AS (SELECT repo_id, path, regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS p FROM key_files_once WHERE regexp_matches(lower(path), '(requirements\\.txt|\\.env\\.example|makefile)$')), "
        "n AS (SELECT repo_id, path, list_filter(list_transform(list_filter(list_transform(p, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '#')), lambda x: regexp_extract(x, '^([^<>=\\[\\]~! ]*)', 1)), lambda x: x <> '') AS l FROM l), u AS (SELECT repo_id, path, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM n) SELECT repo_id, path, CAST(unnest(range(0, len(l))) AS INT) AS k, unnest(l) AS name FROM u",
    ),
    "all_signals": (all_signals, f"{_ALL} SELECT * FROM best"),
    "signal_sort": (signal_sort, f"{_ALL} SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY CASE evidence_level WHEN 'strong' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, category, lower(name), name) AS INT) AS position, category, name FROM best"),
    "tech_stack": (tech_stack, f"{_ALL}, h AS (SELECT *, bool_or(evidence_level <> 'weak') OVER (PARTITION BY repo_id) AS h FROM best) SELECT repo_id, count(*) AS technologies, count(*) FILTER (evidence_level = 'weak') AS weak FROM h WHERE evidence_level <> 'weak' OR NOT h GROUP BY 1"),
    "subproject_markers": (
        subproject_markers,
        f"{_SUBS} SELECT repo_id, root_path, language_scope, project_kind, config_paths, concat_ws(',', CASE WHEN starts_with(lower(root_path), 'packages/') THEN 'package' END, CASE WHEN starts_with(lower(root_path), 'apps/') THEN 'app' END, CASE WHEN starts_with(lower(root_path), 'services/') THEN 'service' END, CASE WHEN starts_with(lower(root_path), 'cmd/') THEN 'command' END, CASE WHEN ws.repo_id IS NOT NULL THEN 'monorepo_workspace' END) AS markers FROM sub LEFT JOIN ws USING (repo_id, root_path)",
    ),
    "join_entry_subproject": (
        join_entry_subproject,
        f"{_SUBS}, en AS (SELECT DISTINCT repo_id, path FROM files_once WHERE {_ENTRY}) SELECT en.repo_id, arg_max(sub.root_path, CASE WHEN sub.root_path = '.' THEN 0 ELSE length(sub.root_path) END) AS root_path, en.path AS entry_path FROM en JOIN sub ON sub.repo_id = en.repo_id AND (sub.root_path = '.' OR en.path = sub.root_path OR starts_with(en.path, sub.root_path || '/')) GROUP BY en.repo_id, en.path",
    ),
}
