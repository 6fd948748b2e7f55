"""Technology signals and configuration facts of repositories, from names and contents of key files.

Rules are small tables that are written out as expressions, so that a file is read once and nothing is joined with the rules. A signal
is a row (repo_id, name, category, evidence_level, evidence_source, source_path).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import text as T
from repolith.operators.scan import name_of

# Names of key files, what they tell, category, level and source of the evidence.
PATH_RULES = [
    (["pyproject.toml", "requirements.txt", "setup.py", "setup.cfg"], "Python", "language", "strong", "config"),
    (["pyproject.toml", "requirements.txt", "setup.py", "setup.cfg"], "pip", "package_manager", "medium", "config"),
    (["poetry.lock"], "Python", "language", "strong", "lockfile"),
    (["poetry.lock"], "Poetry", "package_manager", "strong", "lockfile"),
    (["package.json"], "Node.js", "runtime", "strong", "config"),
    (["package.json"], "npm", "package_manager", "medium", "config"),
    (["package-lock.json"], "Node.js", "runtime", "strong", "lockfile"),
    (["package-lock.json"], "npm", "package_manager", "strong", "lockfile"),
    (["pnpm-lock.yaml"], "Node.js", "runtime", "strong", "lockfile"),
    (["pnpm-lock.yaml"], "pnpm", "package_manager", "strong", "lockfile"),
    (["yarn.lock"], "Node.js", "runtime", "strong", "lockfile"),
    (["yarn.lock"], "Yarn", "package_manager", "strong", "lockfile"),
    (["tsconfig.json"], "TypeScript", "language", "strong", "config"),
    (["dockerfile", "docker-compose.yml", "docker-compose.yaml"], "Docker", "deploy_tool", "strong", "config"),
    (["docker-compose.yml", "docker-compose.yaml"], "Docker Compose", "deploy_tool", "strong", "config"),
    (["pom.xml"], "Java", "language", "strong", "config"),
    (["pom.xml"], "Maven", "build_tool", "strong", "config"),
    (["build.gradle", "build.gradle.kts", "settings.gradle"], "Java", "language", "strong", "config"),
    (["build.gradle", "build.gradle.kts", "settings.gradle"], "Gradle", "build_tool", "strong", "config"),
    (["go.mod"], "Go", "language", "strong", "config"),
    (["go.mod"], "Go Modules", "build_tool", "strong", "config"),
    (["cargo.toml"], "Rust", "language", "strong", "config"),
    (["cargo.toml"], "Cargo", "build_tool", "strong", "config"),
    (["composer.json"], "PHP", "language", "strong", "config"),
    (["composer.json"], "Composer", "package_manager", "strong", "config"),
    (["gemfile"], "Ruby", "language", "strong", "config"),
    (["gemfile"], "Bundler", "package_manager", "strong", "config"),
]
# Beginnings of names, and of paths, that tell the same.
PREFIX_RULES = [("vite.config.", "Vite", "build_tool"), ("next.config.", "Next.js", "framework")]
WORKFLOWS = ".github/workflows/"
# Names of entry points, and whole paths of some.
ENTRY_NAMES = ["main.py", "app.py", "manage.py", "cli.py", "__main__.py", "main.go"]
ENTRY_PATHS = ["src/main.rs", "src/lib.rs"]
# Calls that construct or run a technology.
CONSTRUCT_RULES = [
    (r"\bFastAPI\s*\(", "FastAPI", "framework"),
    (r"\bFlask\s*\(", "Flask", "framework"),
    (r"\btyper\.Typer\s*\(", "Typer", "framework"),
    (r"@click\.(?:command|group)\s*\(", "Click", "framework"),
    (r"\buvicorn\.run\s*\(", "Uvicorn", "runtime"),
    (r"\bexpress\s*\(", "Express", "framework"),
    (r"\bcreateRoot\s*\(", "React", "framework"),
    (r"\bcreateApp\s*\(", "Vue", "framework"),
]
# Words in plain text that are weak evidence.
WEAK_KEYWORDS = [
    ("fastapi", "FastAPI", "framework"),
    ("flask", "Flask", "framework"),
    ("django", "Django", "framework"),
    ("langchain", "LangChain", "framework"),
    ("langgraph", "LangGraph", "framework"),
    ("llamaindex", "LlamaIndex", "framework"),
    ("llama_index", "LlamaIndex", "framework"),
    ("chromadb", "Chroma", "database"),
    ("qdrant", "Qdrant", "database"),
    ("faiss", "FAISS", "database"),
    ("streamlit", "Streamlit", "framework"),
    ("gradio", "Gradio", "framework"),
    ("typer", "Typer", "framework"),
    ("click", "Click", "framework"),
    ("pydantic", "Pydantic", "tool"),
    ("uvicorn", "Uvicorn", "runtime"),
    ("sqlalchemy", "SQLAlchemy", "database"),
    ("redis", "Redis", "database"),
    ("celery", "Celery", "tool"),
    ("react", "React", "framework"),
    ("vue", "Vue", "framework"),
    ("express", "Express", "framework"),
    ("pytest", "Pytest", "test_tool"),
    ("vitest", "Vitest", "test_tool"),
    ("jest", "Jest", "test_tool"),
    ("docker", "Docker", "deploy_tool"),
]
# Signs of a command line, over small letters.
CLI_SIGNS = r"(?<![a-z0-9_])(?:argparse|typer|click|yargs)(?![a-z0-9_])|commander\."
# Substrings that tell of an outside service, in order.
SERVICES = [
    ("postgres", "PostgreSQL"), ("postgresql", "PostgreSQL"), ("psycopg", "PostgreSQL"), ("mysql", "MySQL"), ("mariadb", "MariaDB"), ("sqlite", "SQLite"), ("redis", "Redis"), ("mongo", "MongoDB"), ("mongodb", "MongoDB"), ("mongoose", "MongoDB"),
    ("rabbitmq", "RabbitMQ"), ("amqp", "RabbitMQ"), ("kafka", "Kafka"), ("bullmq", "Redis/BullMQ"), ("celery", "Celery"), ("s3", "S3"), ("minio", "MinIO"), ("elasticsearch", "Elasticsearch"), ("meilisearch", "Meilisearch"),
]
# Kind and language of configuration files by name.
CONFIG_KINDS = {
    "pyproject.toml": ("package_manager", "python"),
    "requirements.txt": ("package_manager", "python"),
    "package.json": ("package_manager", "nodejs"),
    "pnpm-lock.yaml": ("package_manager", "nodejs"),
    "yarn.lock": ("package_manager", "nodejs"),
    "package-lock.json": ("package_manager", "nodejs"),
    "tsconfig.json": ("build", "nodejs"),
    "vite.config.ts": ("build", "nodejs"),
    "vite.config.js": ("build", "nodejs"),
    "vite.config.mjs": ("build", "nodejs"),
    "next.config.js": ("build", "nodejs"),
    "next.config.mjs": ("build", "nodejs"),
    "next.config.ts": ("build", "nodejs"),
    "pom.xml": ("build", "java"),
    "build.gradle": ("build", "java"),
    "build.gradle.kts": ("build", "java"),
    "settings.gradle": ("build", "java"),
    "go.mod": ("package_manager", "go"),
    "cargo.toml": ("package_manager", "rust"),
    "composer.json": ("package_manager", "php"),
    "gemfile": ("package_manager", "ruby"),
    "dockerfile": ("deploy", "generic"),
    "docker-compose.yml": ("deploy", "generic"),
    "docker-compose.yaml": ("deploy", "generic"),
}
# Kind and language of entry files by name.
ENTRY_KINDS = {
    "main.py": ("cli", "python"),
    "app.py": ("web_api", "python"),
    "manage.py": ("web_api", "python"),
    "cli.py": ("cli", "python"),
    "__main__.py": ("cli", "python"),
    "main.go": ("web_api", "go"),
    "main.rs": ("cli", "rust"),
    "lib.rs": ("library", "rust"),
    "program.cs": ("web_api", "csharp"),
    "server.ts": ("web_api", "nodejs"),
    "server.js": ("web_api", "nodejs"),
    "main.ts": ("frontend", "nodejs"),
    "main.tsx": ("frontend", "nodejs"),
    "main.jsx": ("frontend", "nodejs"),
    "workflow.py": ("workflow", "python"),
    "graph.py": ("workflow", "python"),
}
# Substrings of a content that settle an entry's kind, in the order in which kinds are tried.
ENTRY_WORDS = {
    "cli": ["argparse", "typer", "click", "commander", "yargs"],
    "web_api": ["fastapi", "flask", "django", "uvicorn", "express", "nestjs", "http.handlefunc"],
    "frontend": ["reactdom.createroot", "createroot(", "createapp(", "render(", "vite/client"],
    "worker": ["celery", "worker", "consumer", "bullmq", "rq worker"],
    "workflow": ["langgraph", "stategraph", "workflow"],
}
# Where names of environment variables stand, in order.
ENV_PATTERNS = [
    r"process\.env\.([A-Z][A-Z0-9_]{1,})",
    r"os\.getenv\(\s*['\"]([A-Z][A-Z0-9_]{1,})['\"]",
    r"getenv\(\s*['\"]([A-Z][A-Z0-9_]{1,})['\"]",
    r"\$\{([A-Z][A-Z0-9_]{1,})\}",
    r"(?m)^\s*([A-Z][A-Z0-9_]{1,})\s*=",
    r"(?m)^\s*ENV\s+([A-Z][A-Z0-9_]{1,})=",
]
MAX_ENV = 10
# Files that make a directory a subproject: language and kind.
SUBPROJECT_FILES = {
    "package.json": ("nodejs", "workspace"),
    "pyproject.toml": ("python", "package"),
    "requirements.txt": ("python", "package"),
    "go.mod": ("go", "service"),
    "cargo.toml": ("rust", "package"),
    "pom.xml": ("java", "service"),
    "build.gradle": ("java", "service"),
    "build.gradle.kts": ("java", "service"),
    "composer.json": ("php", "package"),
    "gemfile": ("ruby", "package"),
}
# Markers of subprojects by the beginning of their path.
ROOT_MARKERS = [("packages/", "package"), ("apps/", "app"), ("services/", "service"), ("cmd/", "command")]
# Order in which evidence of one level counts.
SOURCE_PRIORITY = ["metadata", "config", "lockfile", "dependency", "import", "runtime_call", "extension", "keyword"]

_signal = "array<struct<name:string,category:string,evidence_level:string,evidence_source:string>>"


def _lookup(key: Column, table: dict[str, tuple[str, str]], first: str, second: str) -> Column:
    chain = F
    for name, (a, b) in table.items():
        chain = chain.when(key == name, F.struct(F.lit(a).alias(first), F.lit(b).alias(second)))
    return chain


def _told(name: str, category: str, level: str, source: str) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), F.lit(level).alias("evidence_level"), F.lit(source).alias("evidence_source"))


def _rows(df: DataFrame, hits: list[Column]) -> DataFrame:
    return df.select("repo_id", "path", F.explode(F.array_distinct(F.array_compact(F.array(*hits)))).alias("s")).select("repo_id", "s.*", F.col("path").alias("source_path"))


def path_signals(files: DataFrame) -> DataFrame:
    """Signals of the names of key files."""
    name, low = F.lower(name_of(F.col("path"))), F.lower("path")
    hits = [F.when(name.isin(names), _told(shown, category, level, source)) for names, shown, category, level, source in PATH_RULES]
    hits += [F.when(name.startswith(prefix), _told(shown, category, "strong", "config")) for prefix, shown, category in PREFIX_RULES]
    hits.append(F.when(low.startswith(WORKFLOWS), _told("GitHub Actions", "ci_cd", "strong", "config")))
    return _rows(files.where("path is not null"), hits)


def entry_points(files: DataFrame) -> DataFrame:
    """(repo_id, path) of the files that start a program."""
    return files.where(F.lower(name_of(F.col("path"))).isin(ENTRY_NAMES) | F.lower("path").isin(ENTRY_PATHS)).select("repo_id", "path").distinct()


def layout_markers(files: DataFrame) -> DataFrame:
    """(repo_id, marker) by the directories that a repository has."""
    low = F.lower("path")
    marks = F.array_compact(F.array(F.when(low.startswith("packages/"), "monorepo"), F.when(low.startswith("cmd/"), "go_cmd_layout")))
    return files.select("repo_id", F.explode(marks).alias("marker")).distinct()


def content_signals(files: DataFrame) -> DataFrame:
    """Medium signals of calls that construct or run a technology, and of the word pytest; weak ones of words."""
    own = files.where("content is not null")
    hits = [F.when(F.col("content").rlike(pattern), _told(name, category, "medium", "runtime_call")) for pattern, name, category in CONSTRUCT_RULES]
    hits.append(F.when(T.contains_word(F.col("content"), "pytest"), _told("Pytest", "test_tool", "medium", "runtime_call")))
    hits += [F.when(T.contains_word(F.col("content"), word), _told(name, category, "weak", "keyword")) for word, name, category in WEAK_KEYWORDS]
    return _rows(own, hits)


def is_command_line(content: Column) -> Column:
    """Whether a content parses command lines."""
    return F.coalesce(F.lower(content).rlike(CLI_SIGNS), F.lit(False))


def services(content: Column) -> Column:
    """The outside services that a content names, in the order of the table, each once."""
    low = F.lower(T.text(content))
    return F.array_distinct(F.array_compact(F.array(*(F.when(low.contains(word), name) for word, name in SERVICES))))


def regex_values(content: Column, pattern: str) -> Column:
    """The first group of all matches, stripped, without empty ones and repeats."""
    return T.ordered_distinct(F.coalesce(F.regexp_extract_all(T.text(content), F.lit(pattern), F.lit(1)), F.array().cast("array<string>")))


def env_vars(content: Column) -> Column:
    """The first names of environment variables, pattern by pattern."""
    found = F.concat(*(regex_values(content, p) for p in ENV_PATTERNS))
    return F.slice(F.array_distinct(found), 1, MAX_ENV)


def config_identity(path: Column) -> Column:
    """struct(kind, language) of a configuration file's name; workflows are ci; null for other files."""
    known = _lookup(F.lower(name_of(path)), CONFIG_KINDS, "kind", "language")
    return known.when(F.lower(path).startswith(WORKFLOWS), F.struct(F.lit("ci").alias("kind"), F.lit("generic").alias("language")))


def entry_identity(path: Column) -> Column:
    """struct(kind, language) of an entry file's name; null for other files."""
    return _lookup(F.lower(name_of(path)), ENTRY_KINDS, "kind", "language")


def refined_kind(kind: Column, content: Column) -> Column:
    """The first kind whose words occur in the content, else the kind by name."""
    low = F.lower(T.text(content))
    chain = F
    for name, words in ENTRY_WORDS.items():
        chain = chain.when(reduce(lambda a, b: a | b, (low.contains(w) for w in words)), name)
    return chain.otherwise(kind)


def requirement_names(content: Column) -> Column:
    """Names of the dependencies that a list of requirements has on its lines."""
    lines = F.filter(F.transform(T.lines(content), T.strip), lambda x: (x != "") & ~x.startswith("#"))
    return T.ordered_distinct(F.transform(lines, lambda x: F.regexp_extract(x, r"^([^<>=\[\]~! ]*)", 1)))


def _joined(values: Column, n: int) -> Column:
    return F.array_join(F.slice(values, 1, n), ", ")


def _some(label: str, values: Column, n: int) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}："), _joined(values, n)))


def _json_keys(content: Column, field: str) -> Column:
    return F.coalesce(F.map_keys(F.from_json(F.get_json_object(content, f"$.{field}"), "map<string,string>")), F.array().cast("array<string>"))


def _toml_section(content: Column, section: str) -> Column:
    return content.rlike(rf"(?m)^\s*\[\[?{section}[\].]")


def key_points(path: Column, content: Column) -> Column:
    """What a configuration file says, by its format, as short labelled texts."""
    name = F.lower(name_of(path))
    text = T.text(content)
    values = lambda pattern: regex_values(text, pattern)
    field = lambda f: T.strip(F.get_json_object(text, f"$.{f}"))
    named = lambda label, value: F.when(value != "", F.concat(F.lit(label), value))
    package = [
        _some("定义脚本", _json_keys(text, "scripts"), 6),
        named("显式声明包管理器：", field("packageManager")),
        F.when(F.get_json_object(text, "$.workspaces[0]").isNotNull(), "声明 workspaces，仓库可能采用 monorepo 结构"),
        *(named(f"{f} 指向 ", field(f)) for f in ("main", "module", "types")),
    ]
    tsconfig = [*(named(f"{f}=", field(f"compilerOptions.{f}")) for f in ("target", "module", "jsx", "baseUrl", "rootDir", "outDir")), F.when(F.get_json_object(text, "$.compilerOptions.paths").isNotNull(), "声明路径别名映射"), named("扩展配置：", field("extends"))]
    pyproject = [
        named("声明 Python 版本要求：", F.regexp_extract(text, r"(?m)^\s*requires-python\s*=\s*[\"']([^\"']+)[\"']", 1)),
        F.when(_toml_section(text, r"project\.scripts"), "声明 project.scripts，可直接暴露命令行入口"),
        named("构建后端：", F.regexp_extract(text, r"(?m)^\s*build-backend\s*=\s*[\"']([^\"']+)[\"']", 1)),
        *(F.when(_toml_section(text, rf"tool\.{tool}"), f"检测到 {shown} 配置") for tool, shown in (("poetry", "Poetry"), ("pytest", "pytest"), ("ruff", "Ruff"), ("mypy", "Mypy"))),
    ]
    cargo = [named("Rust crate 名称：", F.regexp_extract(text, r"(?s)\[package\][^\[]*?\bname\s*=\s*\"([^\"]+)\"", 1)), F.when(_toml_section(text, "workspace"), "包含 Cargo workspace 配置"), F.when(_toml_section(text, "bin"), "声明可执行二进制目标")]
    gradle = [_some("Gradle 插件", values(r"id\s+['\"]([^'\"]+)['\"]"), 6), _some("依赖声明", values(r"(?:implementation|api|testImplementation)\s*\(?\s*['\"]([^'\"]+)['\"]"), 6), _some("主类", values(r"mainClass(?:Name)?\s*=\s*['\"]([^'\"]+)['\"]"), 1), _some("根项目名", values(r"rootProject\.name\s*=\s*['\"]([^'\"]+)['\"]"), 1)]
    pom = [_some("构建产物 artifactId", values(r"<artifactId>\s*([^<]+?)\s*</artifactId>"), 1), _some("打包类型", values(r"<packaging>\s*([^<]+?)\s*</packaging>"), 1)]
    compose = F.filter(values(r"(?m)^[ ]{2,}([A-Za-z0-9_.-]+):[ \t]*$"), lambda x: ~x.isin("services", "volumes", "networks"))
    docker = [_some("基础镜像", values(r"(?m)^\s*FROM\s+([^\s]+)"), 3), _some("暴露端口", values(r"(?m)^\s*EXPOSE\s+([^\s]+)"), 4)]
    workflow = [F.when(text.contains("on:"), "定义 GitHub Actions 触发条件"), F.when(text.contains("jobs:"), "包含自动化任务作业定义"), _some("执行环境", values(r"runs-on:\s*([A-Za-z0-9_\-]+)"), 4)]
    vite = [_some("Vite 配置包含插件或工厂调用", values(r"([A-Za-z0-9_]+)\s*\("), 5), _some("开发端口候选", values(r"\bport\s*:\s*(\d+)"), 1)]
    following = [F.when(text.contains("output:"), "声明 Next.js 输出模式"), F.when(text.contains("images:"), "声明图片域名或图片优化配置")]
    go = [_some("Go 模块名", values(r"(?m)^\s*module\s+([^\s]+)"), 1), _some("包含依赖声明", values(r"(?m)^\s*require\s+([^\s]+)"), 5)]
    composer = [F.when(F.get_json_object(text, "$.autoload").isNotNull(), "声明 Composer autoload 规则")]
    made = lambda points: F.array_compact(F.array(*points))
    return (
        F.when(name == "package.json", made(package))
        .when(name == "pyproject.toml", made(pyproject))
        .when(name == "requirements.txt", made([_some("列出运行依赖", requirement_names(text), 8)]))
        .when(name == "tsconfig.json", made(tsconfig))
        .when(name.startswith("vite.config."), made(vite))
        .when(name.startswith("next.config."), made(following))
        .when(name == "pom.xml", made(pom))
        .when(name.isin("build.gradle", "build.gradle.kts", "settings.gradle"), made(gradle))
        .when(name == "go.mod", made(go))
        .when(name == "cargo.toml", made(cargo))
        .when(name == "composer.json", made(composer))
        .when(name == "gemfile", made([_some("声明 Ruby gems", values(r"(?m)^\s*gem\s+['\"]([^'\"]+)['\"]"), 8)]))
        .when(name == "dockerfile", made(docker))
        .when(name.isin("docker-compose.yml", "docker-compose.yaml"), F.when(text.rlike(r"(?m)^\s*services:"), made([_some("定义容器服务", compose, 6)])).otherwise(F.array().cast("array<string>")))
        .when(F.lower(path).startswith(WORKFLOWS), made(workflow))
        .otherwise(F.array().cast("array<string>"))
    )


def scripts(path: Column, content: Column) -> Column:
    """The first commands that a configuration file declares."""
    name, text = F.lower(name_of(path)), T.text(content)
    declared = F.from_json(F.get_json_object(text, "$.scripts"), "map<string,string>")
    entries = F.coalesce(F.transform(F.map_entries(declared), lambda e: F.concat(e["key"], F.lit(": "), T.strip(e["value"]))), F.array().cast("array<string>"))
    commands = T.ordered_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:CMD|ENTRYPOINT)\s+.+$"), F.lit(0)), F.array().cast("array<string>")))
    steps = regex_values(text, r"run:\s*(.+)")
    chosen = F.when(name.isin("package.json", "composer.json"), F.slice(entries, 1, 6)).when(name == "dockerfile", F.slice(commands, 1, 4)).when(F.lower(path).startswith(WORKFLOWS), F.slice(steps, 1, 6))
    return chosen.otherwise(F.array().cast("array<string>"))


def config_signals(files: DataFrame) -> DataFrame:
    """(repo_id, source_path, config_kind, language_scope, key_points, scripts, services, env_vars): a row for each stored configuration file with content."""
    own = files.withColumn("__id", config_identity(F.col("path"))).where("__id is not null and content is not null and content <> ''")
    path, content = F.col("path"), F.col("content")
    return own.select("repo_id", path.alias("source_path"), F.col("__id.kind").alias("config_kind"), F.col("__id.language").alias("language_scope"), key_points(path, content).alias("key_points"), scripts(path, content).alias("scripts"), services(content).alias("services"), env_vars(content).alias("env_vars"))


def entry_summaries(files: DataFrame) -> DataFrame:
    """(repo_id, source_path, entry_kind, language_scope, is_cli, services): a row for each stored entry file with content; its kind is settled by its words."""
    own = files.withColumn("__id", entry_identity(F.col("path"))).where("__id is not null and content is not null and content <> ''")
    return own.select("repo_id", F.col("path").alias("source_path"), refined_kind(F.col("__id.kind"), F.col("content")).alias("entry_kind"), F.col("__id.language").alias("language_scope"), is_command_line(F.col("content")).alias("is_cli"), services(F.col("content")).alias("services"))


def strongest(signals: DataFrame) -> DataFrame:
    """One row for each (repo_id, category, name without case): by level, then by source; the first path of equal ones."""
    level = F.when(F.col("evidence_level") == "strong", 3).when(F.col("evidence_level") == "medium", 2).otherwise(1)
    source = F.coalesce(F.array_position(F.array(*map(F.lit, SOURCE_PRIORITY)), F.col("evidence_source")), F.lit(99))
    best = F.min_by(F.struct("name", "evidence_level", "evidence_source", "source_path"), F.struct((-level).alias("l"), source.alias("s"), F.coalesce("source_path", F.lit("")).alias("p"), "name"))
    return signals.groupBy("repo_id", "category", F.lower("name").alias("key")).agg(best.alias("b")).select("repo_id", "category", "b.*")


def sorted_signals(signals: DataFrame) -> DataFrame:
    """signals with their position: strong ones first, then by category and name."""
    level = F.when(F.col("evidence_level") == "strong", 3).when(F.col("evidence_level") == "medium", 2).otherwise(1)
    order = Window.partitionBy("repo_id").orderBy(level.desc(), "category", F.lower("name"), "name")
    return signals.withColumn("position", F.row_number().over(order))


def tech_stack(signals: DataFrame) -> DataFrame:
    """The confirmed (strong or medium) signals of each repository, or all of them where none is confirmed."""
    confirmed = F.col("evidence_level") != "weak"
    any_confirmed = F.max(confirmed).over(Window.partitionBy("repo_id"))
    return signals.withColumn("__any", any_confirmed).where(confirmed | ~F.col("__any")).drop("__any")


def subprojects(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(repo_id, root_path, language_scope, project_kind, config_paths, markers) of each directory with a file that makes it a subproject; the first path's language counts.
    contents: repo_id, path, content of the stored ones, for workspaces."""
    own = files.withColumn("__k", _lookup(F.lower(name_of(F.col("path"))), SUBPROJECT_FILES, "language", "kind")).where("__k is not null")
    root = F.coalesce(F.nullif(F.regexp_replace("path", r"/?[^/]*$", ""), F.lit("")), F.lit("."))
    held = own.groupBy("repo_id", root.alias("root_path")).agg(F.min_by("__k", "path").alias("k"), F.array_sort(F.collect_set("path")).alias("config_paths"))  # at most the table's names, in any case of letters
    shared = contents.where(F.lower("path").endswith("package.json") & F.get_json_object("content", "$.workspaces[0]").isNotNull()).select("repo_id", root.alias("root_path"), F.lit(True).alias("__w")).distinct()
    low = F.lower("root_path")
    marks = F.array_compact(F.array(*(F.when(low.startswith(prefix), marker) for prefix, marker in ROOT_MARKERS), F.when(F.col("__w"), "monorepo_workspace")))
    return held.join(shared, ["repo_id", "root_path"], "left").select("repo_id", "root_path", F.col("k.language").alias("language_scope"), F.col("k.kind").alias("project_kind"), "config_paths", marks.alias("markers"))


def entry_subprojects(entries: DataFrame, subprojects: DataFrame) -> DataFrame:
    """(repo_id, root_path, entry_paths): the entry points of each subproject; those without one are left out."""
    from repolith.operators.profile import longest_prefix

    placed = longest_prefix(entries, subprojects.select("repo_id", F.col("root_path").alias("root")), ["repo_id"], "path").where("root is not null")
    return placed.select("repo_id", F.col("root").alias("root_path"), F.col("path").alias("entry_path"))
