"""Knowledge documents built from rows: one select each, united by name. Ids are repository, type, path and qualifier joined by '::'."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import text as T

TEXT_CHARS = 2000
CHUNK_CHARS = 1800
CHUNK_LINES = 24
CONFIG_LINES = 40
EMPTY = "<空内容>"


def doc_id(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def joined(values: Column, nothing: str = "无") -> Column:
    """Distinct stripped values joined by ', '."""
    return F.coalesce(F.nullif(F.array_join(T.ordered_distinct(values), ", "), F.lit("")), F.lit(nothing))


def _document(df: DataFrame, kind: str, ident: Column, title: Column, content: Column, path: Column) -> DataFrame:
    return df.select(ident.alias("doc_id"), "repo_id", F.lit(kind).alias("doc_type"), title.alias("title"), content.alias("content"), path.alias("source_path"))


def lines_text(heading: Column, *lines: tuple[str, Column]) -> Column:
    """A heading and 'label：value' lines."""
    return F.concat_ws("\n", heading, *(F.concat(F.lit(f"{label}："), F.coalesce(value.cast("string"), F.lit(""))) for label, value in lines))


def or_none(value: Column, nothing: str = "无") -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(nothing))


def _title(of: str, what: str) -> Column:
    return F.concat("repo_id", F.lit("::"), of, F.lit(f" {what}"))


def capped(rows: DataFrame, keys: list[str], value: str, cap: int, name: str) -> DataFrame:
    """keys and the first `cap` different values in order, joined by ', '. Ranked before they are collected, so that a group never holds more."""
    once = rows.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    ranked = once.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("__n") <= cap)
    return ranked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), ", ").alias(name))


#: Facets of a repository by category, in the order of their lines.
FACETS = {"language": "languages", "framework": "frameworks", "runtime": "runtimes", "build_tool": "build_tools", "package_manager": "package_managers", "test_tool": "test_tools", "ci_cd": "ci_cd_tools", "deploy_tool": "deploy_tools"}
LISTED = 50


def profiles(repos: DataFrame, signals: DataFrame, entries: DataFrame, subprojects: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """A row for each repository with its facets of confirmed technologies, entry points, subprojects, and the numbers of its symbols and relations.

    signals: the strongest of each technology; subprojects: repo_id, root_path, language_scope, project_kind.
    """
    own = repos.select(F.col("full_name").alias("repo_id"), "default_branch", "primary_language", "topics", "license_name", "stargazers_count")
    told = signals.where("evidence_level <> 'weak'")
    facets = told.groupBy("repo_id").agg(*(F.array_join(F.array_sort(F.collect_set(F.when(F.col("category") == c, F.col("name")))), ", ").alias(n) for c, n in FACETS.items()), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("stack"))  # as many as the rules know
    described = subprojects.select("repo_id", F.concat("root_path", F.lit("("), "language_scope", F.lit("/"), "project_kind", F.lit(")")).alias("sub"))
    joined = own.join(facets, "repo_id", "left").join(capped(entries, ["repo_id"], "path", LISTED, "entrypoints"), "repo_id", "left").join(capped(described, ["repo_id"], "sub", LISTED, "subprojects"), "repo_id", "left")
    counts = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    return joined.join(counts(symbols, "symbols"), "repo_id", "left").join(counts(relations, "relations"), "repo_id", "left")


def repo_summaries(profiles: DataFrame) -> DataFrame:
    """What a repository is made of, one document each."""
    content = lines_text(
        F.concat(F.lit("仓库 "), F.col("repo_id"), F.lit(" 的项目概览。")),
        ("主语言", or_none(F.col("primary_language"), "未识别")), ("技术栈", or_none(F.col("stack"))), ("框架", or_none(F.col("frameworks"))), ("运行时", or_none(F.col("runtimes"))), ("构建工具", or_none(F.col("build_tools"))),
        ("包管理器", or_none(F.col("package_managers"))), ("入口文件", or_none(F.col("entrypoints"))), ("子项目", or_none(F.col("subprojects"))), ("关键符号数量", F.coalesce("symbols", F.lit(0))), ("模块依赖关系数量", F.coalesce("relations", F.lit(0))),
    )
    return _document(profiles, "repo_summary", doc_id(F.col("repo_id"), F.lit("repo_summary")), F.concat("repo_id", F.lit(" 仓库摘要")), content, F.lit(None).cast("string"))


def repo_facts(profiles: DataFrame) -> DataFrame:
    """key: value lines of a repository."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    facets = [line(n, or_none(F.col(n))) for n in FACETS.values()]
    content = F.concat_ws(
        "\n", line("repo_id", F.col("repo_id")), line("default_branch", T.text(F.col("default_branch"))), line("primary_language", or_none(F.col("primary_language"), "未指定")), *facets,
        line("entrypoints", or_none(F.col("entrypoints"))), line("subprojects", or_none(F.col("subprojects"))), line("topics", joined(F.col("topics"))), line("stars", F.coalesce(F.col("stargazers_count").cast("string"), F.lit("0"))), line("license", or_none(F.col("license_name"))),
    )
    return _document(profiles, "repo_fact", doc_id(F.col("repo_id"), F.lit("repo_fact")), F.concat("repo_id", F.lit(" 仓库事实")), content, F.lit(None).cast("string"))


def readme_summaries(repos: DataFrame) -> DataFrame:
    """The first TEXT_CHARS characters of each README that isn't blank, behind two lines that say so."""
    own = repos.where(T.strip(T.text(F.col("readme"))) != "").withColumn("repo_id", F.col("full_name"))
    content = F.concat(F.lit("仓库 "), "repo_id", F.lit(" 的 README 摘要候选内容。\n以下内容来自 README 原文截断，可用于后续检索与 LLM 精炼。\n\n"), F.substring(T.strip(F.col("readme")), 1, TEXT_CHARS))
    return _document(own, "readme_summary", doc_id(F.col("repo_id"), F.lit("readme_summary")), F.concat("repo_id", F.lit(" README 摘要")), content, F.lit("README"))


def config_documents(configs: DataFrame) -> DataFrame:
    """Labelled lines of each configuration file's summary."""
    content = lines_text(
        F.concat(F.lit("仓库 "), F.col("repo_id"), F.lit(" 的配置摘要。")),
        ("来源文件", F.col("source_path")), ("配置类型", T.text(F.col("config_kind"))), ("语言范围", T.text(F.col("language_scope"))), ("所属子项目", or_none(F.col("subproject_root"))), ("包管理器", joined(F.col("package_managers"))), ("关键结论", joined(F.col("key_points"))),
        ("脚本或命令", joined(F.col("scripts_or_commands"))), ("外部服务依赖", joined(F.col("service_dependencies"))), ("环境变量", joined(F.col("env_vars"))), ("摘要", T.text(F.col("summary"))),
    )
    return _document(configs, "config_summary", doc_id(F.col("repo_id"), F.lit("config_summary"), F.col("source_path")), _title("source_path", "配置摘要"), content, F.col("source_path"))


def config_chunks(configs: DataFrame, key_files: DataFrame) -> DataFrame:
    """The first CONFIG_LINES numbered lines of each summarised configuration file that has content, behind what its summary says."""
    own = configs.join(key_files.select("repo_id", F.col("path").alias("source_path"), "content"), ["repo_id", "source_path"])
    chunk = T.numbered(F.col("content"), F.lit(1), F.lit(CONFIG_LINES), CONFIG_LINES, CHUNK_CHARS)
    made = own.withColumn("chunk", chunk).where("chunk <> ''")
    content = F.concat(
        lines_text(
            F.concat(F.lit("仓库 "), F.col("repo_id"), F.lit(" 中的配置文件片段。")),
            ("来源文件", F.col("source_path")), ("配置类型", T.text(F.col("config_kind"))), ("语言范围", T.text(F.col("language_scope"))), ("所属子项目", or_none(F.col("subproject_root"))), ("脚本或命令", joined(F.col("scripts_or_commands"))), ("环境变量", joined(F.col("env_vars"))),
        ),
        F.lit("\n配置片段：\n```text\n"), F.col("chunk"), F.lit("\n```"),
    )
    return _document(made, "config_chunk", doc_id(F.col("repo_id"), F.lit("config_chunk"), F.col("source_path")), _title("source_path", "配置片段"), content, F.col("source_path"))


def key_file_documents(key_files: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Size, truncation, symbols, relations and the first TEXT_CHARS characters of each key file. symbols, relations: repo_id, path and text."""
    body = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.lit(EMPTY))
    cut = F.coalesce("truncated", F.lit(False)) | (F.length(body) > TEXT_CHARS)
    own = key_files.join(capped(symbols, ["repo_id", "path"], "text", 8, "symbol_text"), ["repo_id", "path"], "left").join(capped(relations, ["repo_id", "path"], "text", 8, "relation_text"), ["repo_id", "path"], "left")
    head = F.concat(F.lit("仓库 "), F.col("repo_id"), F.lit(" 的关键文件 "), F.col("path"), F.lit(" 摘要候选内容。\n文件大小："), T.text(F.col("size_bytes").cast("string")), F.lit(" 字节。\n是否截断："), F.when(cut, "是").otherwise("否"), F.lit("。\n关键符号："), or_none(F.col("symbol_text")), F.lit("。\n模块依赖："), or_none(F.col("relation_text")), F.lit("。"))
    content = F.concat(head, F.lit("\n以下内容来自关键文件原文截断，可用于后续检索与 LLM 精炼。\n\n"), F.substring(body, 1, TEXT_CHARS))
    return _document(own, "key_file_summary", doc_id(F.col("repo_id"), F.lit("key_file"), F.col("path")), F.concat("repo_id", F.lit("::"), "path"), content, F.col("path"))


def subproject_documents(subprojects: DataFrame, entries: DataFrame) -> DataFrame:
    """Language, kind, markers, configurations and entry points of each subproject. entries: repo_id, root_path, entry_path."""
    own = subprojects.join(capped(entries, ["repo_id", "root_path"], "entry_path", LISTED, "entry_text"), ["repo_id", "root_path"], "left")
    content = lines_text(
        F.concat(F.lit("仓库 "), F.col("repo_id"), F.lit(" 的子项目摘要。")),
        ("子项目根目录", F.col("root_path")), ("语言范围", F.col("language_scope")), ("子项目类型", F.col("project_kind")), ("子项目标签", joined(F.col("markers"))), ("配置文件", joined(F.col("config_paths"))), ("入口文件", or_none(F.col("entry_text"))),
    )
    return _document(own, "subproject_summary", doc_id(F.col("repo_id"), F.lit("subproject_summary"), F.col("root_path")), _title("root_path", "子项目摘要"), content, F.col("root_path"))


def entrypoint_documents(entries: DataFrame) -> DataFrame:
    """Kind, language and outside services of each entry file. entries: the rows of signals.entry_summaries with subproject_root."""
    content = lines_text(
        F.concat(F.lit("仓库 "), F.col("repo_id"), F.lit(" 的入口摘要。")),
        ("来源文件", F.col("source_path")), ("入口类型", F.col("entry_kind")), ("语言范围", F.col("language_scope")), ("所属子项目", or_none(F.col("subproject_root"))), ("外部服务依赖", joined(F.col("services"))),
    )
    return _document(entries, "entrypoint_summary", doc_id(F.col("repo_id"), F.lit("entrypoint_summary"), F.col("source_path")), _title("source_path", "入口摘要"), content, F.col("source_path"))


def union(*documents: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, documents)


# Metadata fields that are embedded, in their order.
EMBEDDED_FIELDS = [
    "project_type", "primary_language", "languages", "frameworks", "runtimes", "build_tools", "package_managers", "entrypoints", "subproject_root", "subproject_roots", "code_symbol_names", "module_relation_targets", "api_route_paths", "api_handler_names", "function_names",
    "class_names", "route_path", "http_methods", "handler_name", "handler_qualified_name", "symbol_name", "qualified_name", "owner_class", "called_symbols", "class_methods", "signature", "config_env_vars", "config_scripts_or_commands", "entrypoint_startup_commands",
]


def embedding_text(documents: DataFrame) -> Column:
    """What is embedded of a document: title, type, repository and path, the chosen metadata fields that have values, and the body, a line each."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    field = lambda f: F.nullif(F.array_join(T.ordered_distinct(F.try_element_at("metadata", F.lit(f))), ", "), F.lit(""))
    parts = [line("标题", T.text(F.col("title"))), line("类型", T.text(F.col("doc_type"))), line("仓库", T.text(F.col("repo_id"))), line("路径", F.nullif(F.col("source_path"), F.lit("")))]
    return F.concat_ws("\n", *parts, *(line(f, field(f)) for f in EMBEDDED_FIELDS), F.lit("正文:"), T.text(F.col("content")))


def write(documents: DataFrame, path: str) -> None:
    """One partition for each repository; writing a repository again replaces only its own partition."""
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def read(spark, path: str, repo_id: str | None = None) -> DataFrame:
    """All documents, or those of one repository, of which only the partition is read."""
    everything = spark.read.parquet(path)
    return everything if repo_id is None else everything.where(F.col("repo_id") == repo_id)


def delete(spark, path: str, repo_id: str) -> bool:
    """Removes one repository's partition from a store; whether there was one."""
    name = "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^" or ord(c) < 32 or ord(c) == 127 else c for c in repo_id)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/repo_id={name}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
