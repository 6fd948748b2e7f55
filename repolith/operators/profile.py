"""Profiles of repositories: technology signals by ranked evidence, facets, subprojects and longest-prefix joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import text as T

# Strength of evidence.
LEVELS = {"strong": 3, "medium": 2, "weak": 1}
# Dependency or import name, shown name, category; the first rule that fits counts.
SIGNAL_RULES = [
    ("fastapi", "FastAPI", "framework"),
    ("flask", "Flask", "framework"),
    ("django", "Django", "framework"),
    ("langchain", "LangChain", "framework"),
    ("langgraph", "LangGraph", "framework"),
    ("llama_index", "LlamaIndex", "framework"),
    ("llamaindex", "LlamaIndex", "framework"),
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
    ("openai", "OpenAI", "tool"),
    ("react", "React", "framework"),
    ("react-dom", "React", "framework"),
    ("next", "Next.js", "framework"),
    ("vue", "Vue", "framework"),
    ("vite", "Vite", "build_tool"),
    ("express", "Express", "framework"),
    ("nestjs", "NestJS", "framework"),
    ("typescript", "TypeScript", "language"),
    ("jest", "Jest", "test_tool"),
    ("vitest", "Vitest", "test_tool"),
    ("pytest", "Pytest", "test_tool"),
    ("docker", "Docker", "deploy_tool"),
]


def rule_of(reference: Column) -> Column:
    """struct(name, category) of the first rule whose key is the reference or starts it before . / - _; null where none does."""
    bare = T.normalize_ref(reference)
    chain = F
    for key, name, category in SIGNAL_RULES:
        chain = chain.when(bare == key, F.struct(F.lit(name).alias("name"), F.lit(category).alias("category")))
    for key, name, category in SIGNAL_RULES:
        begins = bare.startswith(f"{key}.") | bare.startswith(f"{key}/") | bare.startswith(f"{key}-") | bare.startswith(f"{key}_")
        chain = chain.when(begins, F.struct(F.lit(name).alias("name"), F.lit(category).alias("category")))
    special = [("@nestjs/", "NestJS"), ("react-dom", "React"), ("next/", "Next.js"), ("@vue/", "Vue")]
    for key, name in special:
        chain = chain.when(bare.startswith(key), F.struct(F.lit(name).alias("name"), F.lit("framework").alias("category")))
    return chain


def level_rank(level: Column) -> Column:
    chain = F
    for name, rank in LEVELS.items():
        chain = chain.when(level == name, rank)
    return chain.otherwise(0)


def strongest(signals: DataFrame) -> DataFrame:
    """One row for each (repo_id, category, lower(name)): the strongest evidence, the first of equal ones by seq."""
    best = F.max_by(F.struct("name", "evidence_level", "evidence_source"), F.struct(level_rank(F.col("evidence_level")), -F.col("seq")))
    return signals.groupBy("repo_id", "category", F.lower("name").alias("key")).agg(best.alias("b")).select("repo_id", "category", "b.*")


def language_signals(repos: DataFrame, files: DataFrame) -> DataFrame:
    """Signals of languages: the repository's main one (strong), those of its byte counts (medium), and file extensions (weak)."""
    main = repos.where("primary_language is not null").select(F.col("full_name").alias("repo_id"), F.col("primary_language").alias("name"), F.lit("strong").alias("evidence_level"), F.lit("metadata").alias("evidence_source"), F.lit(0).alias("seq"))
    counted = repos.select(F.col("full_name").alias("repo_id"), F.explode("languages").alias("name", "bytes")).select("repo_id", "name", F.lit("medium").alias("evidence_level"), F.lit("languages").alias("evidence_source"), F.lit(1).alias("seq"))
    ending = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    by_name = F.when(ending == "py", "Python").when(ending.isin("ts", "tsx"), "TypeScript").when(ending.isin("js", "jsx", "mjs"), "JavaScript").when(ending == "go", "Go").when(ending == "rs", "Rust").when(ending == "java", "Java")
    seen = files.select("repo_id", by_name.alias("name")).where("name is not null").distinct().select("repo_id", "name", F.lit("weak").alias("evidence_level"), F.lit("extension").alias("evidence_source"), F.lit(2).alias("seq"))
    return main.unionByName(counted).unionByName(seen).withColumn("category", F.lit("language"))


def facets(signals: DataFrame, cap: int = 20) -> DataFrame:
    """(repo_id, category, names): the distinct names of each category, strongest first, at most cap, joined by ', '."""
    order = F.array_sort(F.collect_list(F.struct((-level_rank(F.col("evidence_level"))).alias("r"), F.lower("name").alias("k"), F.col("name").alias("name"))))
    return signals.groupBy("repo_id", "category").agg(order.alias("s")).select("repo_id", "category", F.array_join(F.slice(F.array_distinct(F.transform("s", lambda x: x["name"])), 1, cap), ", ").alias("names"))


def directories(path: Column) -> Column:
    """All directories above a path, the longest first."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))


def longest_prefix(rows: DataFrame, roots: DataFrame, keys: list[str], path: str) -> DataFrame:
    """rows' keys and path with the longest root of the same repository that is the path or lies above it; '.' only where no other
    does; null where none does. keys must hold repo_id.

    The prefixes of a directory are looked up once for all of its files, in an equality join, and '.' is added per directory, so that
    a large repository is no key of its own.
    """
    known = roots.select("repo_id", "root").where("root is not null").distinct()
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    own = rows.select(*keys, path, folder.alias("__folder"))
    folders = own.select("repo_id", "__folder").distinct()
    above = folders.select("repo_id", "__folder", F.posexplode(F.concat(F.array("__folder"), directories(F.col("__folder")))).alias("__k", "root"))
    found = above.join(known.where("root <> '.'"), ["repo_id", "root"]).groupBy("repo_id", "__folder").agg(F.min_by("root", "__k").alias("__above"))
    last = known.where("root = '.'").select("repo_id", F.col("root").alias("__last"))
    placed = folders.join(found, ["repo_id", "__folder"], "left").join(last, "repo_id", "left").select("repo_id", "__folder", F.coalesce("__above", "__last").alias("__above"))
    exact = known.where("root <> '.'").withColumnRenamed("root", path).withColumn("__exact", F.col(path))
    joined = own.join(placed, ["repo_id", "__folder"], "left").join(exact, ["repo_id", path], "left")
    return joined.select(*keys, path, F.coalesce("__exact", "__above").alias("root"))


def subprojects(configs: DataFrame) -> DataFrame:
    """(repo_id, root_path, language_scope, config_count) of each directory with configuration files; the first path's language counts."""
    root = F.coalesce(F.nullif(F.col("subproject_root"), F.lit("")), F.lit("."))
    return configs.groupBy("repo_id", root.alias("root_path")).agg(F.min_by("language_scope", "source_path").alias("language_scope"), F.count(F.lit(1)).alias("config_count"))


def first_signal(signals: DataFrame) -> DataFrame:
    """The leading language of each repository: of confirmed signals if there are any, else of all."""
    confirmed = (F.col("evidence_level") != "weak").cast("int")
    order = Window.partitionBy("repo_id").orderBy(confirmed.desc(), level_rank(F.col("evidence_level")).desc(), F.lower("name"))
    return signals.withColumn("__k", F.row_number().over(order)).where("__k = 1").select("repo_id", F.col("name").alias("primary_language"))
