"""Report rows: JSON per repository, prompt excerpts, highlights, manifests and rule matches on texts."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import text as T

CONTEXT_FILES = 8
CONTEXT_CHARS = 3000
HIGHLIGHTS = 3
HIGHLIGHT_CHARS = 8


def json_reports(repos: DataFrame, documents: DataFrame) -> DataFrame:
    """(repo_id, report): one JSON object for each repository with its stars and its documents by type."""
    counts = documents.groupBy("repo_id").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("doc_type").alias("types"))
    own = repos.select(F.col("full_name").alias("repo_id"), "stargazers_count").join(counts, "repo_id", "left")
    shape = F.struct(F.col("repo_id").alias("repo"), F.coalesce("stargazers_count", F.lit(0)).alias("stars"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("types", F.lit(0)).alias("types"))
    return own.select("repo_id", F.to_json(shape).alias("report"))


def context_excerpts(key_files: DataFrame) -> DataFrame:
    """(repo_id, rank, path, excerpt): the first CONTEXT_FILES key files of each repository by size, each cut to CONTEXT_CHARS."""
    order = Window.partitionBy("repo_id").orderBy(F.desc_nulls_last("size_bytes"), "path")
    ranked = key_files.where("content is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CONTEXT_FILES)
    return ranked.select("repo_id", "rank", "path", F.substring("content", 1, CONTEXT_CHARS).alias("excerpt"))


def readme_highlights(repos: DataFrame) -> DataFrame:
    """(repo_id, rank, line): the first distinct README lines that say something: no headings, fences, quotes or short ones."""
    rows = repos.select(F.col("full_name").alias("repo_id"), F.posexplode(T.lines(F.col("readme"))).alias("k", "raw"))
    told = rows.withColumn("line", T.strip(F.col("raw"))).where(~F.col("line").rlike(r"^(?:#|```|>|\||!\[|<)") & (F.length("line") >= HIGHLIGHT_CHARS))
    first = told.groupBy("repo_id", "line").agg(F.min("k").alias("k"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy("k"))).where(F.col("rank") <= HIGHLIGHTS).select("repo_id", "rank", "line")


def package_manifests(key_files: DataFrame) -> DataFrame:
    """(repo_id, path, section, name, value) of scripts and dependencies in package.json files; invalid JSON gives no rows."""
    shape = "struct<scripts:map<string,string>,dependencies:map<string,string>,devDependencies:map<string,string>>"
    own = key_files.where(F.col("path").rlike(r"(^|/)package\.json$") & F.try_parse_json("content").isNotNull()).select("repo_id", "path", F.from_json("content", shape).alias("m"))
    sections = F.array(*(F.struct(F.lit(s).alias("section"), F.col(f"m.{s}").alias("entries")) for s in ("scripts", "dependencies", "devDependencies")))
    return own.select("repo_id", "path", F.explode(sections).alias("s")).select("repo_id", "path", F.col("s.section").alias("section"), F.explode("s.entries").alias("name", "value"))


def toml_manifests(key_files: DataFrame) -> DataFrame:
    """(repo_id, path, name, version): string versions in the dependency tables of TOML files; files that don't parse give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["repo_id", "path", "name", "version"]
        for batch in batches:
            rows = []
            for repo, path, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    tables = tomllib.loads(content)
                except (tomllib.TOMLDecodeError, RecursionError):
                    continue
                for section in ("dependencies", "deps", "dev-dependencies"):
                    held = tables.get(section)
                    for name, version in held.items() if isinstance(held, dict) else ():
                        found = version if isinstance(version, str) else version.get("version") if isinstance(version, dict) else None
                        rows.append((repo, path, name, found if isinstance(found, str) else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.string()) for c in columns], names=names)

    chosen = key_files.where("path like '%.toml' and content is not null and content <> ''").select("repo_id", "path", "content")
    return chosen.mapInArrow(run, "repo_id string, path string, name string, version string")


def hashed_embeddings(texts: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, slot, weight): the places that aren't 0 of a unit vector of hashed token counts; no rows for texts without tokens."""
    tokens = texts.select(key, F.explode(T.tokenize(F.col(text))).alias("token"))
    counts = tokens.groupBy(key, F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(dims)).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "slot", (F.col("n") / length).alias("weight"))


def chains(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, chain): all ways from the roots of at most `depth` steps over (source, target) that end or reach the depth, without
    repeated nodes, joined by ' -> '."""
    paths = roots.select(F.col("node").alias("root"), F.array("node").alias("p"))
    done = None
    for _ in range(depth):
        steps = paths.join(edges, F.element_at("p", -1) == F.col("source"), "left").withColumn("on", F.col("target").isNotNull() & ~F.array_contains("p", F.col("target")))
        ended = paths.join(edges.select(F.col("source").alias("s")).distinct(), F.element_at("p", -1) == F.col("s"), "left_anti").select("root", "p")
        done = ended if done is None else done.union(ended)
        paths = steps.where("on").select("root", F.array_append("p", F.col("target")).alias("p"))
    every = paths if done is None else done.union(paths)
    return every.select("root", F.array_join("p", " -> ").alias("chain")).distinct()
