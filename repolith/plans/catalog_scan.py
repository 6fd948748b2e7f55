"""Queries over the scanned files and repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolith.functions import text as T
from repolith.operators import scan
from repolith.sources import tables


def _quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def file_entry(spark, d):
    return scan.file_entries(tables.files(spark, d)).select("repo_id", "path", "name", "extension", "parent_dir")


def ignore_dirs(spark, d):
    return tables.files(spark, d).select("repo_id", scan.ignored_dir(F.col("path")).alias("ignored_dir")).where("ignored_dir <> ''").distinct()


def ignore_files(spark, d):
    return scan.classified(tables.files(spark, d)).where("ignored_dir = ''").groupBy("ignore_reason").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


def is_key_file(spark, d):
    return tables.files(spark, d).where(scan.is_key_file(F.col("path"))).select("repo_id", "path")


def scan_stats(spark, d):
    return scan.scan_stats(tables.files(spark, d))


def tree_preview(spark, d):
    return scan.tree_preview(tables.files(spark, d))


def top_dirs(spark, d):
    return scan.top_dirs(tables.files(spark, d))


def dir_size(spark, d):
    return scan.dir_sizes(tables.files(spark, d))


def fmt_size(spark, d):
    return tables.files(spark, d).groupBy("repo_id").agg(F.sum("size_bytes").alias("bytes")).select("repo_id", T.format_size(F.col("bytes")).alias("size"))


def check_url(spark, d):
    return tables.repos(spark, d).select("full_name", scan.is_repo_url(F.col("html_url"), "git.example").alias("valid"))


def normalize_url(spark, d):
    return tables.repos(spark, d).select("full_name", scan.repo_of_url(F.col("html_url")).alias("repo"))


def parse_repo_id(spark, d):
    return tables.repos(spark, d).select("full_name", scan.parse_repo_id(F.col("full_name")).alias("p")).select("full_name", F.col("p.owner").alias("owner"), F.col("p.name").alias("name"))


def repo_doc_counts(spark, d):
    return tables.documents(spark, d).agg(F.count_distinct("repo_id").alias("repo_count"), F.count(F.lit(1)).alias("document_count"))


def repo_latest(spark, d):
    return tables.repos(spark, d).select("full_name", "stargazers_count", "primary_language")


def key_file_sizes(spark, d):
    """Stored contents against scanned sizes of key files: a join of both tables on their key."""
    stored = tables.key_files(spark, d).select("repo_id", "path", F.length("content").cast("bigint").alias("chars"))
    return tables.files(spark, d).select("repo_id", "path", "size_bytes").join(stored, ["repo_id", "path"])


_FILES = tables.sql_with("files_once")
_REPOS = tables.sql_with("repos_once")
_NAME = "regexp_extract(path, '[^/]*$')"
_EXT = f"lower(regexp_extract({_NAME}, '.(\\.[^.]+)$', 1))"
_PRUNED = (
    "CASE WHEN len(ig) > 0 THEN array_to_string(dirs[1:list_min(ig)], '/') ELSE '' END AS ignored_dir FROM (SELECT *, list_filter(list_transform(range(1, len(dirs) + 1), "
    f"lambda k: CASE WHEN lower(dirs[k]) IN ({_quoted(scan.IGNORED_DIRS)}) THEN k END), lambda k: k IS NOT NULL) AS ig FROM (SELECT *, string_split(path, '/')[1:len(string_split(path, '/')) - 1] AS dirs FROM files_once))"
)
_REASON = f"CASE WHEN {_EXT} IN ({_quoted(scan.IGNORED_EXTENSIONS)}) THEN 'ignored_extension' WHEN size_bytes > {scan.MAX_FILE_BYTES} THEN 'file_too_large' END"
_KEY = f"(lower({_NAME}) IN ({_quoted(scan.KEY_NAMES)}) OR lower({_NAME}) LIKE '%.csproj' OR lower({_NAME}) LIKE '%.sln' OR lower(path) LIKE '{scan.WORKFLOWS}%')"
_MARKED = f"{_FILES}, marked AS (SELECT *, {_REASON} AS ignore_reason, {_KEY} AS key_file, {_PRUNED})"

QUERIES = {
    "file_entry": (file_entry, f"{_FILES} SELECT repo_id, path, {_NAME} AS name, {_EXT} AS extension, regexp_replace(regexp_replace(path, '[^/]*$', ''), '/$', '') AS parent_dir FROM files_once"),
    "ignore_dirs": (ignore_dirs, f"{_MARKED} SELECT DISTINCT repo_id, ignored_dir FROM marked WHERE ignored_dir <> ''"),
    "ignore_files": (ignore_files, f"{_MARKED} SELECT ignore_reason, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM marked WHERE ignored_dir = '' GROUP BY ignore_reason"),
    "is_key_file": (is_key_file, f"{_FILES} SELECT repo_id, path FROM files_once WHERE {_KEY}"),
    "scan_stats": (
        scan_stats,
        f"{_MARKED} SELECT repo_id, count(*) FILTER (ignored_dir = '') AS total_seen, count(*) FILTER (ignored_dir = '' AND ignore_reason IS NULL) AS kept_count, "
        "count(*) FILTER (ignored_dir = '' AND ignore_reason IS NOT NULL) + count(DISTINCT CASE WHEN ignored_dir <> '' THEN ignored_dir END) AS ignored_count, "
        "count(*) FILTER (ignored_dir = '' AND ignore_reason IS NULL AND key_file) AS key_file_count FROM marked GROUP BY repo_id",
    ),
    "tree_preview": (
        tree_preview,
        f"{_FILES} SELECT DISTINCT repo_id, array_to_string(p[1:k], '/') || CASE WHEN k < len(p) THEN '/' ELSE '' END AS entry FROM "
        "(SELECT repo_id, p, unnest(range(1, least(len(p), 2) + 1)) AS k FROM (SELECT repo_id, string_split(path, '/') AS p FROM files_once))",
    ),
    "top_dirs": (
        top_dirs,
        f"{_FILES} SELECT repo_id, split_part(path, '/', 1) AS top_dir, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM files_once WHERE path LIKE '%/%' GROUP BY 1, 2",
    ),
    "dir_size": (
        dir_size,
        f"{_FILES} SELECT repo_id, array_to_string(p[1:k], '/') AS dir, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS files FROM "
        "(SELECT repo_id, size_bytes, p, unnest(range(0, len(p))) AS k FROM (SELECT repo_id, size_bytes, string_split(path, '/') AS p FROM files_once)) GROUP BY 1, 2",
    ),
    "fmt_size": (
        fmt_size,
        f"{_FILES} SELECT repo_id, CASE WHEN b < 1024 THEN CAST(b AS BIGINT) || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0) "
        "WHEN b IS NOT NULL THEN printf('%.1f GB', b / 1073741824.0) END AS size FROM (SELECT repo_id, sum(size_bytes)::DOUBLE AS b FROM files_once GROUP BY repo_id)",
    ),
    "check_url": (check_url, f"{_REPOS} SELECT full_name, coalesce(regexp_full_match(trim(html_url), '(?i)https?://(www\\.)?git\\.example/[\\w\\-]+/[\\w\\-.]+(/.*)?'), false) AS valid FROM repos_once"),
    "normalize_url": (
        normalize_url,
        f"{_REPOS} SELECT full_name, CASE WHEN len(p) >= 2 THEN p[1] || '/' || regexp_replace(p[2], '\\.git$', '') END AS repo FROM "
        "(SELECT full_name, list_filter(string_split(regexp_replace(trim(html_url), '^[a-zA-Z]+://[^/]*|[?#].*$', '', 'g'), '/'), lambda x: x <> '') AS p FROM repos_once)",
    ),
    "parse_repo_id": (
        parse_repo_id,
        f"{_REPOS} SELECT full_name, CASE WHEN ok THEN p[1] END AS owner, CASE WHEN ok THEN p[2] END AS name FROM (SELECT full_name, p, len(p) = 2 AND len(list_filter(p, lambda x: trim(x) IN ('', '.', '..'))) = 0 AS ok "
        "FROM (SELECT full_name, string_split(trim(full_name), '/') AS p FROM repos_once))",
    ),
    "repo_doc_counts": (repo_doc_counts, f"{tables.sql_with('documents_once')} SELECT count(DISTINCT repo_id) AS repo_count, count(*) AS document_count FROM documents_once"),
    "repo_latest": (repo_latest, f"{_REPOS} SELECT full_name, stargazers_count, primary_language FROM repos_once"),
    "join_source_lookup": (
        key_file_sizes,
        f"{tables.sql_with('files_once', 'key_files_once')} SELECT f.repo_id, f.path, f.size_bytes, length(k.content) AS chars FROM files_once f JOIN key_files_once k ON f.repo_id = k.repo_id AND f.path = k.path",
    ),
}
