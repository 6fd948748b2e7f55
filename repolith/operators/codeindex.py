"""Code rows from stored contents: symbols and module relations of Python, JavaScript/TypeScript, Go and Rust.

Line rules are regular expressions in the JVM; only the syntax trees of Python need Python, and are read inside the scan's partitions.
Null and empty contents give no rows; contents that don't parse fall back to the line rules.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions.text import strip

LINE_END = r"\r\n|[\n\r]"

# Per language the line rules: kind of row, what it is, and the pattern whose first group is the name.
SYMBOL_RULES = {
    "py": [("class", r"^class\s+([A-Za-z_]\w*)"), ("function", r"^(?:async\s+)?def\s+([A-Za-z_]\w*)"), ("method", r"^\s+(?:async\s+)?def\s+([A-Za-z_]\w*)")],
    "js": [("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^()]*\)\s*=>"), ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)")],
    "rs": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)")],
}
RELATION_RULES = {
    "py": [("import", r"^\s*import\s+([\w.]+)"), ("import", r"^\s*from\s+([\w.]+)\s+import\b")],
    "js": [("import", r"^\s*import\s+(?:[^'\"]*?\s+from\s+)?['\"]([^'\"]+)['\"]"), ("require", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)")],
    "go": [("import", r"^\s*(?:import\s+)?(?:[A-Za-z_.]\w*\s+)?\"([^\"]+)\"$")],
    "rs": [("use", r"^\s*(?:pub\s+)?use\s+([^;{]+?)(?:::)?\s*[;{]")],
}

# Suffixes of the indexed languages.
SUFFIXES = {"py": ["py"], "js": ["js", "jsx", "ts", "tsx", "mjs"], "go": ["go"], "rs": ["rs"]}


def is_language(path: Column, language: str) -> Column:
    return path.rlike(r"\.(?:" + "|".join(SUFFIXES[language]) + ")$")


def of_language(files: DataFrame, language: str) -> DataFrame:
    return files.where(is_language(F.col("path"), language))


def numbered_lines(files: DataFrame) -> DataFrame:
    """repo_id, path, line_number and line of each line."""
    parts = F.split(F.coalesce("content", F.lit("")), LINE_END, -1)
    return files.where("content is not null and content <> ''").select("repo_id", "path", F.posexplode(parts).alias("k", "line")).select("repo_id", "path", (F.col("k") + 1).alias("line_number"), "line")


def _ruled(files: DataFrame, rules: list[tuple[str, str]], kind: str, name: str) -> DataFrame:
    chain: Column = F
    for what, pattern in rules:
        chain = chain.when(F.regexp_extract("line", pattern, 1) != "", F.struct(F.lit(what).alias("kind"), strip(F.regexp_extract("line", pattern, 1)).alias("name")))
    found = numbered_lines(files).withColumn("__row", chain).where("__row is not null")
    return found.select("repo_id", "path", F.col("__row.kind").alias(kind), F.col("__row.name").alias(name), "line_number")


def line_kinds(path: Column, content: Column, rules: dict[str, list[tuple[str, str]]]) -> Column:
    """What the lines of a file are by the rules of its language, in order, without lines that no rule takes; empty for other files. As many values as _ruled gives rows."""
    none = F.array().cast("array<string>")

    def kinds(own: list[tuple[str, str]]) -> Column:
        def kind(line: Column) -> Column:
            chain: Column = F
            for what, pattern in own:
                chain = chain.when(F.regexp_extract(line, pattern, 1) != "", F.lit(what))
            return chain

        return F.filter(F.transform(F.split(content, LINE_END, -1), kind), lambda k: k.isNotNull())

    chain: Column = F
    for language, own in rules.items():
        chain = chain.when(is_language(path, language), kinds(own))
    return F.coalesce(chain, none)


def symbols(files: DataFrame, language: str) -> DataFrame:
    """(repo_id, path, symbol_type, name, line_number), one row for each line that defines a symbol."""
    return _ruled(of_language(files, language), SYMBOL_RULES[language], "symbol_type", "name")


def relations(files: DataFrame, language: str) -> DataFrame:
    """(repo_id, path, relation_type, target, line_number), one row for each line that names another module."""
    return _ruled(of_language(files, language), RELATION_RULES[language], "relation_type", "target")


def _calls(node: ast.AST) -> list[str]:
    names: dict[str, None] = {}
    for inner in ast.walk(node):
        if isinstance(inner, ast.Call):
            try:
                names[ast.unparse(inner.func)] = None
            except (ValueError, RecursionError):
                continue
    return list(names)


#: Line rules of Python as the JVM reads them, for contents without a tree.
_python_rules = [(kind, re.compile(pattern, re.ASCII)) for kind, pattern in SYMBOL_RULES["py"]]
_line_end = re.compile(LINE_END)
_listed = re.compile(r"\(([^)]*)\)")


def _ruled_symbols(content: str) -> Iterator[tuple[str, str, int, list[str]]]:
    """(symbol_type, name, line_number, parameters) by the line rules."""
    for number, line in enumerate(_line_end.split(content), 1):
        for kind, pattern in _python_rules:
            if m := pattern.match(line):
                listed = _listed.search(line, m.end()) if kind != "class" else None
                names = [p.split(":")[0].split("=")[0].strip() for p in listed.group(1).split(",")] if listed else []
                yield kind, m.group(1), number, [n for n in names if n.isidentifier()]
                break


def python_trees(files: DataFrame, max_calls: int = 12) -> DataFrame:
    """Functions, methods and classes of Python files from their syntax trees: (repo_id, path, symbol_type, qualified_name, line_start,
    line_end, parameters, called_symbols). Files that don't parse give a row for each line that the line rules find, without calls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore")
        kinds = [("repo_id", pa.string()), ("path", pa.string()), ("symbol_type", pa.string()), ("qualified_name", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("parameters", pa.list_(pa.string())), ("called_symbols", pa.list_(pa.string()))]
        for batch in batches:
            rows: list[tuple] = []
            for repo, path, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    tree = ast.parse(content)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    rows += [(repo, path, kind, name, number, number, names, []) for kind, name, number, names in _ruled_symbols(content)]
                    continue
                stack: list[tuple[ast.AST, str]] = [(n, "") for n in reversed(tree.body)]
                while stack:
                    node, owner = stack.pop()
                    if isinstance(node, ast.ClassDef):
                        rows.append((repo, path, "class", owner + node.name, node.lineno, node.end_lineno, [], []))
                        stack += [(n, f"{owner}{node.name}.") for n in reversed(node.body)]
                    elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        args = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
                        rows.append((repo, path, "method" if owner else "function", owner + node.name, node.lineno, node.end_lineno, args, _calls(node)[:max_calls]))
                    elif isinstance(node, (ast.stmt, ast.ExceptHandler, ast.match_case)):
                        stack += [(n, owner) for n in reversed(list(ast.iter_child_nodes(node))) if isinstance(n, (ast.stmt, ast.ExceptHandler, ast.match_case))]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    chosen = of_language(files, "py").where("content is not null and content <> ''").select("repo_id", "path", "content")
    return chosen.mapInArrow(run, "repo_id string, path string, symbol_type string, qualified_name string, line_start int, line_end int, parameters array<string>, called_symbols array<string>")


def symbol_role(name: Column) -> Column:
    """repository, service or handler by the substrings of a name, the first that holds; null for none."""
    low = F.lower(name)
    return F.when(low.rlike("repository|repo|dao"), "repository").when(low.rlike("service|svc"), "service").when(low.rlike("handler|controller|view|endpoint"), "handler")


def call_relation(name: Column) -> Column:
    role = symbol_role(name)
    return F.when(role == "repository", "delegate_repository").when(role == "service", "delegate_service").otherwise("call")


def role_priority(name: Column) -> Column:
    role = symbol_role(name)
    return F.when(role == "repository", 4).when(role == "service", 3).when(role == "handler", 2).otherwise(0)
