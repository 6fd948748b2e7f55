"""Traces against a greedy walk, chains and lines as round trips, the vector index against all pairs, arguments and signals on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from repolith.functions import text as T
from repolith.operators import answers, signals, trace, vectors

DOCS = "repo_id string, doc_id string, doc_type string, source_path string, title string, content string, metadata map<string,array<string>>"


def docs_of(spark, calls, extra=()):
    rows = [("r", f"r::function_summary::{name}.py::K.{name}", "function_summary", f"{name}.py", name, "text", {"called_symbols": list(called), "line_start": ["3"]}) for name, called in calls.items()]
    return spark.createDataFrame([*rows, *extra], DOCS)


def greedy(calls, root, max_steps=6, max_depth=2):
    """Breadth first from the root over the names that are called."""
    order, queue, seen, used = [(root, 0, None)], [(root, 0)], {root}, 0
    while queue:
        name, depth = queue.pop(0)
        if depth >= max_depth:
            continue
        for called in dict.fromkeys(calls[name]):
            if used < max_steps and called in calls and called not in seen:
                seen.add(called)
                used += 1
                order.append((called, depth + 1, name))
                queue.append((called, depth + 1))
    return order


def test_traces_are_the_greedy_walk(spark):
    random.seed(4)
    names = [f"n{k}" for k in range(12)]
    calls = {n: random.sample([*names, "unknown"], random.randrange(0, 5)) for n in names}
    calls = {n: [c for c in called if c != n] for n, called in calls.items()}
    docs = docs_of(spark, calls)
    own = lambda n: f"r::function_summary::{n}.py::K.{n}"
    roots = spark.createDataFrame([(n, own(n)) for n in names], "query_id string, doc_id string")
    got = {}
    for row in trace.traces(roots, docs).orderBy("query_id", "step").collect():
        got.setdefault(row.query_id, []).append((row.doc_id, row.depth, row.parent_doc))
    for n in names:
        want = [(own(a), depth, parent and own(parent)) for a, depth, parent in greedy(calls, n)]
        assert got[n] == want, n


def test_the_own_file_and_the_type_decide_between_equal_names(spark):
    extra = [
        ("r", "r::class_summary::a.py::other", "class_summary", "a.py", "", "symbols: run, stop", {}),
        ("r", "r::function_body_chunk::z.py::run", "function_body_chunk", "z.py", "", "", {}),
        ("s", "s::function_body_chunk::a.py::run", "function_body_chunk", "a.py", "", "", {}),
        ("r", "r::x", None, None, None, None, None),
    ]
    docs = docs_of(spark, {"a": ["run"]}, extra)
    got = [(r.next_doc, r["match"], r["rank"]) for r in trace.followed(docs).where("doc_id like '%K.a'").orderBy("rank").collect()]
    assert got == [("r::class_summary::a.py::other", 6, 1), ("r::function_body_chunk::z.py::run", 6, 2)]
    assert trace.followed(docs.limit(0)).count() == 0


def test_targets_by_document_type(spark):
    meta = {"code_relation_targets": ["K.m", "P", "svc.run"], "code_relation_types": ["define_method", "inherit", "delegate_service"], "called_symbols": ["svc.run"], "module_relation_targets": ["os"], "handler_name": ["h"]}
    rows = [("r", kind, kind, "a", "", "", meta) for kind in ("class_summary", "function_summary", "key_file_summary", "api_route_summary")]
    got = {}
    for r in trace.follow_targets(spark.createDataFrame(rows, DOCS)).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.target_ref, r.relation_type))
    assert got["class_summary"] == [("K.m", "define_method"), ("svc.run", "call")]
    assert got["function_summary"] == [("svc.run", "delegate_service"), ("svc.run", "call")]
    assert got["key_file_summary"][0] == ("os", "import_module") and ("K.m", "define_method") in got["key_file_summary"]
    assert ("h", "handle_route") in got["api_route_summary"]


def test_lines_and_chains_are_read_back(spark):
    docs = docs_of(spark, {"a": ["b"], "b": []})
    roots = spark.createDataFrame([("q", "r::function_summary::a.py::K.a")], "query_id string, doc_id string")
    lines = trace.trace_lines(trace.traces(roots, docs), docs)
    got = [tuple(r) for r in trace.parsed_lines(lines, ["step"], "line").orderBy("step").collect()]
    assert got == [(0, 0, "", "K.a", "", "a.py:L3"), (1, 1, "call", "K.b", "K.a", "b.py:L3")]
    assert trace.parsed_lines(spark.createDataFrame([(1, "no step"), (2, None)], "step int, line string"), ["step"], "line").count() == 0
    one = spark.createDataFrame([(["GET /a", "b.c", "d"], ["handle_route", None])], "l array<string>, t array<string>").select(trace.typed_chain(F.col("l"), F.col("t")).alias("c"), trace.chain_score(F.col("l")).alias("s"))
    row = one.select("c", "s", trace.parsed_chain(F.col("c")).alias("p")).first()
    assert row.c == "GET /a -[handle_route]-> b.c -> d" and row.s == 22
    assert [tuple(x) for x in row.p] == [("GET /a", "handle_route", "b.c"), ("b.c", None, "d")]


def test_representative_steps(spark):
    steps = spark.createDataFrame([("q", k, t) for k, t in enumerate([None, "call", "call", "handle_route", None, "call"])] + [("p", 0, None), ("p", 1, "call")], "id string, step int, relation_type string")
    got = {}
    for r in trace.representative_steps(steps, ["id"], 4).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r.step)
    assert got == {"q": [0, 5, 3, 4], "p": [0, 1]}


@pytest.mark.parametrize(
    ("text", "parts"),
    [("a, b", ["a", "b"]), ("f(x, y), [1, 2], {a: 1}", ["f(x, y)", "[1, 2]", "{a: 1}"]), ("'a, b', \"c\\\", d\"", ["'a, b'", '"c\\", d"']), ("", []), (" , a,", ["a"]), (None, []), ("x = ')', y", ["x = ')'", "y"])],
)
def test_arguments_are_split_at_the_top_level(spark, text, parts):
    assert spark.createDataFrame([(text,)], "a string").select(T.split_arguments(F.col("a")).alias("p")).first().p == parts


def test_index_finds_nine_of_ten_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    points = centres[rng.integers(0, 30, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    points[2000:] = points[7] + 0.05 * rng.normal(size=(1000, 16))  # a third of all rows in one place
    rows = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)] + [(5000, None), (5001, [0.0] * 16)], "vec_id bigint, embedding array<double>").repartition(4)
    queries = rows.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in vectors.nearest(rows, queries, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in vectors.candidates(rows, queries, 10).collect()}
    assert len(exact) == 1500 and len(exact & found) / len(exact) >= 0.9
    assert not any(v in (5000, 5001) for pair in exact | found for v in pair)
    assert vectors.candidates(rows.limit(0), queries, 3).count() == 0


def test_upserts_and_deletes(spark):
    stored = spark.createDataFrame([("a", "r", 1), ("b", "s", 1)], "doc_id string, repo_id string, n int")
    new = spark.createDataFrame([("a", "r", 2), ("a", "r", 3), ("c", "r", 1)], "doc_id string, repo_id string, n int")
    assert {tuple(r) for r in vectors.upserted(stored, new, "doc_id").collect()} == {("a", "r", 3), ("b", "s", 1), ("c", "r", 1)}
    gone = spark.createDataFrame([("s",), (None,), ("s",)], "repo_id string")
    assert {r.doc_id for r in vectors.deleted(stored, gone).collect()} == {"a"}


def test_signals_of_contents_and_names(spark):
    text = "app = FastAPI()\nuvicorn.run(app)\n# redis and Pytest\nkey = process.env.API_KEY or os.getenv('DB_URL')\n"
    files = spark.createDataFrame([("r", "src/App.py", text), ("r", "n.py", None), ("r", "e.py", ""), ("r", "packages/x/package.json", '{"scripts": {"dev": "vite"}, "packageManager": "pnpm@9", "workspaces": ["a"]}')], "repo_id string, path string, content string")
    got = {(r.name, r.evidence_level) for r in signals.content_signals(files).collect()}
    assert got >= {("FastAPI", "medium"), ("Uvicorn", "medium"), ("Pytest", "medium"), ("Redis", "weak"), ("FastAPI", "weak")}
    row = files.where("path = 'src/App.py'").select(signals.env_vars(F.col("content")).alias("e"), signals.services(F.col("content")).alias("s"), signals.refined_kind(F.lit("cli"), F.col("content")).alias("k")).first()
    assert row.e == ["API_KEY", "DB_URL"] and row.s == ["Redis"] and row.k == "web_api"
    config = signals.config_signals(files).first()
    assert config.key_points == ["定义脚本：dev", "显式声明包管理器：pnpm@9", "声明 workspaces，仓库可能采用 monorepo 结构"] and config.scripts == ["dev: vite"]
    assert [(r.root_path, list(r.markers)) for r in signals.subprojects(files, files).collect()] == [("packages/x", ["package", "monorepo_workspace"])]
    best = {(r.name, r.evidence_level) for r in signals.strongest(signals.content_signals(files)).collect()}
    assert ("FastAPI", "medium") in best and ("FastAPI", "weak") not in best
    assert signals.path_signals(files.limit(0)).count() == 0


def test_config_formats(spark):
    texts = {
        "pyproject.toml": ('[project]\nrequires-python = ">=3.12"\n[project.scripts]\na = "b"\n[tool.ruff]\n', ["声明 Python 版本要求：>=3.12", "声明 project.scripts，可直接暴露命令行入口", "检测到 Ruff 配置"]),
        "requirements.txt": ("# x\nflask>=2\nrequests[socks]==1\n", ["列出运行依赖：flask, requests"]),
        "Dockerfile": ("FROM a:1\nEXPOSE 80\nCMD run\n", ["基础镜像：a:1", "暴露端口：80"]),
        "go.mod": ("module m\nrequire a v1\n", ["Go 模块名：m", "包含依赖声明：a"]),
        "Cargo.toml": ('[package]\nname = "c"\n[[bin]]\n', ["Rust crate 名称：c", "声明可执行二进制目标"]),
        "build.gradle": ("plugins { id 'java' }\nimplementation 'a:b:1'\n", ["Gradle 插件：java", "依赖声明：a:b:1"]),
        "docker-compose.yml": ("services:\n  web:\n    image: x\n", ["定义容器服务：web"]),
        ".github/workflows/ci.yml": ("on: push\njobs:\n  a:\n    runs-on: ubuntu\n    steps:\n      - run: make\n", ["定义 GitHub Actions 触发条件", "包含自动化任务作业定义", "执行环境：ubuntu"]),
        "tsconfig.json": ('{"compilerOptions": {"target": "es2022"}, "extends": "./base"}', ["target=es2022", "扩展配置：./base"]),
        "pom.xml": ("<project><artifactId>x</artifactId><packaging>jar</packaging></project>", ["构建产物 artifactId：x", "打包类型：jar"]),
    }
    files = spark.createDataFrame([("r", path, content) for path, (content, _) in texts.items()], "repo_id string, path string, content string")
    got = {r.source_path: list(r.key_points) for r in signals.config_signals(files).collect()}
    assert got == {path: points for path, (_, points) in texts.items()}


def test_evidence_helpers(spark):
    row = spark.createDataFrame([(["a。", "无", "  ", "b;"], ["x", "y"], ["y", "", "z"], ["One", "Two", "Three", "Four"], "has two here")], "items array<string>, a array<string>, b array<string>, v array<string>, t string")
    got = row.select(answers.cleaned_items(F.col("items")).alias("i"), answers.merged_evidence(F.col("a"), F.col("b")).alias("m"), answers.related_values(F.col("v"), F.col("t")).alias("r"), answers.related_values(F.col("v"), F.lit(None).cast("string")).alias("n")).first()
    assert got.i == ["a", "b"] and got.m == ["x", "y", "z"] and got.r == ["Two"] and got.n == ["One", "Two", "Three"]
