"""Operators on small tables with nulls, repeated rows, ties, empty tables and extra columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from repolith.operators import answers, assets, codeindex, documents, graph, profile, scan, search, vectors
from repolith.sources.tables import latest
from repolith.streaming import ingest

DOC = "doc_id string, repo_id string, doc_type string, title string, content string, source_path string, metadata map<string,array<string>>, indexed_at timestamp"
T0 = dt.datetime(2025, 1, 1)


def docs(spark, rows):
    return spark.createDataFrame([(*r, T0) for r in rows], DOC)


@pytest.fixture()
def library(spark):
    return docs(
        spark,
        [
            ("a::function_summary::app/login.py::load_user", "a", "function_summary", "load_user", "def load_user reads the session", "app/login.py", {"called_symbols": ["repo.find_user", None, " "]}),
            ("a::function_summary::app/repo.py::find_user", "a", "function_summary", "find_user", "looks up a user", "app/repo.py", {}),
            ("a::readme_summary::README", "a", "readme_summary", None, None, None, None),
            ("b::config_summary::b.toml", "b", "config_summary", "config", "", "b.toml", {"config_env_vars": ["USER_TOKEN"]}),
        ],
    )


def test_latest_row_wins(spark):
    rows = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("x", 2, "new"), (None, 3, "no key"), ("y", None, "only")], "k string, at int, v string")
    assert sorted(map(tuple, latest(rows, ["k"], F.col("at").desc_nulls_last(), F.col("v")).collect())) == [("x", 2, "new"), ("y", None, "only")]


def test_scan_rules(spark):
    rows = [("r", "src/a.py", 10), ("r", "node_modules/x/y.js", 5), ("r", "node_modules/z.js", 5), ("r", "big.txt", 1_000_001), ("r", "ok.txt", 1_000_000), ("r", "logo.PNG", 3), ("r", "README", 1), ("r", "docs/readme.md", 1), ("r", ".github/workflows/ci.yml", None)]
    files = spark.createDataFrame(rows, "repo_id string, path string, size_bytes bigint").withColumn("name", F.lit("clash"))
    stats = scan.scan_stats(files).first()
    assert (stats.total_seen, stats.kept_count, stats.ignored_count, stats.key_file_count) == (7, 5, 3, 2)
    preview = {r.entry for r in scan.tree_preview(files).collect()}
    assert {"src/", "src/a.py", "node_modules/x/", "README", ".github/workflows/"} <= preview
    assert scan.scan_stats(files.limit(0)).count() == 0


def test_reading_contents(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "bad.txt").write_bytes(b"  ok \xff\xfe end\n")
    (tmp_path / "long.txt").write_bytes(b"x" * 30_000)
    read = {r.path: r for r in scan.read_contents(scan.read_tree(spark, str(tmp_path))).collect()}
    assert read["d/bad.txt"].content == "ok �� end" and not read["d/bad.txt"].truncated
    assert len(read["long.txt"].content) == 20_480 and read["long.txt"].truncated
    binary = spark.createDataFrame([(b"\x00" + b"a" * 5,), (b"a" * 1024 + b"\x00",), (b"",), (None,)], "content binary").select(scan.is_binary(F.col("content")).alias("b"))
    assert [r.b for r in binary.collect()] == [True, False, False, False]


def test_search_ranks_the_named_symbol_first(spark, library):
    best = search.search(library, "load_user 是怎么实现的", 3).collect()
    assert best[0].doc_id.endswith("load_user") and best[0].score > 0
    assert search.search(library, "？", 3).count() == 0
    assert search.search(library.limit(0), "load_user", 3).count() == 0
    assert [r.doc_id for r in search.search(library, "user token env", 5, repo_id="b").collect()] == ["b::config_summary::b.toml"]


def test_batch_scores_keep_to_the_repository(spark, library):
    asked = spark.createDataFrame([("q1", "load user session", "a"), ("q2", "config user_token", None), ("q3", None, None)], "query_id string, query string, repo_id string")
    found = search.best_per_query(search.batch_scores(library, asked), 2).collect()
    assert {r.repo_id for r in found if r.query_id == "q1"} == {"a"}
    assert {r.query_id for r in found} == {"q1", "q2"}


def test_intents(spark):
    asked = ["GET /login 在哪", "what is this overview", "service 架构", "Foo.bar 的实现", None]
    rows = spark.createDataFrame([(k, q) for k, q in enumerate(asked)], "k int, q string").select("k", search.infer_intent(F.col("q")).alias("i")).collect()
    assert [r.i for r in sorted(rows)] == ["api", "overview", "architecture", "implementation", "generic"]


def test_call_targets_go_through_expanded_keys(spark, library):
    assert [tuple(r) for r in graph.call_targets(library).collect()] == [("a", "a::function_summary::app/login.py::load_user", "a::function_summary::app/repo.py::find_user")]
    assert [r.relation_type for r in graph.call_edges(library).collect()] == ["delegate_repository"]


def test_levels_and_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "source string, target string")
    assert {r.node: r.level for r in graph.levels(edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    near = graph.reachable(edges, spark.createDataFrame([("a",)], "node string"), 2)
    assert {r.node: r.distance for r in near.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    with pytest.raises(ValueError):
        graph.levels(spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string"), max_depth=4)


def test_code_rows(spark):
    py = "import os\nfrom app.db import x\n\nclass Store:\n    def find(self, key):\n        return self.repo.get(key)\n\nasync def main():\n    await run()\n"
    js = "import a from './a.js';\nconst f = async (x) => x;\nexport default class K {}\nrouter.post('/session', create);\n"
    files = spark.createDataFrame([("r", "m.py", py), ("r", "m.js", js), ("r", "bad.py", "def ("), ("r", "n.py", None), ("r", "e.go", "")], "repo_id string, path string, content string")
    assert [(r.symbol_type, r.name, r.line_number) for r in codeindex.symbols(files, "py").where("path = 'm.py'").orderBy("line_number").collect()] == [("class", "Store", 4), ("method", "find", 5), ("function", "main", 8)]
    assert [r.target for r in codeindex.relations(files, "py").orderBy("line_number").collect()] == ["os", "app.db"]
    trees = {r.qualified_name: r for r in codeindex.python_trees(files).collect()}
    assert trees["Store.find"].called_symbols == ["self.repo.get"] and trees["Store.find"].parameters == ["self", "key"]
    assert set(trees) == {"Store", "Store.find", "main"}
    assert codeindex.symbols(files.limit(0), "js").count() == 0


def test_python_rows_without_a_tree_and_under_statements(spark):
    cut = "class Store:\n    def find(self, key: str = 1, *rest):\n        return 1\n\nasync def main(a, b):\n    x = (1,\n"
    deep = "if x:\n    def a(): pass\nelse:\n    def b(): pass\ntry:\n    class C:\n        if y:\n            def d(self): pass\nexcept E:\n    def e(): pass\nfinally:\n    def f(): pass\nwith w:\n    for i in j:\n        async def g(): pass\nmatch m:\n    case 1:\n        def h():\n            def inner(): pass\n"
    files = spark.createDataFrame([("r", "cut.py", cut), ("r", "deep.py", deep), ("r", "none.py", None), ("r", "empty.py", "x = 1\n")], "repo_id string, path string, content string")
    got = codeindex.python_trees(files).collect()
    assert [(r.symbol_type, r.qualified_name, r.line_start, r.line_end, r.parameters, r.called_symbols) for r in got if r.path == "cut.py"] == [("class", "Store", 1, 1, [], []), ("method", "find", 2, 2, ["self", "key"], []), ("function", "main", 5, 5, ["a", "b"], [])]
    assert {(r.symbol_type, r.qualified_name) for r in got if r.path == "deep.py"} == {("function", n) for n in "abefgh"} | {("class", "C"), ("method", "C.d")}
    ruled = codeindex.symbols(files.where("path = 'cut.py'"), "py").collect()
    assert {(r.symbol_type, r.name, r.line_number) for r in ruled} == {(r.symbol_type, r.qualified_name, r.line_start) for r in got if r.path == "cut.py"}


def test_profiles(spark):
    signals = spark.createDataFrame([("r", "language", "python", "weak", "x", 2), ("r", "language", "Python", "strong", "m", 0), ("r", "language", "Go", "weak", "x", 1)], "repo_id string, category string, name string, evidence_level string, evidence_source string, seq int")
    best = {r.name: r.evidence_level for r in profile.strongest(signals).collect()}
    assert best == {"Python": "strong", "Go": "weak"}
    roots = spark.createDataFrame([("r", "."), ("r", "a"), ("r", "a/b")], "repo_id string, root string")
    rows = spark.createDataFrame([("r", "a/b/x.py"), ("r", "ab/x.py"), ("r", "a"), ("s", "a/x")], "repo_id string, path string")
    assert {r.path: r.root for r in profile.longest_prefix(rows, roots, ["repo_id"], "path").collect()} == {"a/b/x.py": "a/b", "ab/x.py": ".", "a": "a", "a/x": None}
    names = ["fastapi", "react-dom/client", "reactagent", "Redis>=4", None]
    got = [r.n for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, t string").select("k", profile.rule_of(F.col("t"))["name"].alias("n")).orderBy("k").collect()]
    assert got == ["FastAPI", "React", None, "Redis", None]


def test_documents_and_store(spark, tmp_path):
    repos = spark.createDataFrame([("o/r", "main", "Python", {"Python": 1}, ["web", " web"], None, 3, " hello"), ("o/s", None, None, None, None, None, None, " \n")], "full_name string, default_branch string, primary_language string, languages map<string,bigint>, topics array<string>, license_name string, stargazers_count bigint, readme string")
    assert [(r.doc_id, r.content[-7:]) for r in documents.readme_summaries(repos).collect()] == [("o/r::readme_summary", "\n\nhello")]
    signals = spark.createDataFrame([("o/r", "Flask", "framework", "strong"), ("o/r", "Vue", "framework", "weak"), ("o/r", "Go", "language", "medium")], "repo_id string, name string, category string, evidence_level string")
    entries = spark.createDataFrame([("o/r", f"m{k:03}/main.py") for k in range(80)], "repo_id string, path string")
    places = spark.createDataFrame([("o/r", ".", "python", "package")], "repo_id string, root_path string, language_scope string, project_kind string")
    told = documents.profiles(repos, signals, entries, places, entries, entries.limit(0))
    summary = {r.repo_id: r.content for r in documents.repo_summaries(told).collect()}
    assert "技术栈：Flask, Go" in summary["o/r"] and "子项目：.(python/package)" in summary["o/r"] and "关键符号数量：80" in summary["o/r"] and "主语言：未识别" in summary["o/s"]
    facts = {r.repo_id: r.content for r in documents.repo_facts(told).collect()}
    assert "topics: web\n" in facts["o/r"] and "frameworks: Flask\n" in facts["o/r"] and facts["o/r"].count("main.py") == documents.LISTED and "stars: 0" in facts["o/s"]
    every = documents.union(documents.readme_summaries(repos), documents.repo_facts(told))
    documents.write(every, str(tmp_path / "kb"))
    assert documents.read(spark, str(tmp_path / "kb"), "o/s").count() == 1
    documents.write(every.where("repo_id = 'o/s'").withColumn("content", F.lit("new")), str(tmp_path / "kb"))
    assert {(r.repo_id, r.content) for r in documents.read(spark, str(tmp_path / "kb")).where("doc_type = 'repo_fact' and repo_id = 'o/s'").collect()} == {("o/s", "new")}
    assert documents.read(spark, str(tmp_path / "kb")).count() == 3
    assert documents.delete(spark, str(tmp_path / "kb"), "o/r") and not documents.delete(spark, str(tmp_path / "kb"), "o/r")
    assert {r.repo_id for r in documents.read(spark, str(tmp_path / "kb")).select("repo_id").distinct().collect()} == {"o/s"}


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "vec_id bigint, embedding array<double>")
    near = vectors.nearest(rows, rows.where("vec_id = 0"), 2).orderBy("rank").collect()
    assert [r.vec_id for r in near] == [1, 2]
    assert vectors.nearest(rows, rows.limit(0), 2).count() == 0
    merged = vectors.upserted(rows, rows.where("vec_id = 2").withColumn("embedding", F.array(F.lit(5.0), F.lit(5.0))), "vec_id")
    assert merged.count() == 5 and merged.where("vec_id = 2").first().embedding == [5.0, 5.0]


def test_assets(spark):
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "repo_id string")
    flags = assets.presence(clone=one("a", "a", None), report=one("a", "c"), knowledge=one("b"), vector=one("b"))
    states = {r.repo_id: r.s for r in flags.select("repo_id", assets.status(*(F.col(f"has_{k}") for k in assets.KINDS)).alias("s")).collect()}
    assert states == {"a": "完整", "b": "孤儿索引+资产", "c": "仅报告残留"}
    assert {r.repo_id for r in assets.orphans(flags).collect()} == {"b", "c"}


def test_evidence(spark):
    claims = spark.createDataFrame([("c1", "a", "the loader reads session rows"), ("c2", "a", "unrelated words entirely"), ("c3", "a", "")], "claim_id string, group string, text string")
    evidence = spark.createDataFrame([("a", "e1", "a loader reads rows"), ("b", "e2", "unrelated words entirely")], "group string, evidence_id string, text string")
    got = {r.claim_id: r.supported for r in answers.supported(claims, evidence).collect()}
    assert got == {"c1": True, "c2": False, "c3": False}
    assert answers.verdict(answers.supported(claims, evidence)).first().verdict == "failed"
    long = "the a.b user " + "x" * 200
    hits = spark.createDataFrame([("q", "find user a.b", 1, "the user\nfind the user\nfind the user\nnothing", "other"), ("q", "find user a.b", 2, None, None), ("q", "find user a.b", 3, long, "readme_summary")], "query_id string, query string, position int, content string, doc_type string")
    got = [(r["rank"], r.line, r.score) for r in answers.selected_lines(hits).orderBy("rank").collect()]
    assert got == [(1, long, 1 + 2 + 2 - 1), (2, "find the user", 2), (3, "the user", 1)]
    blocks = spark.createDataFrame([("q", "run x", "d", "config_chunk", "```py\n\nreturn x\nrun\n```\nrun x")], "query_id string, query string, doc_id string, doc_type string, content string")
    assert [(r.line, r.score) for r in answers.chunk_lines(blocks).orderBy("rank").collect()] == [("return x", 3 + 2 + 2), ("run", 3 + 2 + 1)]


def test_streamed_upserts(spark, tmp_path, library):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    library.write.parquet(source)
    for k in range(2):
        ingest.ingest(spark, source, library.schema, store, str(tmp_path / "state")).awaitTermination()
        if k == 0:
            later = library.where("repo_id = 'b'").withColumn("content", F.lit("second")).withColumn("indexed_at", F.lit(T0 + dt.timedelta(days=1)))
            later.write.mode("append").parquet(source)
    read = spark.read.parquet(store)
    assert read.count() == 4 and read.where("repo_id = 'b'").first().content == "second"
