"""The best chains of calls against all chains, on tables in which many documents call each other, and code of key files where no join is broadcast."""

import random

from repolith.plans import catalog_reports, catalog_trace

DOCS = "doc_id string, repo_id string, doc_type string, title string, content string, source_path string, metadata map<string,array<string>>, indexed_at timestamp"


def most_rows(df):
    """The most rows that any operator of a plan that ran gave out."""

    def nodes(node):
        yield node
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from nodes(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from nodes(node.plan())
        for k in range(node.children().size()):
            yield from nodes(node.children().apply(k))

    found = (n.metrics().get("numOutputRows") for n in nodes(df._jdf.queryExecution().executedPlan()))
    return max(m.get().value() for m in found if m.isDefined())


def ranked(spark, folder, names, limit=4):
    """chain_rank over documents of {symbol: (repository, called symbols)} and the same from all chains."""
    own = {n: f"{repo}::function_summary::f.py::{n}" for n, (repo, _) in names.items()}
    rows = [(own[n], repo, "function_summary", n, "text", "f.py", {"called_symbols": called}, None) for n, (repo, called) in names.items()]
    spark.createDataFrame([*rows, *rows[:3], ("x", None, None, None, None, None, None, None)], DOCS).write.parquet(f"{folder}/knowledge_docs.parquet")
    df = catalog_trace.chain_rank(spark, str(folder))
    got = sorted(map(tuple, df.collect()))
    last = lambda n: n.rpartition(".")[2].lower()
    leads = {n: {m for m, (r, _) in names.items() if r == repo and m != n and {m.lower(), last(m)} & {k for c in called for k in (c.lower(), last(c))}} for n, (repo, called) in names.items()}
    role = lambda n: next((v for words, v in ((("repository", "repo", "dao"), 4), (("service", "svc"), 3), (("handler", "controller", "view", "endpoint"), 2)) if any(w in n.lower() for w in words)), 0)
    want = []
    for root in names:
        ways = [[root, t] for t in leads[root] if not leads[t]] + [[root, t, m] for t in leads[root] for m in leads[t] if m != root]
        scored = sorted((-(10 * (len(w) - 1) + sum(map(role, w)) + 2 * ("/" in root)), " -> ".join(own[n] for n in w)) for w in ways)
        want += [(own[root], chain, -score, k) for k, (score, chain) in enumerate(scored[:limit], 1)]
    return got, sorted(want), df


def test_best_chains_are_the_best_of_all_chains(spark, tmp_path):
    random.seed(7)
    symbols = [f"{c}.{m}" for c in ("UserRepo", "Svc", "A", "a/b", "View") for m in ("run", "stop", "load", "dao_x")]
    for k, (size, calls) in enumerate(((20, 3), (20, 9), (14, 1))):
        names = {s: (random.choice("pq") if k == 2 else "p", random.sample([*symbols, "run", "dao_x", "nowhere"], random.randrange(0, calls + 1))) for s in random.sample(symbols, size)}
        got, want, _ = ranked(spark, tmp_path / str(k), names)
        assert got == want, k


def test_roots_that_are_the_best_ends_get_others(spark, tmp_path):
    names = {f"{c}.run": ("p", ["run"]) for c in ("userrepo", *"abcdefghi")} | {"z.only": ("p", ["a.run", "back"]), "z.back": ("p", ["only"])}
    got, want, _ = ranked(spark, tmp_path, names)
    assert got == want


def test_documents_that_all_call_each_other_are_not_paired(spark, tmp_path):
    names = {f"k{k:02}.run": ("p", ["run"]) for k in range(60)}
    got, want, df = ranked(spark, tmp_path, names)
    assert got == want and len(got) == 60 * 4
    assert most_rows(df) <= 60 * 30  # 60 * 59 * 58 chains


def test_structure_of_files_without_broadcasts(spark, tmp_path):
    contents = {
        "a.py": "import os\nfrom a.b import c\nclass A:\n    def f(self):\n        pass\r\ndef g():\r    pass\nimport os",
        "a.ts": "import x from 'y'\nexport class B {}\nconst f = async (a) => 1\nconst z = require('z')\ninterface I {}",
        "a.go": 'import "fmt"\nfunc (a *A) Run() {}\nclass A:',
        "a.rs": "use std::io;\npub(crate) async fn run() {}\nfn\nclass A",
        "a.txt": "import os\nclass A:",
        "none.py": None,
        "empty.js": "",
    }
    rows = [("r", path, 5, content, None) for path, content in contents.items()]
    old = [("r", "a.py", 3, "class Z:", None), ("r", None, 1, "class Z:", None), (None, "a.py", 1, "class Z:", None)]
    spark.createDataFrame([*rows, *rows, *old], "repo_id string, path string, size_bytes bigint, content string, truncated boolean").write.parquet(f"{tmp_path}/key_files.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = catalog_reports.join_file_structure(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {"a.py": (3, 1, 3), "a.ts": (3, 1, 2), "a.go": (1, 0, 1), "a.rs": (1, 0, 1), "a.txt": (0, 0, 0), "none.py": (0, 0, 0), "empty.js": (0, 0, 0)}
    assert sorted(map(tuple, got)) == sorted(("r", path, *counts) for path, counts in want.items())
