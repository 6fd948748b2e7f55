"""Definitions, calls, routes, edges and documents of small files, with nulls, repeated lines, decorators and routes over several lines."""

import pytest
from pyspark.sql import functions as F

from repolith.operators import codedocs, codegraph

PY = """import os
from app.core import make

class Base(Parent, metaclass=Meta):
    limit: int = 3

    @property
    def size(self) -> int:
        return len(self.rows)

    async def load(self, path: str, *args, **kw):
        rows = self.repo.find(path)
        self.clean(rows)
        self.clean(rows)
        return rows

@router.post("/items/{id}")
def create(item, n=1):
    return user_service.save(item)

@app.route("/all", methods=["GET", "POST"])
def everything():
    pass
"""
JS = """import x from './x.js';
export class Store extends Base {
  get(key) {
    return this.repo.read(key);
  }
}
const handle = async (req, res) => {
  sendAll(req);
};
app.get('/store', handle);
app.put('/inline', auth, async (req, res) => res.end());
router.all(
  "/any",
  auth,
  (req, res) => res.end()
);
"""


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", "a.py", PY, 1), ("r", "b.js", JS, 1), ("r", "c.py", None, 1), ("r", "d.py", "", 1), ("r", "e.md", PY, 1), ("s", "f.go", "func (s *T) Run() {}\n", 1)]
    return spark.createDataFrame(rows, "repo_id string, path string, content string, language int").cache()


def test_definitions_and_owners(files):
    got = {(r.path, r.qualified_name): (r.kind, r.owner_class, r.line_start, r.line_end, list(r.parameters), list(r.bases)) for r in codegraph.definitions(files).collect()}
    assert got["a.py", "Base"] == ("class", None, 4, 16, [], ["Parent"])
    assert got["a.py", "Base.load"] == ("method", "Base", 11, 16, ["self", "path", "*args", "**kw"], [])
    assert got["b.js", "Store"][0] == "class" and got["b.js", "Store"][5] == ["Base"]
    assert got["b.js", "Store.get"][1] == "Store" and got["b.js", "handle"][0] == "function"
    assert set(got) == {("a.py", n) for n in ("Base", "Base.size", "Base.load", "create", "everything")} | {("b.js", n) for n in ("Store", "Store.get", "handle")}


def test_calls_are_capped_and_in_order(files):
    got = [(r.qualified_name, r.called, r.call_no) for r in codegraph.calls(files).where("path = 'a.py'").orderBy("line_start", "call_no").collect()]
    assert got == [("Base.size", "len", 1), ("Base.load", "repo.find", 1), ("Base.load", "clean", 2), ("create", "user_service.save", 1)]
    many = files.sparkSession.createDataFrame([("r", "m.py", "def f():\n" + "".join(f"    g{k}()\n" for k in range(30)))], "repo_id string, path string, content string")
    assert codegraph.calls(many).count() == codegraph.MAX_CALLS


def test_routes_and_their_handlers(files):
    got = {(r.path, r.route_path): (list(r.http_methods), r.framework, r.handler_qualified_name, r.line_number) for r in codegraph.routes(files).collect()}
    assert got["a.py", "/items/{id}"] == (["POST"], "fastapi", "create", 17)
    assert got["a.py", "/all"] == (["GET", "POST"], "flask", "everything", 21)
    assert got["b.js", "/store"] == (["GET"], "express", "handle", 10)
    assert got["b.js", "/any"][0] == codegraph.ALL_VERBS and got["b.js", "/any"][2:] == ("auth", 12)
    assert got["b.js", "/inline"][2:] == ("inline_handler@L11", 11)
    placed = {r.route_path: (r.handler_start, r.handler_end) for r in codegraph.route_handlers(codegraph.routes(files), codegraph.definitions(files)).collect()}
    assert placed["/store"] == (7, 9) and placed["/any"] == (None, None) and placed["/inline"] == (None, None)


def test_edges_have_all_kinds(files):
    got = {(r.source_ref, r.target_ref, r.relation_type) for r in codegraph.edges(files).collect()}
    assert got >= {
        ("a.py", "os", "import"), ("a.py", "Base", "contain_symbol"), ("Base", "Parent", "inherit"), ("Base", "Base.load", "define_method"), ("Base.load", "repo.find", "delegate_repository"), ("Base.load", "clean", "call"),
        ("create", "user_service.save", "delegate_service"), ("a.py", "POST /items/{id}", "contain_route"), ("POST /items/{id}", "create", "handle_route"), ("b.js", "./x.js", "import"), ("GET /store", "handle", "handle_route"),
    }
    kinds = {r.entity_kind for r in codegraph.entities(files).select("entity_kind").distinct().collect()}
    assert kinds == {"symbol", "function", "class", "api_route"}


def test_methods_of_classes(files):
    got = {r.class_name: (list(r.methods), list(r.method_refs)) for r in codegraph.class_methods(codegraph.definitions(files)).collect()}
    assert got == {"Base": (["size", "load"], ["Base.size", "Base.load"]), "Store": (["get"], ["Store.get"])}


def test_documents(files):
    subprojects = files.sparkSession.createDataFrame([("r", "."), ("s", "lib")], "repo_id string, root_path string")
    own = {r.doc_id: r for r in codedocs.function_summaries(files, subprojects).collect()}
    load = own["r::function_summary::a.py::Base.load"]
    assert "调用：repo.find, clean" in load.content and "返回线索：rows" in load.content and "所属子项目：." in load.content
    assert load.metadata["code_relation_types"] == ["contain_symbol", "define_method", "delegate_repository", "call"]
    assert own["r::function_summary::a.py::Base.size"].metadata["decorators"] == ["property"]
    chunk = {r.doc_id: r.content for r in codedocs.body_chunks(files, subprojects).collect()}
    assert "L11:     async def load" in chunk["r::function_body_chunk::a.py::Base.load"] and "L10: " in chunk["r::function_body_chunk::a.py::Base.load"]
    routes = {r.doc_id: r for r in codedocs.route_summaries(files, subprojects).collect()}
    assert routes["r::api_route_summary::a.py::POST::/items/{id}"].metadata["code_relation_targets"] == ["POST /items/{id}", "create", "user_service.save"]
    around = {r.doc_id: r.content for r in codedocs.route_chunks(files, subprojects).collect()}
    assert "L17: @router.post" in around["r::route_handler_chunk::a.py::POST::/items/{id}"]
    classes = {r.doc_id: r.content for r in codedocs.class_summaries(files, subprojects).collect()}
    assert "继承：Parent" in classes["r::class_summary::a.py::Base"] and "方法：size, load" in classes["r::class_summary::a.py::Base"]


def test_empty_table(files):
    nothing = files.limit(0)
    assert codegraph.edges(nothing).count() == 0 and codegraph.entities(nothing).count() == 0 and codegraph.routes(nothing.withColumn("handler_name", F.lit("x"))).count() == 0
