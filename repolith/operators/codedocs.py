"""Knowledge documents of code: functions, classes, routes and their numbered source, from definitions and calls.

Every document is one row: its labelled lines are one expression over the joined facts of a definition, and its metadata is a map. Facts are
joined by file and definition; the stored content joins last, for the chunks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions import text as T
from repolith.operators import codegraph as G
from repolith.operators import codeindex as C
from repolith.operators import documents as D
from repolith.operators import profile
from repolith.operators.documents import lines_text, or_none

KEYS = ["repo_id", "path", "qualified_name", "line_start"]
# Names of language scopes.
SCOPES = {"py": "python", "js": "nodejs"}


def _or_none(values: Column) -> Column:
    return D.joined(values)


def line_range(first: Column, last: Column) -> Column:
    """L<first>-L<last>, one L where they are equal or one is missing, else 未知."""
    one = lambda n: F.concat(F.lit("L"), n.cast("string"))
    return F.when(first.isNull() & last.isNull(), "未知").when(first.isNull(), one(last)).when(last.isNull() | (last == first), one(first)).otherwise(F.concat(one(first), F.lit("-"), one(last)))


def _in_subprojects(rows: DataFrame, subprojects: DataFrame) -> DataFrame:
    """rows with the root of the subproject that their path lies in, as subproject_root."""
    roots = subprojects.select("repo_id", F.col("root_path").alias("root"))
    paths = rows.select("repo_id", "path").distinct()
    return rows.join(profile.longest_prefix(paths, roots, ["repo_id"], "path").withColumnRenamed("root", "subproject_root"), ["repo_id", "path"], "left")


def facts_of(files: DataFrame, subprojects: DataFrame) -> DataFrame:
    """What the documents of definitions are made of, to be written once where several builders need it: definitions with their calls, returns, decorators and subproject."""
    called = G.calls(files).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("call_no", "called"))), lambda x: x["called"]).alias("called_symbols"))  # at most MAX_CALLS
    own = G.definitions(files)
    for extra in (called, G.returns(files), G.decorators(files)):
        own = own.join(extra, KEYS, "left")
    scope = F.when(F.col("language") == "py", SCOPES["py"]).otherwise(SCOPES["js"])
    return _in_subprojects(own, subprojects).withColumn("language_scope", scope)


def _document(rows: DataFrame, kind: str, ident: Column, title: Column, content: Column, metadata: Column) -> DataFrame:
    return rows.select(D.doc_id(F.col("repo_id"), F.lit(kind), F.col("path"), ident).alias("doc_id"), "repo_id", F.lit(kind).alias("doc_type"), title.alias("title"), content.alias("content"), F.col("path").alias("source_path"), metadata.alias("metadata"))


def _metadata(**fields: Column) -> Column:
    """A map of fields to lists of text; fields without a value are left out."""
    as_list = lambda c: c if isinstance(c, tuple) else F.array_compact(F.array(c.cast("string")))
    entries = [F.struct(F.lit(k).alias("key"), (v[0] if isinstance(v, tuple) else as_list(v)).alias("value")) for k, v in fields.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def _edge_fields(edges: Column) -> dict[str, tuple[Column]]:
    """Edges as three aligned lists."""
    part = lambda f: (F.transform(edges, lambda e: e[f]),)
    return {"code_relation_sources": part("source"), "code_relation_targets": part("target"), "code_relation_types": part("type")}


def _edge(source: Column, target: Column, kind: Column) -> Column:
    return F.struct(source.alias("source"), target.alias("target"), kind.alias("type"))


def _list(column: str) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _functions(facts: DataFrame) -> DataFrame:
    own = facts.where("kind <> 'class'")
    name, source = F.col("qualified_name"), F.col("path")
    contained = F.array(_edge(source, name, F.lit("contain_symbol")))
    method = F.when(F.col("owner_class").isNotNull(), F.array(_edge(F.col("owner_class"), name, F.lit("define_method"))))
    called = F.transform(_list("called_symbols"), lambda c: _edge(name, c, C.call_relation(c)))
    return own.withColumn("edges", F.concat(contained, F.coalesce(method, F.slice(contained, 1, 0)), called))


def function_summaries(files: DataFrame, subprojects: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One document for each function and method, with the edges that contain, define and call."""
    own = _functions(facts if facts is not None else facts_of(files, subprojects))
    content = lines_text(
        F.concat(F.lit("仓库 "), F.col("repo_id"), F.lit(" 中的函数/方法实现摘要。")),
        ("来源文件", F.col("path")), ("符号名称", F.col("name")), ("限定名", F.col("qualified_name")), ("语言范围", F.col("language_scope")), ("代码位置", line_range(F.col("line_start"), F.col("line_end"))),
        ("所属类", or_none(F.col("owner_class"), "无")), ("函数签名", F.col("signature")), ("装饰器", _or_none(_list("decorators"))), ("参数", _or_none(F.col("parameters"))), ("调用", _or_none(_list("called_symbols"))),
        ("返回线索", _or_none(_list("return_signals"))), ("所属子项目", or_none(F.col("subproject_root"), "无")),
    )
    metadata = _metadata(
        source_path=F.col("path"), summary_kind=F.lit("function"), symbol_name=F.col("name"), qualified_name=F.col("qualified_name"), owner_class=F.col("owner_class"), language_scope=F.col("language_scope"), line_start=F.col("line_start"), line_end=F.col("line_end"),
        signature=F.col("signature"), decorators=(_list("decorators"),), parameters=(F.col("parameters"),), called_symbols=(_list("called_symbols"),), return_signals=(_list("return_signals"),), subproject_root=F.col("subproject_root"),
        code_entity_names=F.col("name"), code_entity_kinds=F.lit("function"), code_entity_refs=F.col("qualified_name"), **_edge_fields(F.col("edges")),
    )
    return _document(own, "function_summary", F.col("qualified_name"), F.concat("repo_id", F.lit("::"), "qualified_name", F.lit(" 函数摘要")), content, metadata)


def class_summaries(files: DataFrame, subprojects: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One document for each class, with the edges that contain, define its methods and inherit."""
    methods = G.class_methods(G.definitions(files)).select("repo_id", "path", F.col("class_name").alias("qualified_name"), "line_start", "methods", "method_refs")
    own = (facts if facts is not None else facts_of(files, subprojects)).where("kind = 'class'").join(methods, KEYS, "left")
    name = F.col("qualified_name")
    edges = F.concat(F.array(_edge(F.col("path"), name, F.lit("contain_symbol"))), F.transform("method_refs", lambda m: _edge(name, m, F.lit("define_method"))), F.transform("bases", lambda b: _edge(name, b, F.lit("inherit"))))
    content = lines_text(
        F.concat(F.lit("仓库 "), F.col("repo_id"), F.lit(" 中的类实现摘要。")),
        ("来源文件", F.col("path")), ("类名称", F.col("name")), ("限定名", name), ("语言范围", F.col("language_scope")), ("代码位置", line_range(F.col("line_start"), F.col("line_end"))), ("继承", _or_none(F.col("bases"))),
        ("装饰器", _or_none(_list("decorators"))), ("方法", _or_none(F.col("methods"))), ("所属子项目", or_none(F.col("subproject_root"), "无")),
    )
    metadata = _metadata(
        source_path=F.col("path"), summary_kind=F.lit("class"), symbol_name=F.col("name"), qualified_name=name, language_scope=F.col("language_scope"), line_start=F.col("line_start"), line_end=F.col("line_end"), bases=(F.col("bases"),), decorators=(_list("decorators"),),
        class_methods=(F.col("methods"),), subproject_root=F.col("subproject_root"), code_entity_names=(F.concat(F.array("name"), "methods"),), code_entity_kinds=(F.concat(F.array(F.lit("class")), F.transform("methods", lambda _: F.lit("function"))),),
        code_entity_refs=(F.concat(F.array(name), "method_refs"),), **_edge_fields(edges),
    )
    return _document(own, "class_summary", name, F.concat("repo_id", F.lit("::"), name, F.lit(" 类摘要")), content, metadata)


def _with_chunk(rows: DataFrame, files: DataFrame, first: Column, last: Column) -> DataFrame:
    """rows with the numbered lines from first to last of their file as chunk; rows whose lines lie beyond the stored content are left out."""
    held = rows.join(files.select("repo_id", "path", "content"), ["repo_id", "path"])
    return held.withColumn("chunk", T.numbered(F.col("content"), first, last, D.CHUNK_LINES, D.CHUNK_CHARS)).where("chunk <> ''")


def body_chunks(files: DataFrame, subprojects: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The source of each function and class: from the line before it to two lines behind it, at most CHUNK_LINES."""
    own = _with_chunk(facts if facts is not None else facts_of(files, subprojects), files, F.col("line_start") - 1, F.col("line_end") + 2)
    is_class = F.col("kind") == "class"
    begin = F.greatest(F.col("line_start") - 1, F.lit(1))
    shown = F.size(F.split("chunk", "\n"))
    content = F.concat(
        lines_text(
            F.concat(F.lit("仓库 "), F.col("repo_id"), F.when(is_class, " 中的类源码片段。").otherwise(" 中的函数源码片段。")),
            ("来源文件", F.col("path")), ("限定名", F.col("qualified_name")), ("语言范围", F.col("language_scope")), ("代码位置", line_range(begin, begin + shown - 1)), ("函数签名", F.col("signature")), ("调用", _or_none(_list("called_symbols"))),
            ("所属子项目", or_none(F.col("subproject_root"), "无")),
        ),
        F.lit("\n源码片段：\n```text\n"), F.col("chunk"), F.lit("\n```"),
    )
    metadata = _metadata(source_path=F.col("path"), symbol_name=F.col("name"), qualified_name=F.col("qualified_name"), language_scope=F.col("language_scope"), line_start=begin, line_end=begin + shown - 1, called_symbols=(_list("called_symbols"),), subproject_root=F.col("subproject_root"))
    kind = F.when(is_class, "class_body_chunk").otherwise("function_body_chunk")
    title = F.concat("repo_id", F.lit("::"), "qualified_name", F.when(is_class, " 类源码片段").otherwise(" 函数源码片段"))
    return own.select(D.doc_id(F.col("repo_id"), kind, F.col("path"), F.col("qualified_name")).alias("doc_id"), "repo_id", kind.alias("doc_type"), title.alias("title"), content.alias("content"), F.col("path").alias("source_path"), metadata.alias("metadata"))


def _routes(files: DataFrame, subprojects: DataFrame) -> DataFrame:
    called = G.calls(files).groupBy("repo_id", "path", F.col("qualified_name").alias("handler_qualified_name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "call_no", "called"))), lambda x: x["called"]).alias("called_symbols"))
    own = _in_subprojects(G.routes(files).join(called, ["repo_id", "path", "handler_qualified_name"], "left"), subprojects)
    verbs = F.when(F.size("http_methods") > 0, F.array_join("http_methods", "/")).otherwise("HTTP")
    ref = F.concat(verbs, F.lit(" "), F.col("route_path"))
    handler = F.col("handler_qualified_name")
    edges = F.concat(F.array(_edge(F.col("path"), ref, F.lit("contain_route")), _edge(ref, handler, F.lit("handle_route"))), F.transform(F.slice(_list("called_symbols"), 1, G.MAX_CALLS), lambda c: _edge(handler, c, C.call_relation(c))))
    return own.withColumn("verbs", verbs).withColumn("route_ref", ref).withColumn("edges", edges).withColumn("language_scope", F.when(F.col("language") == "py", SCOPES["py"]).otherwise(SCOPES["js"]))


def _route_metadata(kind: str) -> Column:
    return _metadata(
        source_path=F.col("path"), summary_kind=F.lit(kind), route_path=F.col("route_path"), http_methods=(F.col("http_methods"),), framework=F.col("framework"), handler_name=F.col("handler_name"), handler_qualified_name=F.col("handler_qualified_name"),
        language_scope=F.col("language_scope"), line_number=F.col("line_number"), called_symbols=(_list("called_symbols"),), subproject_root=F.col("subproject_root"), code_entity_names=(F.array("route_ref", "handler_name"),),
        code_entity_kinds=(F.array(F.lit("api_route"), F.lit("function")),), code_entity_refs=(F.array("route_ref", "handler_qualified_name"),), **_edge_fields(F.col("edges")),
    )


def route_summaries(files: DataFrame, subprojects: DataFrame) -> DataFrame:
    """One document for each route, with the edges that contain it, handle it and call on."""
    own = _routes(files, subprojects)
    content = lines_text(
        F.concat(F.lit("仓库 "), F.col("repo_id"), F.lit(" 中的接口/路由实现摘要。")),
        ("来源文件", F.col("path")), ("路由路径", F.col("route_path")), ("HTTP 方法", F.col("verbs")), ("框架线索", or_none(F.col("framework"), "未知")), ("处理函数", F.col("handler_name")), ("处理限定名", F.col("handler_qualified_name")),
        ("代码位置", line_range(F.col("line_number"), F.col("line_number"))), ("调用", _or_none(_list("called_symbols"))), ("所属子项目", or_none(F.col("subproject_root"), "无")),
    )
    return _document(own, "api_route_summary", F.concat("verbs", F.lit("::"), "route_path"), F.concat("repo_id", F.lit("::"), "route_ref", F.lit(" 接口摘要")), content, _route_metadata("api_route"))


def route_chunks(files: DataFrame, subprojects: DataFrame) -> DataFrame:
    """The source around each route's registration: two lines before it to ten behind it."""
    own = _with_chunk(_routes(files, subprojects), files, F.col("line_number") - 2, F.col("line_number") + 10)
    begin = F.greatest(F.col("line_number") - 2, F.lit(1))
    content = F.concat(
        lines_text(
            F.concat(F.lit("仓库 "), F.col("repo_id"), F.lit(" 中的接口处理源码片段。")),
            ("来源文件", F.col("path")), ("路由路径", F.col("route_path")), ("HTTP 方法", F.col("verbs")), ("处理函数", F.col("handler_name")), ("处理限定名", F.col("handler_qualified_name")), ("框架线索", or_none(F.col("framework"), "未知")),
            ("代码位置", line_range(begin, begin + F.size(F.split("chunk", "\n")) - 1)), ("调用", _or_none(_list("called_symbols"))), ("所属子项目", or_none(F.col("subproject_root"), "无")),
        ),
        F.lit("\n源码片段：\n```text\n"), F.col("chunk"), F.lit("\n```"),
    )
    return _document(own, "route_handler_chunk", F.concat("verbs", F.lit("::"), "route_path"), F.concat("repo_id", F.lit("::"), "route_ref", F.lit(" 接口源码片段")), content, _route_metadata("route_handler_chunk"))
