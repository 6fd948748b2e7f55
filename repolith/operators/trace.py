"""Following calls from document to document: targets, the best next document, bounded traces, and the chains that they make.

A trace is set-based: every step follows all questions at once, from the documents reached before to the best document of each of their
targets, and a window cuts each question to its budget of steps. Documents are looked up over expanded keys in equality joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import text as T
from repolith.operators import codeindex as C
from repolith.session import cut

# Relation types that are followed from documents of a type.
CALLS = ["call", "delegate_service", "delegate_repository"]
FOLLOWED = {
    "api_route_summary": ["handle_route", *CALLS],
    "route_handler_chunk": ["handle_route", *CALLS],
    "class_summary": ["define_method"],
    "class_body_chunk": ["define_method"],
    "key_file_summary": ["handle_route", "define_method", *CALLS],
    "entrypoint_summary": ["handle_route", "define_method", *CALLS],
    "config_summary": ["handle_route", "define_method", *CALLS],
    "config_chunk": ["handle_route", "define_method", *CALLS],
}
MODULE_TYPES = ["key_file_summary", "entrypoint_summary", "config_summary", "config_chunk"]
ROUTE_TYPES = ["api_route_summary", "route_handler_chunk"]
# How good a document type is as the beginning of a trace, by focus.
ROOT_PRIORITY = {
    "api": {"route_handler_chunk": 5, "api_route_summary": 4, "function_body_chunk": 4, "function_summary": 3, "class_body_chunk": 2, "class_summary": 2},
    "implementation": {"function_body_chunk": 5, "function_summary": 4, "class_body_chunk": 4, "class_summary": 3, "api_route_summary": 2, "route_handler_chunk": 2},
    "architecture": {"route_handler_chunk": 4, "api_route_summary": 4, "key_file_summary": 4, "entrypoint_summary": 3, "config_summary": 3, "config_chunk": 3, "function_body_chunk": 3, "function_summary": 3, "class_body_chunk": 3, "class_summary": 3},
}
# Order of document types as the next step.
NEXT_PRIORITY = ["function_body_chunk", "function_summary", "route_handler_chunk", "api_route_summary", "class_body_chunk", "class_summary"]
# Words that tell what a question is about, in the order in which they are tried.
FOCUS_WORDS = {
    "implementation": ["实现", "实现逻辑", "怎么实现", "如何实现", "代码", "源码", "函数", "方法", "类", "具体功能"],
    "architecture": ["架构", "模块", "依赖关系", "调用链", "子项目", "monorepo", "workspace"],
    "startup": ["启动", "运行", "命令", "run", "start"],
    "entrypoint": ["入口", "main", "entrypoint"],
    "env": ["环境变量", "env", "配置项"],
    "service": ["数据库", "缓存", "redis", "mysql", "postgres", "服务依赖"],
    "config": ["配置", "构建", "打包", "依赖"],
    "overview": ["做什么", "是什么", "介绍", "概述", "overview", "purpose", "用途", "功能"],
}
MAX_STEPS, MAX_DEPTH = 6, 2


def infer_focus(question: Column) -> Column:
    """What a question is about: api by a verb with a route or a route with its words, else the first list with a word in it."""
    low = F.lower(T.text(question))
    any_of = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    chain = F.when(low.rlike(r"\b(get|post|put|delete|patch|options|head)\b\s+" + T.ROUTE), "api").when(low.rlike(T.ROUTE) & any_of(["接口", "路由", "api", "endpoint"]), "api")
    for focus, words in FOCUS_WORDS.items():
        chain = chain.when(any_of(words), focus)
    return chain.otherwise("generic")


def _field(name: str) -> Column:
    return F.coalesce(F.try_element_at("metadata", F.lit(name)), F.array().cast("array<string>"))


def follow_targets(documents: DataFrame) -> DataFrame:
    """(repo_id, doc_id, source_path, target_ref, relation_type, seq): where each document leads on: its edges of the types followed from it, the modules of files and
    configurations, the handler of a route, and the symbols that it calls; each target and type once."""
    zipped = F.arrays_zip(_field("code_relation_targets").alias("target_ref"), _field("code_relation_types").alias("relation_type"))
    kind = F.col("doc_type")
    allowed = reduce(lambda chain, k: chain.when(kind == k, F.array(*map(F.lit, FOLLOWED[k]))), FOLLOWED, F).otherwise(F.array(*map(F.lit, CALLS)))
    target = lambda values, relation: F.transform(values, lambda v: F.struct(v.alias("target_ref"), F.lit(relation).alias("relation_type")))
    none = F.slice(target(_field("called_symbols"), "call"), 1, 0)
    edges = F.filter(zipped, lambda e: F.array_contains(allowed, e["relation_type"]))
    modules = F.when(kind.isin(MODULE_TYPES), target(_field("module_relation_targets"), "import_module")).otherwise(none)
    handler = F.when(kind.isin(ROUTE_TYPES), target(F.slice(F.concat(_field("handler_qualified_name"), _field("handler_name")), 1, 1), "handle_route")).otherwise(none)
    every = F.filter(F.array_distinct(F.concat(modules, edges, handler, target(_field("called_symbols"), "call"))), lambda e: T.strip(e["target_ref"]) != "")
    return documents.select("repo_id", "doc_id", "source_path", F.posexplode(every).alias("seq", "t")).select("repo_id", "doc_id", "source_path", F.col("t.target_ref").alias("target_ref"), F.col("t.relation_type").alias("relation_type"), "seq")


def named_symbols(documents: DataFrame) -> DataFrame:
    """(repo_id, doc_id, doc_type, source_path, symbol): the symbols that a document stands for: of its id, its metadata and its line of symbols."""
    parts = F.split("doc_id", "::")
    own = F.when(F.size(parts) >= 4, F.array(F.element_at(parts, -1))).otherwise(F.array().cast("array<string>"))
    listed = F.split(T.prefixed_value(F.col("content"), "symbols:"), r",\s*")
    fields = [_field(f) for f in ("qualified_name", "symbol_name", "handler_qualified_name", "handler_name", "route_path", "code_entity_refs", "code_entity_names")]
    return documents.select("repo_id", "doc_id", "doc_type", "source_path", F.explode(T.ordered_distinct(F.concat(own, *fields, listed))).alias("symbol"))


def match_score(wanted: Column, candidate: Column) -> Column:
    """6 for equal names, 4 where expanded keys meet, 2 where a key is part of the other name, else 0."""
    keys = T.expand_keys(wanted)
    return F.when(F.lower(wanted) == F.lower(candidate), 6).when(F.arrays_overlap(keys, T.expand_keys(candidate)), 4).when(F.exists(keys, lambda k: F.contains(F.lower(candidate), k)), 2).otherwise(0)


def followed(documents: DataFrame) -> DataFrame:
    """(repo_id, doc_id, target_ref, relation_type, seq, next_doc, match, rank): the documents that each target can lead to, best first: by match, the own file, type and id."""
    wanted = follow_targets(documents).withColumn("key", F.explode(T.expand_keys(F.col("target_ref"))))
    known = named_symbols(documents).select("repo_id", F.col("doc_id").alias("next_doc"), F.col("doc_type").alias("next_type"), F.col("source_path").alias("next_path"), "symbol", F.explode(T.expand_keys(F.col("symbol"))).alias("key"))
    met = wanted.join(known, ["repo_id", "key"]).where("doc_id <> next_doc")
    keys = ["repo_id", "doc_id", "target_ref", "relation_type", "seq", "next_doc"]
    scored = met.groupBy(*keys).agg(F.max(match_score(F.col("target_ref"), F.col("symbol"))).alias("match"), F.first("next_type").alias("next_type"), F.max(F.coalesce(F.col("next_path") == F.col("source_path"), F.lit(False))).alias("same_file"))
    liked = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, NEXT_PRIORITY)), F.col("next_type")), F.lit(0)), F.lit(10))
    order = Window.partitionBy("repo_id", "doc_id", "target_ref", "relation_type").orderBy(F.desc("match"), F.desc("same_file"), liked, "next_doc")
    return scored.withColumn("rank", F.row_number().over(order)).select(*keys, "match", "rank")


def best_roots(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id, root_rank): the hits of each question as beginnings: by the focus' priority of their type, shared tokens, score and id. hits: query_id, query,
    doc_id, score."""
    own = hits.join(documents.select("doc_id", "doc_type", "source_path", "metadata"), "doc_id")
    focus = infer_focus(F.col("query"))
    rank = F.lit(0)
    for name, table in ROOT_PRIORITY.items():
        for kind, value in table.items():
            rank = F.when((focus == name) & (F.col("doc_type") == kind), value).otherwise(rank)
    said = F.lower(F.concat_ws(" ", F.element_at(F.split("doc_id", "::"), -1), F.coalesce("source_path", F.lit("")), F.array_join(_field("called_symbols"), " ")))
    overlap = F.size(F.filter(T.tokenize_code(F.col("query")), lambda t: F.contains(said, t)))
    order = Window.partitionBy("query_id").orderBy(rank.desc(), overlap.desc(), F.desc("score"), "doc_id")
    return own.withColumn("root_rank", F.row_number().over(order)).select("query_id", "doc_id", "root_rank")


def traces(roots: DataFrame, documents: DataFrame, max_steps: int = MAX_STEPS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(query_id, doc_id, depth, step, parent_doc, relation_type): from each question's root on to the best documents of the targets, breadth first, at most max_steps
    followed steps and max_depth deep; a document comes once. Where the best document of a target has been reached, the next best counts.

    roots: query_id, doc_id. Two targets of one depth that lead to one document make one step.
    """
    leads = cut(followed(documents).select(F.col("doc_id").alias("parent_doc"), "relation_type", "target_ref", "seq", F.col("next_doc").alias("doc_id"), "rank"))
    seen = cut(roots.select("query_id", "doc_id", F.lit(0).alias("depth"), F.lit(0).cast("int").alias("step"), F.lit(None).cast("string").alias("parent_doc"), F.lit(None).cast("string").alias("relation_type")))
    for depth in range(1, max_depth + 1):
        frontier = seen.where(F.col("depth") == depth - 1).select("query_id", F.col("doc_id").alias("parent_doc"), F.col("step").alias("from_step"))
        reached = frontier.join(leads, "parent_doc").join(seen.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        first = Window.partitionBy("query_id", "parent_doc", "target_ref", "relation_type").orderBy("rank")
        best = reached.withColumn("n", F.row_number().over(first)).where("n = 1")
        once = best.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("from_step", "seq"))).where("k = 1")
        used = seen.groupBy("query_id").agg((F.count(F.lit(1)) - 1).alias("used"))
        order = Window.partitionBy("query_id").orderBy("from_step", "seq", "doc_id")
        fresh = once.withColumn("n", F.row_number().over(order)).join(used, "query_id").where(F.col("n") + F.col("used") <= max_steps)
        seen = cut(seen.unionByName(fresh.select("query_id", "doc_id", F.lit(depth).alias("depth"), (F.col("n") + F.col("used")).cast("int").alias("step"), "parent_doc", "relation_type")))
    return seen


def trace_lines(traces: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, step, line): every step as a line: depth, relation, label and where it comes from, location and what the document begins with."""
    label = F.element_at(F.split("doc_id", "::"), -1)
    parent = F.element_at(F.split("parent_doc", "::"), -1)
    held = traces.join(documents.select("doc_id", "source_path", "content", F.try_element_at(_field("line_start"), F.lit(1)).alias("line_start")), "doc_id")
    place = T.location(F.col("source_path"), F.col("line_start"), F.lit(None).cast("string"))
    summary = F.substring(F.replace(T.text(F.col("content")), F.lit("\n"), F.lit(" ")), 1, 80)
    line = F.concat(
        F.lit("[depth="), F.col("depth").cast("string"), F.lit("] "), F.when(F.col("relation_type").isNotNull(), F.concat(F.lit("[relation="), F.col("relation_type"), F.lit("] "))).otherwise(""),
        label, F.when(parent.isNotNull(), F.concat(F.lit(" <- "), parent)).otherwise(""), F.when(place != "", F.concat(F.lit(" @ "), place)).otherwise(""), F.lit(" -> "), summary,
    )
    return held.select("query_id", "step", line.alias("line"))


def parsed_lines(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """keys and depth, relation_type, label, parent_label and location of lines as trace_lines writes them; other lines are left out."""
    pattern = r"^\s*\[depth=(\d+)\]\s*(?:\[relation=([a-z_]+)\]\s*)?(.*?) -> "
    head = F.regexp_extract(line, pattern, 3)
    before = F.regexp_extract(head, r"^(.*?)(?: @ .*)?$", 1)
    return lines.where(F.col(line).rlike(pattern)).select(
        *keys, F.regexp_extract(line, pattern, 1).cast("int").alias("depth"), F.regexp_extract(line, pattern, 2).alias("relation_type"), T.strip(F.regexp_extract(before, r"^(.*?)(?: <- .*)?$", 1)).alias("label"),
        T.strip(F.regexp_extract(before, r" <- (.*)$", 1)).alias("parent_label"), T.strip(F.regexp_extract(head, r" @ (.*)$", 1)).alias("location"),
    )


def typed_chain(labels: Column, types: Column) -> Column:
    """'a -[type]-> b -> c' of labels and the types between them; a null type gives a plain arrow."""
    steps = F.transform(F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda x, k: F.concat(F.when(F.get(types, k).isNull(), " -> ").otherwise(F.concat(F.lit(" -["), F.get(types, k), F.lit("]-> "))), x))
    return F.concat(F.get(labels, F.lit(0)), F.array_join(steps, ""))


def parsed_chain(chain: Column) -> Column:
    """array<struct(source, relation_type, target)> of a typed chain."""
    labels = F.transform(F.split(chain, r"\s*(?:-\[[a-z_]+\])?->\s*"), T.strip)
    types = F.transform(F.regexp_extract_all(chain, F.lit(r"(?:-\[([a-z_]+)\])?->"), F.lit(1)), lambda t: F.nullif(t, F.lit("")))
    return F.transform(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))), lambda s, k: F.struct(s.alias("source"), F.get(types, k).alias("relation_type"), F.get(labels, k + 1).alias("target")))


def chain_score(labels: Column) -> Column:
    """Ten for each step, the priority of every label's role, and two for a chain that begins at a route."""
    roles = F.aggregate(F.transform(labels, C.role_priority), F.lit(0), lambda s, v: s + v)
    return F.greatest(F.size(labels) - 1, F.lit(0)) * 10 + roles + F.when(F.contains(F.get(labels, F.lit(0)), F.lit("/")), 2).otherwise(0)


def best_chains(calls: DataFrame, defined: DataFrame, limit: int) -> DataFrame:
    """(root, chain, score, rank): the `limit` best chains of at most two calls from each document, by score and text. calls, defined: repo_id, doc_id, key; a document calls
    those that are found under its keys, but not itself. A chain ends at two calls or where nothing is called; none comes back to its root.

    Neither the calls between documents nor the chains, which grow as the square and the cube of a repository, are listed. The part behind the root is ranked for each
    key, as it scores and sorts alike for all roots that call the key. Of the parts better than one of a root's best, fewer than `limit` are the root's own; the others begin at
    the root or end at it. So it is enough to keep limit + 1 ends of each document, limit + 1 documents before each end, and 3 * limit + 2 parts of each key.
    """
    label = lambda doc: F.element_at(F.split(doc, "::"), -1)

    def first(rows: DataFrame, n: int, keys: list[str], *order: Column) -> DataFrame:
        """Rows with the n first values of the order; Spark cuts each partition down before the shuffle."""
        return rows.withColumn("n", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= n).drop("n")

    at = ["repo_id", "key"]
    known = defined.select(*at, F.col("doc_id").alias("end"), C.role_priority(label(F.col("doc_id"))).alias("role"))
    ends = calls.join(first(known, limit + 2, at, F.desc("role"), F.col("end")), at).where("doc_id <> end")
    ends = first(ends, limit + 1, ["doc_id"], F.desc("role"), F.col("end")).select("doc_id", "end").distinct()
    labels = F.filter(F.array(F.lit(""), label(F.col("doc_id")), label(F.col("end"))), lambda x: x.isNotNull())
    parts = defined.join(ends, "doc_id", "left").withColumn("part", F.concat(F.lit(" -> "), "doc_id", F.coalesce(F.concat(F.lit(" -> "), "end"), F.lit("")))).withColumn("labels", labels)
    order = [F.desc("score"), F.col("part")]
    parts = first(parts.withColumn("score", chain_score(F.col("labels"))), limit + 1, [*at, "end"], *order)
    parts = first(parts, 3 * limit + 2, at, *order).withColumnRenamed("doc_id", "next")
    own = calls.withColumnRenamed("doc_id", "root").join(parts, at).where("root <> next and (end is null or root <> end)")
    # The same part comes once for each key under which it is called.
    once = first(own, limit, ["root"], *order).select("root", "part", "labels").distinct()
    chains = once.select("root", F.concat("root", "part").alias("chain"), chain_score(F.concat(F.array(label(F.col("root"))), F.slice("labels", F.lit(2), F.size("labels")))).alias("score"))
    return chains.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), "chain"))).where(F.col("rank") <= limit)


def representative_steps(steps: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The steps that stand for a trace, with their position: the first, the last of each relation type from the end on, then the others from the end on; all of them in
    order where they are no more than limit. steps: keys, step (from 0 on), relation_type."""
    w = Window.partitionBy(*keys)
    ranked = steps.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("last", F.row_number().over(Window.partitionBy(*keys, "relation_type").orderBy(F.desc("step"))))
    first = F.col("step") == F.min("step").over(w)
    group = F.when(first, 0).when((F.col("last") == 1) & F.col("relation_type").isNotNull(), 1).otherwise(2)
    told = ranked.withColumn("group", group)
    order = Window.partitionBy(*keys).orderBy(F.when(F.col("n") <= limit, 0).otherwise(F.col("group")), F.when(F.col("n") <= limit, F.col("step")).otherwise(-F.col("step")))
    return told.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select(*keys, "position", "step", "relation_type")
