"""The code graph: entities, typed edges, joins over expanded symbol keys, levels, bounded reachability and chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions import text as T
from repolith.operators import codeindex as C
from repolith.session import cut


def all_symbols(files: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (C.symbols(files, x).withColumn("language", F.lit(x)) for x in C.SYMBOL_RULES))


def all_relations(files: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (C.relations(files, x).withColumn("language", F.lit(x)) for x in C.RELATION_RULES))


def call_edges(documents: DataFrame) -> DataFrame:
    """(repo_id, doc_id, called, relation_type): the calls that documents list in their metadata, typed by the callee's name."""
    called = documents.select("repo_id", "doc_id", F.explode(T.metadata_values(F.col("metadata"), "called_symbols")).alias("called"))
    return called.select("repo_id", "doc_id", "called", C.call_relation(F.col("called")).alias("relation_type")).distinct()


def rezipped(documents: DataFrame, first: str, second: str) -> DataFrame:
    """(doc_id, k, left, right) of two aligned metadata fields; the shorter one is padded with null."""
    field = lambda f: F.coalesce(F.try_element_at("metadata", F.lit(f)), F.array().cast("array<string>"))
    zipped = F.arrays_zip(field(first).alias("left"), field(second).alias("right"))
    return documents.select("doc_id", F.posexplode(zipped).alias("k", "e")).select("doc_id", "k", F.col("e.left").alias("left"), F.col("e.right").alias("right"))


def keys_defined(doc_id: Column, content: Column) -> Column:
    """The keys under which a document is found: of its own symbol, the last part of its id, and of those on its line of symbols."""
    parts = F.split(doc_id, "::")
    own = F.when(F.size(parts) >= 4, F.array(F.element_at(parts, -1))).otherwise(F.array().cast("array<string>"))
    listed = F.split(T.prefixed_value(content, "symbols:"), r",\s*")
    return F.array_distinct(F.flatten(F.transform(F.concat(own, listed), T.expand_keys)))


def keys_called(metadata: Column) -> Column:
    """The keys under which the calls of a document are looked up."""
    return F.array_distinct(F.flatten(F.transform(T.metadata_values(metadata, "called_symbols"), T.expand_keys)))


def defined_keys(documents: DataFrame) -> DataFrame:
    """(repo_id, doc_id, key): the keys under which a document is found."""
    return documents.select("repo_id", "doc_id", F.explode(keys_defined(F.col("doc_id"), F.col("content"))).alias("key"))


def call_targets(documents: DataFrame) -> DataFrame:
    """(repo_id, source_doc, target_doc): calls resolved to the documents of the callee in the same repository, through expanded keys."""
    calls = call_edges(documents).select("repo_id", F.col("doc_id").alias("source_doc"), F.explode(T.expand_keys(F.col("called"))).alias("key"))
    found = calls.join(defined_keys(documents).withColumnRenamed("doc_id", "target_doc"), ["repo_id", "key"])
    return found.where("source_doc <> target_doc").select("repo_id", "source_doc", "target_doc").distinct()


def levels(edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """(node, level): the longest way from a node without predecessors in a directed acyclic graph of (source, target). Nodes on or
    behind a cycle would rise without end; beyond max_depth an error is raised."""
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    now = cut(nodes.select("node", F.lit(0).alias("level")))
    for _ in range(max_depth):
        raised = edges.join(now.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg((F.max("level") + 1).alias("up"))
        following = cut(now.join(raised, "node", "left").select("node", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")))
        if following.join(now.withColumnRenamed("level", "before"), "node").where("level > before").isEmpty():
            return following
        now = following
    raise ValueError("the graph has a cycle or is deeper than max_depth")


def reachable(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, distance): nodes within `depth` steps of each root over (source, target), with the shortest distance."""
    frontier = roots.select(F.col("node").alias("root"), "node").distinct()
    seen = cut(frontier.select("root", "node", F.lit(0).alias("distance")))
    for step in range(1, depth + 1):
        at = seen.where(F.col("distance") == step - 1)
        reached = at.join(edges, at["node"] == edges["source"]).select("root", F.col("target").alias("node")).distinct()
        fresh = reached.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(step).alias("distance"))
        seen = cut(seen.union(fresh))
    return seen
