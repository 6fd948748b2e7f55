"""Vectors: exact nearest neighbours by cosine, an index of inverted lists with exact re-ranking, upserts, deletes and counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are sent to every task at once; more of them are taken in blocks.
BLOCK_QUERIES = 4096
#: Rows on which the centres of the index are fitted.
SAMPLE_ROWS = 20_000
#: Rows of a list that one task takes at once.
PART_ROWS = 100_000


def distance_to_score(distance: Column) -> Column:
    """1 / (1 + d); 0 for null."""
    return F.coalesce(1.0 / (1.0 + distance), F.lit(0.0))


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k nearest rows of the corpus for each query, itself left out; ties by id.

    A stated set of queries goes over all rows in blocks: every task keeps its best k per query, and the tasks' bests are ranked. Rows and
    queries with null or zero vectors have no neighbours. For many queries take `candidates`, whose work doesn't grow with rows times queries.
    """
    corpus = _usable(corpus)
    rows = _usable(queries).withColumnRenamed("vec_id", "query_id")
    blocks = (rows.count() + BLOCK_QUERIES - 1) // BLOCK_QUERIES
    kind = corpus.schema["vec_id"].dataType.simpleString()
    found = []
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()  # about BLOCK_QUERIES rows
        ids = [r.query_id for r in part]
        shared = corpus.sparkSession.sparkContext.broadcast((ids, _unit(np.array([r.embedding for r in part], dtype=np.float64))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, wanted = shared.value
            held_ids: pa.Array | None = None  # the best of the task so far, a row of scores and of places for each query
            held = np.full((len(names), 0), -np.inf)
            place = np.zeros((len(names), 0), dtype=np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                score = wanted @ _unit(np.array(batch.column(1).to_pylist(), dtype=np.float64)).T
                every = np.concatenate([held, score], axis=1)
                places = np.concatenate([place, np.broadcast_to(np.arange(batch.num_rows) + (0 if held_ids is None else len(held_ids)), score.shape)], axis=1)
                ids = batch.column(0) if held_ids is None else pa.concat_arrays([held_ids, batch.column(0)])
                # ties at the last place stay, so that the order by id decides on them
                n = min(k + 1, every.shape[1])
                least = np.partition(np.round(every, 6), every.shape[1] - n, axis=1)[:, every.shape[1] - n]
                keep = np.round(every, 6) >= least[:, None]
                widest = int(keep.sum(axis=1).max())
                order = np.argsort(~keep, axis=1, kind="stable")[:, :widest]
                held = np.where(np.take_along_axis(keep, order, axis=1), np.take_along_axis(every, order, axis=1), -np.inf)
                used, inverse = np.unique(np.take_along_axis(places, order, axis=1), return_inverse=True)
                held_ids, place = ids.take(pa.array(used)), inverse.reshape(order.shape)
            if held_ids is not None:
                q, c = np.nonzero(np.isfinite(held))
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in q], type=held_ids.type), held_ids.take(pa.array(place[q, c])), pa.array(held[q, c])], names=["query_id", "vec_id", "cosine"])

        found.append(corpus.mapInArrow(run, f"query_id {kind}, vec_id {kind}, cosine double"))
    if not found:
        return corpus.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("cosine"), F.lit(0).alias("rank"))
    everything = reduce(DataFrame.union, found).where("query_id <> vec_id").withColumn("cosine", F.round("cosine", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return everything.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    return unit


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))).select("vec_id", "embedding")


def fit_lists(corpus: DataFrame, lists: int, total: int, sample_rows: int = SAMPLE_ROWS, rounds: int = 8) -> np.ndarray:
    """Centres of an index of inverted lists: k-means by cosine on at most sample_rows rows, chosen by the hash of their id."""
    share = min(1.0, 1.2 * sample_rows / max(total, 1))
    bound = int(share * (1 << 30))
    rows = corpus.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) < bound).select("embedding").limit(sample_rows).collect()  # bounded by sample_rows
    if not rows:
        return np.zeros((0, 0))
    points = _unit(np.array([r.embedding for r in rows], dtype=np.float64))
    if len(points) <= lists:
        return points
    centres = points[np.random.default_rng(5).choice(len(points), lists, replace=False)]
    for _ in range(rounds):
        near = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(np.bincount(near, minlength=lists)[:, None] > 0, _unit(sums), centres)
    return centres


def listed(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(vec_id, list, embedding): every row under the `probes` nearest centres."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = _unit(np.array(batch.column(1).to_pylist(), dtype=np.float64)) @ shared.value.T
            n = min(probes, score.shape[1])
            nearest = np.argpartition(-score, n - 1, axis=1)[:, :n]
            owner = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(nearest.reshape(-1).astype(np.int32)), batch.column(1).take(owner).cast(pa.list_(pa.float64()))], names=["vec_id", "list", "embedding"])

    return rows.mapInArrow(run, f"vec_id {kind}, list int, embedding array<double>")


def candidates(corpus: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None, probes: int = 12) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k best rows for each query among the lists that it probes, re-ranked by the exact cosine; ties by id.

    Every row is indexed; a query meets the rows of `probes` lists, whose number grows with the root of the rows. A list is dealt out to parts of about PART_ROWS by the
    hash of its rows, so that a crowded one is several tasks' work; each part keeps its best k of a query before they are ranked together. Recall is measured against
    `nearest` in the tests.
    """
    corpus, queries = _usable(corpus), _usable(queries)
    total = corpus.count()
    lists = lists or max(16, min(int(total**0.5), SAMPLE_ROWS // 20))
    parts = -(-total // (lists * PART_ROWS)) + 1
    centres = fit_lists(corpus, lists, total)
    if not len(centres):
        return corpus.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("cosine"), F.lit(0).alias("rank"))
    kind = corpus.schema["vec_id"].dataType.simpleString()
    rows = listed(corpus, centres, 1).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("asks", F.lit(False))
    asked = listed(queries, centres, probes).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("asks", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the partition is sorted by (list, part): the rows of one key are side by side
        key: tuple[int, int] | None = None
        held: list[pa.RecordBatch] = []

        def ranked() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            asks = np.array(table.column("asks").to_pylist(), dtype=bool)
            ids = table.column("vec_id").combine_chunks()
            vectors = _unit(np.array(table.column("embedding").to_pylist(), dtype=np.float64))
            q, c = np.nonzero(asks)[0], np.nonzero(~asks)[0]
            if len(q) and len(c):
                for begin in range(0, len(q), BLOCK_QUERIES):
                    mine = q[begin : begin + BLOCK_QUERIES]
                    score = np.round(vectors[mine] @ vectors[c].T, 6)
                    n = min(k + 1, len(c))
                    least = np.partition(score, len(c) - n, axis=1)[:, len(c) - n]
                    a, b = np.nonzero(score >= least[:, None])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine[a])), ids.take(pa.array(c[b])), pa.array(score[a, b])], names=["query_id", "vec_id", "cosine"])

        for batch in batches:
            keys = np.array([batch.column(1).to_numpy(), batch.column(2).to_numpy()]).T
            cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(keys)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                own = tuple(keys[x].tolist())
                if key is not None and own != key:
                    yield from ranked()
                    held = []
                key = own
                held.append(batch.slice(x, y - x))
        if held:
            yield from ranked()

    met = rows.unionByName(asked).select("vec_id", "list", "part", "embedding", "asks").repartition("list", "part").sortWithinPartitions("list", "part").mapInArrow(run, f"query_id {kind}, vec_id {kind}, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return met.where("query_id <> vec_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def deleted(stored: DataFrame, repos: DataFrame) -> DataFrame:
    """stored without the rows of the repositories in repos."""
    return stored.join(repos.select("repo_id").where("repo_id is not null").distinct(), "repo_id", "left_anti")


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with new's rows in place of those of the same key; of new rows with one key the last by all columns counts."""
    order = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in new.columns if c != key))
    new = new.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def health(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row with the distinct repositories and documents of both stores."""
    count = lambda df, name: df.agg(F.count_distinct("repo_id").alias(f"{name}_repos"), F.count_distinct("doc_id").alias(f"{name}_documents"))
    return count(documents, "local").crossJoin(F.broadcast(count(vectors, "vector")))
