"""Near-duplicate records by an exact grouped prefix join on word shingles.

Two texts are near duplicates if the sets of their word shingles have a Jaccard similarity of at least a threshold. Shingles are
put in one global order, rare ones first; two similar texts then share a shingle among the first n - ceil(t n) + 1 of
each. Texts with equal shingle sets are one class, classes with equal prefix and size are one group. Only groups are
joined on prefix shingles, filtered by size and by the number of shared prefix shingles; the surviving pairs of groups are
expanded to pairs of classes, these are verified on the whole sets, and members come in at the end.

A shingle that very many texts hold (boilerplate) would bring all their groups into one task. Its groups are dealt out to blocks
by their hash, and each meets every block, itself included, under a key of its own: every pair of groups meets once, in tasks of
bounded size. Members of large classes and groups are dealt out in the same way.

The order comes from a table of BUCKETS counters over all texts (a fixed size, whatever the corpus); any order gives the
same result, a better one gives fewer candidates. Copies meet only as members of a class, never in the join.

Results: texts that are null or of fewer than `min_words` words have no links; repeated rows of a key count once; a key with
several texts has the links of each of them; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm.words import hashes, word_hash, words
from repolith.session import cut, spread

BUCKETS = 1 << 20
#: The counters travel in so many pieces, so that their sum is spread over tasks.
PIECES = 64
#: Bytes of a shingle's hash that are kept in the join and in the verified sets; two of a pair's shingles clash once in 10 ** 14 cases.
PACKED = 6
#: Bits of the table that spares texts without any candidate from being read a third time.
KEY_BITS = 26
UNIT_CHARS = 2_000_000
#: Groups that a task remembers, to pass on the prefix of copies only once; results don't depend on it.
KEPT_GROUPS = 1_000_000
#: Groups, classes or members that meet under one key of a join; those beyond are dealt out to more keys.
BLOCK = 4_096


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _units(batch: pa.RecordBatch, min_words: int) -> Iterator[tuple[np.ndarray, list[list[str]]]]:
    """Row numbers and words of the texts that are long enough. The last column holds the texts."""
    rows: list[int] = []
    lists: list[list[str]] = []
    held = 0
    for k, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
        if text is None:
            continue
        tokens = words(text)
        if len(tokens) >= min_words:
            rows.append(k)
            lists.append(tokens)
            held += len(text)
            if held >= UNIT_CHARS:
                yield np.array(rows), lists
                rows, lists, held = [], [], 0
    if rows:
        yield np.array(rows), lists


def shingles(lists: list[list[str]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner (place in lists) and hash of each shingle of `width` words, repeats included; every list has at least width words."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    values = hashes(chain.from_iterable(lists), int(sizes.sum()))
    mixed = np.zeros(len(values) - width + 1, dtype=np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + values[k : k + len(mixed)]
    mixed = _mixed(mixed)
    owner = np.repeat(np.arange(len(lists)), sizes)
    whole = owner[: len(mixed)] == owner[width - 1 :]
    return owner[: len(mixed)][whole], mixed[whole]


def _distinct_sorted(owner: np.ndarray, value: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, owner) if weight is None else (value, weight, owner))
    owner, value = owner[order], value[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
    return owner[new], value[new]


def _bucket(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _gathered(df: DataFrame, fill: Callable[[np.ndarray, pa.RecordBatch, set[int]], None], cells: int, kind: type, merge: np.ufunc) -> np.ndarray:
    """A table of a fixed number of cells that every task fills from its rows; the tasks' tables are merged by executors, in pieces."""
    width = cells // PIECES

    def rows(tables: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(tables), type=pa.int32()), pa.array([t.tobytes() for t in tables.values()], type=pa.binary())], names=["piece", "cells"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, dtype=kind)
        seen: set[int] = set()
        for batch in batches:
            fill(table, batch, seen)
        parts = {k: p for k, p in enumerate(table.reshape(PIECES, -1)) if p.any()}
        if parts:
            yield rows(parts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(held, dtype=kind)
                tables[piece] = merge(tables[piece], part) if piece in tables else part
        if tables:
            yield rows(tables)

    schema = "piece int, cells binary"
    whole = np.zeros((PIECES, width), dtype=kind)
    # at most PIECES rows of a fixed size, however many texts there are
    for row in df.mapInArrow(local, schema).repartition("piece").mapInArrow(merged, schema).collect():
        whole[row.piece] = np.frombuffer(row.cells, dtype=kind)
    return whole.reshape(-1)


def shingle_counts(texts: DataFrame, width: int, min_words: int) -> np.ndarray:
    """How many texts hold a shingle of each bucket; copies within a task count once."""

    def fill(table: np.ndarray, batch: pa.RecordBatch, seen: set[int]) -> None:
        for _, lists in _units(batch, min_words):
            owner, value = _distinct_sorted(*shingles(lists, width))
            of_set = np.add.reduceat(_mixed(value + np.uint64(1)), np.searchsorted(owner, np.arange(len(lists))))
            new = np.array([c not in seen and seen.add(c) is None for c in of_set.tolist()])
            if len(seen) > KEPT_GROUPS:
                seen.clear()
            np.add.at(table, _bucket(value[new[owner]]), 1)

    return _gathered(texts.select("text"), fill, BUCKETS, np.uint32, np.add)


def _key_bits(kinds: list[str], keys: list[str]) -> np.ndarray:
    return np.fromiter((word_hash(f"{a}/{b}") >> (64 - KEY_BITS) for a, b in zip(kinds, keys, strict=True)), dtype=np.int64, count=len(keys))


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit table of 2 ** KEY_BITS bits with the hashes of (kind, key); a fixed size, so a filter of rows and no more."""

    def fill(table: np.ndarray, batch: pa.RecordBatch, _: set[int]) -> None:
        at = _key_bits(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))

    return _gathered(keys.select("kind", "key"), fill, (1 << KEY_BITS) // 8, np.uint8, np.bitwise_or)


def _list_column(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _meeting_keys(shingle: np.ndarray, held: np.ndarray, group: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which groups meet on their shingles, and how many each shingle has; held: how many texts hold the shingle. Groups of a frequent shingle
    are in blocks, and a pair of groups has the key of its pair of blocks in common, no other."""
    blocks = -(-held.astype(np.int64) // block)
    blocks[blocks < 1] = 1
    key = np.repeat(shingle, blocks)
    if len(key) == len(shingle):
        return key, blocks
    parts = np.repeat(blocks, blocks)
    other = np.arange(len(key)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = ((np.repeat(group, blocks) >> np.uint64(8)) % parts.astype(np.uint64)).astype(np.int64)
    cell = np.minimum(own, other) * parts + np.maximum(own, other) + 1
    return np.where(parts > 1, _mixed(key + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), key), blocks


def _prefixes(texts: DataFrame, counts: np.ndarray, width: int, min_words: int, percent: int, block: int) -> DataFrame:
    """For each long enough text: its class (hash of the set), group (hash of prefix, size and kind), size and prefix."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        seen: set[int] = set()
        for batch in batches:
            for rows, lists in _units(batch, min_words):
                owner, value = shingles(lists, width)
                owner, value = _distinct_sorted(owner, value, common[_bucket(value)])
                sizes = np.bincount(owner, minlength=len(lists))
                begin = np.cumsum(sizes) - sizes
                length = sizes - (percent * sizes + 99) // 100 + 1
                first = np.arange(len(value)) - begin[owner] < length[owner]
                kinds = np.fromiter((word_hash(k or "") for k in batch.column(0).take(pa.array(rows)).to_pylist()), dtype=np.uint64, count=len(rows))
                of_set = np.add.reduceat(_mixed(value + np.uint64(1)), begin) ^ kinds
                in_front = _mixed(value ^ np.uint64(0x5851F42D4C957F2D))
                in_front[~first] = 0
                group = _mixed(np.add.reduceat(in_front, begin) ^ kinds + sizes.astype(np.uint64))
                # copies within a task pass their prefix on once
                repeated = np.array([g in seen or seen.add(g) is not None for g in group.tolist()])
                if len(seen) > KEPT_GROUPS:
                    seen.clear()
                first &= ~repeated[owner]
                key, keys = _meeting_keys((value ^ kinds[owner])[first], common[_bucket(value[first])], group[owner[first]], block)
                length = np.bincount(np.repeat(owner[first], keys), minlength=len(lists))
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(0), taken.column(1), pa.array(of_set.view(np.int64)), pa.array(group.view(np.int64)), pa.array(sizes.astype(np.int32)), _list_column(key >> np.uint64(16), length)],
                    names=["kind", "key", "class", "group", "size", "prefix"],
                )

    return texts.mapInArrow(run, "kind string, key string, class bigint, group bigint, size int, prefix array<bigint>")


def _sets(texts: DataFrame, wanted: np.ndarray, width: int, min_words: int) -> DataFrame:
    """(class, shingles) of the texts whose key may be among the wanted ones; PACKED bytes of each shingle hash, in order."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            at = _key_bits(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            batch = batch.filter(pa.array((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for rows, lists in _units(batch, min_words):
                owner, value = _distinct_sorted(*shingles(lists, width))
                sizes = np.bincount(owner, minlength=len(lists))
                begin = np.cumsum(sizes) - sizes
                kinds = np.fromiter((word_hash(k or "") for k in batch.column(0).take(pa.array(rows)).to_pylist()), dtype=np.uint64, count=len(rows))
                of_set = np.add.reduceat(_mixed(value + np.uint64(1)), begin) ^ kinds
                packed = value.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :PACKED].tobytes()
                ends = np.cumsum(sizes) * PACKED
                held = [packed[a:b] for a, b in zip((ends - sizes * PACKED).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(of_set.view(np.int64)), pa.array(held, type=pa.binary())], names=["class", "shingles"])

    return texts.mapInArrow(run, "class bigint, shingles binary")


def _unpacked(held: bytes) -> np.ndarray:
    raw = np.frombuffer(held, dtype=np.uint8).reshape(-1, PACKED)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :PACKED] = raw
    return wide.view(">u8").reshape(-1)


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (class_a, class_b) whose sets shingles_a and shingles_b are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = _unpacked(a), _unpacked(b)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared * 100 >= (len(x) + len(y) - shared) * percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["class_a", "class_b"]).filter(pa.array(keep, type=pa.bool_()))

    return pairs.select("class_a", "class_b", "shingles_a", "shingles_b").mapInArrow(run, "class_a bigint, class_b bigint")


def _parts(rows: DataFrame, owner: str, block: int) -> DataFrame:
    """(owner, parts): the owners with more than `block` rows and the parts that these are dealt out to; usually a few or none."""
    return rows.groupBy(owner).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts")).where("parts > 1")


def _own_part(item: str, parts: str = "parts") -> F.Column:
    return F.pmod(F.xxhash64(item), F.coalesce(F.col(parts), F.lit(1))).cast("int")


def _within(rows: DataFrame, owner: str, item: str, block: int = BLOCK) -> DataFrame:
    """Pairs of an owner's rows, item_a < item_b, columns with the endings _a and _b; large owners meet in cells of two parts each."""
    columns = rows.columns
    own, n = _own_part(item), F.coalesce(F.col("parts"), F.lit(1))
    cells = F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.least(own, x) * n + F.greatest(own, x))
    dealt = rows.join(_parts(rows, owner, block), owner, "left").select(*columns, F.explode(cells).alias("cell"))
    a, b = (dealt.select(owner, "cell", *(F.col(c).alias(f"{c}_{s}") for c in columns if c != owner)) for s in "ab")
    return a.join(b, [owner, "cell"]).where(F.col(f"{item}_a") < F.col(f"{item}_b"))


def _between(pairs: DataFrame, rows: DataFrame, owner: str, block: int = BLOCK) -> DataFrame:
    """For each pair of owners (owner_a, owner_b) all pairs of their rows, columns with the endings _a and _b; large owners are joined in parts."""
    columns = [c for c in rows.columns if c != owner]
    parts = _parts(rows, owner, block)
    found = pairs
    for s in "ab":
        n = parts.withColumnRenamed(owner, f"{owner}_{s}")
        found = found.join(n, f"{owner}_{s}", "left").withColumn(f"part_{s}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    for s in "ab":
        dealt = rows.join(parts, owner, "left").select(F.col(owner).alias(f"{owner}_{s}"), _own_part(columns[-1]).alias(f"part_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in columns))
        found = found.join(dealt, [f"{owner}_{s}", f"part_{s}"])
    return found


def class_links(texts: DataFrame, width: int = 5, percent: int = 80, min_words: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, links) of texts with the columns kind, key and text, linked only within a kind.

    members: (kind, key, class), a row for each text that has at least min_words words; links: (class_a, class_b), class_a <
    class_b, for each pair of classes whose shingle sets are similar. Members of one class have equal sets. block: how many rows meet under one key.
    """
    min_words = max(width, min_words or 0)
    texts = spread(texts.select("kind", "key", "text").where("text is not null"))
    counts = shingle_counts(texts, width, min_words)
    made = cut(_prefixes(texts, counts, width, min_words, percent, block))
    members = made.select("kind", "key", "class").distinct()
    classes = made.groupBy("class").agg(F.min("kind").alias("kind"), F.min("key").alias("key"), F.min("group").alias("group"))

    # Partitioned by shingle, copies from different tasks are dropped where they are and the join needs no other exchange.
    posting = made.select("group", "size", F.explode("prefix").alias("shingle")).repartition("shingle").dropDuplicates(["shingle", "group"])
    a, b = (posting.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("group", "size"))) for s in "ab")
    group_pairs = (
        a.join(b, "shingle")
        .where("group_a < group_b")
        .where((F.col("size_a") * 100 >= F.col("size_b") * percent) & (F.col("size_b") * 100 >= F.col("size_a") * percent))
        .groupBy("group_a", "group_b")
        .agg(F.count(F.lit(1)).alias("shared"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    )
    # Of the two prefixes, all common shingles up to the end of the one that ends first have been counted; behind it there are at
    # most ceil(t n) - 1 more.
    least = F.ceil((F.col("size_a") + F.col("size_b")) * F.lit(percent) / F.lit(100 + percent) - 1e-9)
    behind = F.ceil(F.greatest("size_a", "size_b") * F.lit(percent) / F.lit(100) - 1e-9) - 1
    group_pairs = group_pairs.where(F.col("shared") + behind >= least).select("group_a", "group_b")
    across = _between(group_pairs, classes.select("group", "class"), "group", block).select("class_a", "class_b")
    within = _within(classes.select("group", "class"), "group", "class", block).select("class_a", "class_b")
    pairs = cut(across.union(within).select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")).distinct())

    needed = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    wanted = key_filter(classes.join(needed, "class", "left_semi"))
    sets = _sets(texts, wanted, width, min_words).dropDuplicates(["class"])
    one, other = (sets.select(F.col("class").alias(f"class_{s}"), F.col("shingles").alias(f"shingles_{s}")) for s in "ab")
    links = _verified(pairs.join(one, "class_a").join(other, "class_b"), percent)
    return members, cut(links)


def linked_keys(members: DataFrame, links: DataFrame, block: int = BLOCK) -> DataFrame:
    """(kind, key_a, key_b), key_a < key_b, of each pair of different keys that are linked, copies included."""
    near = _between(links, members, "class", block).select(F.col("kind_a").alias("kind"), F.col("key_a").alias("one"), F.col("key_b").alias("other"))
    same = _within(members, "class", "key", block).select("kind_a", "key_a", "key_b")
    return near.union(same).where("one <> other").select("kind", F.least("one", "other").alias("key_a"), F.greatest("one", "other").alias("key_b")).distinct()


def linked_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, key, class, links): one row for each text with its class and the number of texts it is similar to."""
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    both = links.union(links.select("class_b", "class_a")).toDF("class", "other")
    near = both.join(sizes.select(F.col("class").alias("other"), "n"), "other").groupBy("class").agg(F.sum("n").alias("near"))
    return members.join(sizes, "class").join(near, "class", "left").select("kind", "key", "class", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
