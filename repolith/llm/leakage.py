"""Passages of held-out texts inside a corpus, found by spaced seeds.

A spaced seed is a fixed mask over a window of words: the hash of a window uses only the selected positions, so that
substituted words at the other positions don't hide a match. The seeds of the held-out texts and of the corpus are
joined; every hit names a diagonal (corpus position minus held-out position), and around the hits each diagonal is
compared word by word: the longest exact run, and the best overlap that tolerates substitutions. Any passage of at least
SPAN equal words in a row is sure to be hit, by each mask.

The corpus is read once for its seeds and once for the comparison of the documents that have hits. The held-out side is
counted first: within MAX_SEEDS it is broadcast and a bit table of its seeds filters corpus seeds as they are made; beyond
it both sides are shuffled by seed.

Results: null and empty texts have no words and no hits; repeated rows count once; equal passages in several held-out texts
give a row for each of them. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm.words import hashes, word_hash, words
from repolith.session import broadcast_if_small, cut, spread

#: Selected positions of the masks; all start at 0 and end at SPAN - 1.
MASKS = ((0, 1, 3, 4, 7, 9, 10, 12, 14, 15), (0, 2, 3, 5, 6, 8, 11, 12, 13, 15))
SPAN = 16
#: Seeds, and distinct words, of the held-out side up to which it is sent to every task (16 bytes each).
MAX_SEEDS = 2_000_000
#: Characters of the held-out texts up to which their words are sent to every task.
MAX_TEST_CHARS = 50_000_000
#: Rows of candidate diagonals up to which they are broadcast to the second read of the corpus.
MAX_CANDIDATES = 500_000
FILTER_BITS = 22
#: A tolerant overlap gains 1 for an equal word and loses this for a substituted one.
MISMATCH = 4
#: Documents are cut into units of so many characters for the array work; a longer text is a unit of its own.
UNIT_CHARS = 2_000_000


def _factors(mask: int) -> list[np.uint64]:
    return [np.uint64(word_hash(f"{mask}/{k}") | 1) for k in range(len(MASKS[mask]))]


def seeds_of(values: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of word hashes of texts that lie one after another: the places and seeds of each mask. 0 stands for a word that can't match."""
    n = len(values)
    if n < SPAN:
        return
    ends = np.repeat(np.cumsum(sizes), sizes)
    fits = np.nonzero(ends[: n - SPAN + 1] - np.arange(n - SPAN + 1) >= SPAN)[0]
    known = values != 0
    for m, mask in enumerate(MASKS):
        at = fits
        for k in (0, *mask[:0:-1]):
            at = at[known[at + k]]
        seed = np.zeros(len(at), dtype=np.uint64)
        for k, factor in zip(mask, _factors(m), strict=True):
            seed += values[at + k] * factor
        seed ^= seed >> np.uint64(29)
        yield at, seed


def _units(keys: list, texts: list[str]) -> Iterator[tuple[list, list[list[str]]]]:
    part: list[list[str]] = []
    names: list = []
    held = 0
    for key, text in zip(keys, texts, strict=True):
        part.append(words(text))
        names.append(key)
        held += len(text)
        if held >= UNIT_CHARS:
            yield names, part
            part, names, held = [], [], 0
    if part:
        yield names, part


def _seed_table(df: DataFrame, vocabulary: dict[str, int] | None, bits: np.ndarray | None) -> DataFrame:
    """(id, place, seed) of the columns id and text. vocabulary: words beyond it can't match. bits: seeds beyond it can't match."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, lists in _units(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
                tokens, n = chain.from_iterable(lists), int(sizes.sum())
                values = hashes(tokens, n) if vocabulary is None else np.fromiter(map(vocabulary.get, tokens, repeat(0)), dtype=np.uint64, count=n)
                owner = np.repeat(np.arange(len(names)), sizes)
                begin = np.cumsum(sizes) - sizes
                for at, seed in seeds_of(values, sizes):
                    if bits is not None:
                        keep = bits[(seed & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]
                        at, seed = at[keep], seed[keep]
                    own = owner[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[k] for k in own], type=batch.schema.field(0).type), pa.array(at - begin[own]), pa.array(seed.view(np.int64))], names=["id", "place", "seed"]
                    )

    return df.select("id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, place bigint, seed bigint")


def _overlaps(corpus: list[str], held_out: list[str], diagonals: list[int]) -> tuple[int, int, int, int]:
    """Longest exact run, and start (word of the corpus text), words and equal words of the best tolerant overlap, over all diagonals."""
    a, b = hashes(corpus, len(corpus)), hashes(held_out, len(held_out))
    best = (0, 0, 0, 0)
    longest = 0
    top = 0
    for d in diagonals:
        lo, hi = max(0, d), min(len(a), len(b) + d)
        same = a[lo:hi] == b[lo - d : hi - d]
        if not same.any():
            continue
        breaks = np.concatenate([[-1], np.nonzero(~same)[0], [len(same)]])
        longest = max(longest, int(np.diff(breaks).max()) - 1)
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
        least = np.minimum.accumulate(total)
        end = int(np.argmax(total - least))
        score = int(total[end] - least[end])
        if score > top:
            start = int(np.argmin(total[: end + 1]))
            top, best = score, (0, lo + start, end - start, int(same[start:end].sum()))
    return (longest, *best[1:])


def overlaps(corpus: DataFrame, key: str, text: str, held_out: DataFrame, held_key: str, held_text: str) -> DataFrame:
    """(key, held_key, run_words, overlap_start, overlap_words, equal_words) for each pair of texts with a seed in common."""
    docs = spread(corpus.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null"))
    tests = held_out.select(F.col(held_key).alias("id"), F.col(held_text).alias("text")).where("text is not null").distinct()
    test_seeds = _seed_table(tests, None, None).select(F.col("id").alias("held"), F.col("place").alias("held_place"), "seed")
    sized = cut(test_seeds)
    vocabulary = bits = None
    # held-out texts too short for a seed count with their characters
    if sized.count() <= MAX_SEEDS and (tests.agg(F.sum(F.length("text"))).first()[0] or 0) <= MAX_TEST_CHARS:
        sized = F.broadcast(sized)
        vocabulary = {}
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for row in sized.select("seed").distinct().toLocalIterator():
            bits[row.seed & ((1 << FILTER_BITS) - 1)] = True
        for row in tests.toLocalIterator():
            vocabulary.update((w, word_hash(w)) for w in words(row.text))
    hits = _seed_table(docs, vocabulary, bits).join(sized, "seed").select("id", "held", (F.col("place") - F.col("held_place")).alias("diagonal"))
    found = broadcast_if_small(hits.groupBy("id", "held").agg(F.collect_set("diagonal").alias("diagonals")), MAX_CANDIDATES)
    sides = docs.join(found, "id").join(tests.select(F.col("id").alias("held"), F.col("text").alias("held_text")), "held")
    kinds = f"`{key}` {corpus.schema[key].dataType.simpleString()}, `{held_key}` {held_out.schema[held_key].dataType.simpleString()}"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tested, diagonals = (batch.column(k).to_pylist() for k in (2, 3, 4))
            rows = [_overlaps(words(t), words(h), d) for t, h, d in zip(texts, tested, diagonals, strict=True)]
            values = [pa.array([r[k] for r in rows], type=pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], names=[key, held_key, "run_words", "overlap_start", "overlap_words", "equal_words"])

    return sides.select("id", "held", "text", "held_text", "diagonals").mapInArrow(compare, f"{kinds}, run_words bigint, overlap_start bigint, overlap_words bigint, equal_words bigint")
