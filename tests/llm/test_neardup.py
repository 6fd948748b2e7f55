"""Near duplicates against brute force, with copies, ties, nulls and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from repolith.llm import neardup
from repolith.llm.words import words


def brute(rows, width, percent, least):
    sets = []
    for kind, key, text in rows:
        if text is None:
            continue
        w = words(text)
        if len(w) >= max(width, least):
            sets.append((kind, key, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}))
    pairs = set()
    for i, (kind, a, x) in enumerate(sets):
        for other, b, y in sets[i + 1 :]:
            if kind == other and a != b and len(x & y) * 100 >= len(x | y) * percent:
                pairs.add((kind, min(a, b), max(a, b)))
    return pairs


def corpus(seed, n):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    rows, texts = [], []
    for k in range(n):
        if texts and random.random() < 0.6:
            own = random.choice(texts).split()
            for _ in range(random.randrange(4)):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            text = " ".join(own)
        else:
            text = " ".join(random.choices(vocabulary, k=random.randrange(20, 60)))
        texts.append(text)
        rows.append(("ab"[k % 2], f"k{k}", text))
    return rows


@pytest.mark.parametrize(("width", "percent", "least", "block"), [(3, 70, 20, neardup.BLOCK), (5, 80, 0, neardup.BLOCK), (3, 70, 20, 3)])
def test_pairs_match_brute_force(spark, width, percent, least, block):
    rows = [*corpus(width, 120), ("a", "copy", "x y z " * 10), ("a", "copy", "x y z " * 10), ("a", "copy2", "X, y; z " * 10), ("b", "copy3", "x y z " * 10), ("a", "null", None), ("a", "empty", ""), ("a", "short", "a b"), ("a", "long", "lorem " * 50_000)]
    rows += [("a", f"same{k}", "one hot text that is copied many times over and over again by everyone in here without any change at all") for k in range(40)]
    df = spark.createDataFrame(rows, "kind string, key string, text string").withColumn("class", F.lit("clash"))
    members, links = neardup.class_links(df.repartition(5), width, percent, least, block)
    assert {tuple(r) for r in neardup.linked_keys(members, links, block).collect()} == brute(rows, width, percent, least)


def test_members_count_their_links(spark):
    text = "a b c d e f g h i j k l m n o p q r s t"
    df = spark.createDataFrame([("x", "1", text), ("x", "2", text), ("x", "3", text + " u"), ("x", "4", "other words " * 12)], "kind string, key string, text string")
    members, links = neardup.class_links(df, 5, 80)
    got = {r.key: r.links for r in neardup.linked_members(members, links).collect()}
    assert got == {"1": 2, "2": 2, "3": 2, "4": 0}


def test_empty_table(spark):
    df = spark.createDataFrame([], "kind string, key string, text string")
    members, links = neardup.class_links(df)
    assert members.count() == 0 and neardup.linked_keys(members, links).count() == 0


def test_half_of_the_texts_share_their_rarest_shingles(spark):
    # short texts of one boilerplate and a varying end: every prefix holds the same shingles
    rows = [("a", f"k{k:03}", "all of this text is the same in every one of the records but for its " + (f"v{k} w{k}" if k % 3 else "end")) for k in range(90)] + corpus(5, 60)
    df = spark.createDataFrame(rows, "kind string, key string, text string")
    members, links = neardup.class_links(df, 3, 70, 0, block=8)
    assert {tuple(r) for r in neardup.linked_keys(members, links, 8).collect()} == brute(rows, 3, 70, 0)


def test_groups_of_a_hot_shingle_meet_once_and_in_small_cells():
    import numpy as np

    n, block = 1000, 10
    group = np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)
    key, blocks = neardup._meeting_keys(np.full(n, 77, dtype=np.uint64), np.full(n, n), group, block)
    owner = np.repeat(np.arange(n), blocks)
    cells = {}
    for k, o in zip(key.tolist(), owner.tolist(), strict=True):
        cells.setdefault(k, []).append(o)
    assert max(map(len, cells.values())) < 6 * block
    met = np.zeros((n, n), dtype=int)
    for held in cells.values():
        met[np.ix_(held, held)] += 1
    np.fill_diagonal(met, 1)
    # a pair in one block meets in the block's own cell only; pairs of two blocks in theirs
    own = (group >> np.uint64(8)) % np.uint64(n // block)
    apart = own[:, None] != own[None, :]
    assert (met[apart] == 1).all() and (met >= 1).all()
