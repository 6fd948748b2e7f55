"""Text functions against small independent versions and hand-made cases."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repolith.functions import text as T


def plain_tokens(text):
    low = text.lower()
    found = re.findall(r"[a-z0-9_\-\.]+", low) + re.findall(r"/[a-z0-9_\-/{}/:]+", low)
    for run in re.findall("[一-鿿]{2,}", low):
        found += [run, *(run[k : k + 2] for k in range(len(run) - 1))]
    return list(dict.fromkeys(t for t in found if len(t) >= 2))


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()
    return row.x


def test_tokens_of_a_mixed_question(spark):
    assert one(spark, T.tokenize(F.col("t")), t="POST /login 是怎么实现的") == ["post", "login", "/login", "是怎么实现的", "是怎", "怎么", "么实", "实现", "现的"]
    assert one(spark, T.tokenize(F.col("t")), t=None) == []
    assert one(spark, T.tokenize(F.col("t")), t="") == []


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB9_-./{}: \n中文字é", max_size=30), min_size=1, max_size=8))
def test_tokens_match_a_plain_version(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.tokenize(F.col("t")).alias("x")).collect()
    assert {r.k: r.x for r in rows} == {k: plain_tokens(t) for k, t in enumerate(texts)}


def test_precise_terms(spark):
    assert one(spark, T.precise_terms(F.col("t")), t="Where is app.main: and /v1/users or load_all?") == ["app.main", "/v1/users", "load_all"]


def test_snippets(spark):
    tokens = F.array(F.lit("needle"))
    assert one(spark, T.snippet(F.col("t"), tokens), t="x" * 300) == "x" * 180 + "..."
    hit = one(spark, T.snippet(F.col("t"), tokens), t="a" * 100 + "needle" + "b" * 200)
    assert hit == "..." + "a" * 50 + "needle" + "b" * 124 + "..."
    assert one(spark, T.snippet(F.col("t"), tokens), t=None) == ""


def test_numbered_lines(spark):
    text = "one\ntwo\r\nthree\n"
    assert one(spark, T.numbered(F.col("t"), F.lit(2), F.lit(9)), t=text) == "L2: two\nL3: three"
    assert one(spark, T.numbered(F.col("t"), F.lit(7), F.lit(9)), t=text) == ""
    assert one(spark, T.numbered(F.col("t"), F.lit(1), F.lit(1), 24, 20), t="y" * 50).endswith("...")


def test_keys_and_locations(spark):
    assert one(spark, T.expand_keys(F.col("t")), t="Pkg.Service->Load()") == ["pkg.service->load", "service->load", "load"]
    assert one(spark, T.source_path_keys(F.col("t")), t="src/app/main.py") == ["src/app/main.py", "main.py", "main", "src.app.main.py", "src.app.main"]
    assert one(spark, T.location(F.col("t"), F.lit(3), F.lit(5)), t="a.py") == "a.py:L3-L5"
    assert one(spark, T.normalize_ref(F.col("t")), t=" FastAPI[all]>=0.1 ") == "fastapi"


def test_words_and_blocks(spark):
    assert one(spark, T.contains_word(F.col("t"), "react"), t="class ReactAgent") is False
    assert one(spark, T.contains_word(F.col("t"), "react"), t="uses React.") is True
    assert one(spark, T.fenced_block(F.col("t")), t="a\n```py\nx = 1\n```\nb") == "x = 1"
    assert one(spark, T.prefixed_value(F.col("t"), "at:"), t="x\n  at: here \n") == "here"
