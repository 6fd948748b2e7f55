"""Splitting: limits, overlaps and an exact round trip."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from repolith.llm import splitting


def pieces(spark, texts, limit=180, overlap=15):
    df = spark.createDataFrame([(str(k), t, "clash") for k, t in enumerate(texts)], "key string, text string, piece string")
    found = {}
    for r in splitting.split(df, ["key"], "text", limit, overlap).orderBy("key", "piece_no").collect():
        found.setdefault(r.key, []).append(r)
    return found


def check(text, own, limit=180, overlap=15):
    assert "".join(r.piece[r.overlap :] for r in own) == text
    for k, r in enumerate(own):
        assert r.piece_no == k + 1 and len(r.piece) <= limit and r.overlap <= overlap
        assert text[r.start_pos - 1 : r.start_pos - 1 + len(r.piece)] == r.piece
        assert len(r.piece) > r.overlap


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab。. \n\r\t😀字“”!", max_size=900), min_size=1, max_size=5))
def test_round_trip(spark, texts):
    found = pieces(spark, texts)
    for k, t in enumerate(texts):
        if t:
            check(t, found[str(k)])
        else:
            assert str(k) not in found


def test_boundaries_and_edges(spark):
    block = "word " * 30 + "\n\n" + "more " * 20
    lines = ("x" * 50 + "\n") * 6
    solid = "y" * 1000
    found = pieces(spark, [block, lines, solid, None, "", "short", "z" * 180, "long text. " * 20_000])
    assert found["0"][0].piece.endswith("\n\n")
    assert all(r.piece.endswith("\n") for r in found["1"])
    assert [len(r.piece) for r in found["2"]][:2] == [165, 180]
    assert "3" not in found and "4" not in found
    assert [r.piece for r in found["5"]] == ["short"] and len(found["6"]) == 1
    check("long text. " * 20_000, found["7"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "key string, text string")
    assert splitting.split(df, ["key"], "text").count() == 0
