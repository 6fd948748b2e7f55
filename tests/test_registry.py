"""Every query has a name, and every SQL counterpart belongs to a query."""

import __spark_entry__


def test_names_match():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "search_topk" in queries and len(queries) > 60
    assert set(sql) <= set(queries)
    assert all(callable(q) for q in queries.values())
