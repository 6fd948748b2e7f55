"""Queries over text functions and search, on the knowledge documents and the evaluation's queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolith.functions import text as T
from repolith.operators import search as S
from repolith.sources import tables

#: The query of the flagship search.
ASKED = "services 的入口 main.py 在哪里启动？"


def _tokens(fn, column="content"):
    def run(spark, d):
        return tables.documents(spark, d).select("doc_id", F.explode(fn(F.col(column))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("documents"))

    return run


def _explode(fn, source, key, column):
    def run(spark, d):
        return source(spark, d).select(key, F.explode(fn(F.col(column))).alias("value"))

    return run


def _cases(spark, d):
    return tables.table(spark, d, "eval_cases")


def infer_intent(spark, d):
    return _cases(spark, d).select("case_id", S.infer_intent(F.col("query")).alias("intent"))


def doc_frequency(spark, d):
    return S.document_frequency(tables.documents(spark, d))


def idf(spark, d):
    return S.idf_table(tables.documents(spark, d)).select("token", F.round("idf", 6).alias("idf"))


def token_pool_union(spark, d):
    own = S.fields(tables.documents(spark, d))
    return own.select("doc_id", F.size(F.array_union(F.array_union("title", "content"), "metadata")).cast("bigint").alias("tokens"), F.size(F.array_intersect("title", "content")).cast("bigint").alias("in_both"), F.size(F.array_except("title", "content")).cast("bigint").alias("title_only"))


def postings(spark, d):
    return S.postings(tables.documents(spark, d)).groupBy("field", "token").agg(F.count(F.lit(1)).alias("documents"))


def search_topk(spark, d):
    return S.search(tables.documents(spark, d), ASKED, top_k=10)


def _asked(spark, d):
    return _cases(spark, d).select(F.col("case_id").alias("query_id"), "query", F.col("expected_repo_id").alias("repo_id"))


def batch_search(spark, d):
    return S.best_per_query(S.batch_scores(tables.documents(spark, d), _asked(spark, d)), 5).select("query_id", "rank", "doc_id", "score")


def score_lexical(spark, d):
    return S.batch_scores(tables.documents(spark, d), _asked(spark, d)).select("query_id", "doc_id", "score")


def first_match(spark, d):
    docs = tables.documents(spark, d)
    most = _cases(spark, d).agg(F.max("top_k")).first()[0] or 0  # the deepest list that a case asks for
    hits = S.best_per_query(S.batch_scores(docs, _asked(spark, d)), most).join(docs.select("doc_id", "title", "content", "source_path"), "doc_id")
    cases = _cases(spark, d).select(F.col("case_id").alias("query_id"), "expected_repo_id", "expected_doc_types", "expected_source_paths", "expected_terms_any", "top_k")
    met = S.matches(hits, cases).where("met and rank <= top_k")
    return met.groupBy("query_id").agg(F.min("rank").alias("rank"), F.min_by("doc_id", "rank").alias("doc_id"))


def eval_report(spark, d):
    passed = first_match(spark, d).select(F.col("query_id").alias("case_id"), F.lit(True).alias("passed"))
    return _cases(spark, d).join(passed, "case_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(F.col("passed").isNull()).alias("failed"))


def route_backend(spark, d):
    counts = tables.documents(spark, d).groupBy("repo_id").agg(F.count(F.lit(1)).alias("documents"))
    return counts.select("repo_id", "documents", S.backend_of(F.col("documents"), True).alias("backend"))


def mult_intent(spark, d):
    docs = tables.documents(spark, d).groupBy("doc_type").agg(F.count(F.lit(1)).alias("documents"))
    intents = _cases(spark, d).select(S.infer_intent(F.col("query")).alias("intent")).distinct()
    return docs.crossJoin(F.broadcast(intents)).select("doc_type", "intent", F.round(S.intent_factor(F.col("doc_type"), F.col("intent")) * S.type_factor(F.col("doc_type")), 6).alias("factor"))


def score_path(spark, d):
    tokens = ["services", "main", "route", "src"]
    return tables.documents(spark, d).select("doc_id", S.path_score(F.col("source_path"), tokens).alias("score"))


def score_metadata(spark, d):
    tokens = ["services", "python", "rust", "merge"]
    return tables.documents(spark, d).select("doc_id", F.round(S.metadata_score(F.col("metadata"), tokens, "implementation"), 6).alias("score"))


def score_precise(spark, d):
    terms = ["services/api", "vite.config.js", "refresh_token"]
    return tables.documents(spark, d).select("doc_id", F.round(S.precise_score(F.col("title"), F.col("source_path"), F.col("metadata"), terms), 6).alias("score"))


def flatten_metadata(spark, d):
    values = tables.documents(spark, d).select("doc_id", F.explode(F.flatten(F.map_values("metadata"))).alias("v"))
    return values.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_values"), F.sum(F.length("v")).alias("chars"))


def metadata_values(spark, d):
    return tables.documents(spark, d).select("doc_id", F.explode(T.metadata_values(F.col("metadata"), "called_symbols")).alias("value"))


def snippet_local(spark, d):
    wanted = F.array(*map(F.lit, ["缓存", "token", "route"]))
    return tables.documents(spark, d).select("doc_id", T.snippet(F.col("content"), wanted).alias("snippet"))


def snippet_vector(spark, d):
    return tables.documents(spark, d).select("doc_id", T.snippet(F.col("content"), F.array(F.lit("is the first question")), around=40).alias("snippet"))


def number_lines(spark, d):
    return tables.key_files(spark, d).select("repo_id", "path", T.numbered(F.col("content"), F.lit(3), F.lit(12)).alias("chunk")).where("chunk <> ''")


def prefixed_value(spark, d):
    return tables.documents(spark, d).select("doc_id", T.prefixed_value(F.col("content"), "symbols:").alias("value"))


def contains_word(spark, d):
    return tables.documents(spark, d).where(T.contains_word(F.col("content"), "token")).select("doc_id")


def expand_keys(spark, d):
    symbols = tables.documents(spark, d).select("doc_id", F.explode(T.metadata_values(F.col("metadata"), "called_symbols")).alias("symbol"))
    return symbols.select("doc_id", F.explode(T.expand_keys(F.col("symbol"))).alias("key"))


def source_path_keys(spark, d):
    return tables.documents(spark, d).where("source_path is not null").select("doc_id", F.explode(T.source_path_keys(F.col("source_path"))).alias("key"))


def location_text(spark, d):
    line = F.try_element_at("metadata", F.lit("line_start"))
    number = F.expr("try_cast(try_element_at(metadata, 'line_start')[0] AS INT)")
    return tables.documents(spark, d).where(line.isNotNull()).select("doc_id", T.location(F.col("source_path"), number, number + 3).alias("location"))


def normalize_ref(spark, d):
    return tables.config_summaries(spark, d).select("repo_id", "source_path", F.explode("service_dependencies").alias("dep")).select("repo_id", "source_path", T.normalize_ref(F.col("dep")).alias("ref"))


def fenced_block(spark, d):
    return tables.key_files(spark, d).where("path like '%.md'").select("repo_id", "path", T.fenced_block(F.col("content")).alias("block")).where("block <> ''")


_DOCS = tables.sql_with("documents_once")
_DISTINCT = "list_filter(list_distinct({0}), lambda x: length(x) >= 2)"
_HAN = "flatten(list_transform(regexp_extract_all(lower({0}), '[一-鿿]{{2,}}'), lambda s: list_concat([s], list_transform(range(1, length(s)), lambda i: substr(s, i, 2)))))"
_LATIN = "list_concat(regexp_extract_all(lower({0}), '[a-z0-9_\\-\\.]+'), regexp_extract_all(lower({0}), '/[a-z0-9_\\-/{{}}/:]+'))"


def tok(column: str) -> str:
    column = f"coalesce({column}, '')"
    return _DISTINCT.format(f"list_concat({_LATIN.format(column)}, {_HAN.format(column)})")


def tok_verify(column: str) -> str:
    column = f"coalesce({column}, '')"
    return _DISTINCT.format(f"list_concat(regexp_extract_all(lower({column}), '[a-z0-9_\\-\\./]+'), {_HAN.format(column)})")


_FLAT = "array_to_string(flatten(map_values(metadata)), ' ')"
_FIELDS = f"{_DOCS}, f AS (SELECT doc_id, repo_id, doc_type, {tok('title')} AS title, {tok('content')} AS content, {tok(_FLAT)} AS metadata FROM documents_once)"
_ANY = f"{_FIELDS}, held AS (SELECT doc_id, repo_id, doc_type, unnest(list_distinct(list_concat(title, list_concat(content, metadata)))) AS token FROM f), freq AS (SELECT token, count(*) AS df FROM held GROUP BY token)"
_LOW = "lower(coalesce(query, ''))"


def _any_of(words) -> str:
    return "(" + " OR ".join(f"contains({_LOW}, '{w}')" for w in words) + ")"


INTENT_SQL = (
    "CASE WHEN regexp_matches(" + _LOW + ", '\\b(get|post|put|delete|patch|options|head)\\b\\s+/[a-z0-9_\\-/{}/:]+') THEN 'api' "
    "WHEN regexp_matches(" + _LOW + ", '/[a-z0-9_\\-/{}/:]+') AND " + _any_of(["接口", "路由", "api", "endpoint"]) + " THEN 'api' "
    "WHEN regexp_matches(" + _LOW + ", '[a-z_][a-z0-9_]*\\.[a-z_][a-z0-9_]*') AND " + _any_of(["实现", "logic", "method", "function", "源码", "代码"]) + " THEN 'implementation' "
    + " ".join(f"WHEN {_any_of(words)} THEN '{intent}'" for intent, words in S.INTENT_KEYWORDS.items()) + " ELSE 'generic' END"
)


def _factor_sql(table: str, column: str = "doc_type") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + " ELSE 1.0::DOUBLE END"


FACTOR_SQL = "(CASE intent " + " ".join(f"WHEN '{i}' THEN {_factor_sql(t)}" for i, t in S.INTENT_FACTORS.items()) + f" ELSE 1.0::DOUBLE END) * ({_factor_sql(S.TYPE_FACTORS)})"

_BATCH = f"""{_FIELDS},
held AS (SELECT doc_id, repo_id, doc_type, 'title' AS field, unnest(title) AS token FROM f UNION ALL SELECT doc_id, repo_id, doc_type, 'content', unnest(content) FROM f UNION ALL SELECT doc_id, repo_id, doc_type, 'metadata', unnest(metadata) FROM f),
asked AS (SELECT case_id AS query_id, expected_repo_id AS wanted, {INTENT_SQL} AS intent, len({tok('query')}) AS n_tokens, unnest({tok('query')}) AS token FROM eval_cases),
freq AS (SELECT token, count(DISTINCT doc_id) AS df FROM held GROUP BY token),
total AS (SELECT greatest(count(*), 1) AS total FROM documents_once),
summed AS (SELECT query_id, h.doc_id, repo_id, doc_type, intent, n_tokens, sum(ln((1 + total)::DOUBLE / (1 + df)) + 1 + CASE field WHEN 'title' THEN 3.0::DOUBLE WHEN 'content' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) AS lexical, count(DISTINCT h.token) AS covered
 FROM held h JOIN asked a ON h.token = a.token JOIN freq ON freq.token = h.token CROSS JOIN total WHERE wanted IS NULL OR wanted = repo_id GROUP BY ALL),
scored AS (SELECT query_id, doc_id, repo_id, doc_type, round((lexical + least(covered, 4) * 0.9::DOUBLE + CASE WHEN covered >= least(n_tokens, 2) THEN 1.2::DOUBLE ELSE 0 END) * {FACTOR_SQL}, 4) AS score FROM summed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo_id, doc_id) AS rank FROM scored)"""

_MATCH = _BATCH + """,
met AS (SELECT r.query_id, r.rank, r.doc_id FROM ranked r JOIN documents_once d ON d.doc_id = r.doc_id JOIN eval_cases c ON c.case_id = r.query_id
 WHERE r.rank <= c.top_k AND (expected_repo_id IS NULL OR expected_repo_id = r.repo_id)
 AND (coalesce(len(expected_doc_types), 0) = 0 OR list_contains(expected_doc_types, r.doc_type))
 AND (coalesce(len(expected_source_paths), 0) = 0 OR len(list_filter(expected_source_paths, lambda p: contains(coalesce(d.source_path, ''), p))) > 0)
 AND (coalesce(len(expected_terms_any), 0) = 0 OR len(list_filter(expected_terms_any, lambda t: contains(lower(concat_ws(' ', title, content)), lower(t)))) > 0))"""


def _snippet_sql(words, around: int = 50, size: int = 180) -> str:
    places = "list_filter([" + ", ".join(f"instr(lower(c), '{w}')" for w in words) + "], lambda p: p > 0)"
    return (
        f"SELECT doc_id, CASE WHEN p IS NULL THEN c[1:{size}] || CASE WHEN length(c) > {size} THEN '...' ELSE '' END ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || "
        "regexp_replace(c[s + 1:e], '^\\s+|\\s+$', '', 'g') || CASE WHEN e < length(c) THEN '...' ELSE '' END END AS snippet FROM "
        f"(SELECT *, greatest(0, p - 1 - {around}) AS s, least(length(c), p - 1 + {size - around}) AS e FROM (SELECT doc_id, c, {places}[1] AS p FROM (SELECT doc_id, replace(coalesce(content, ''), chr(10), ' ') AS c FROM documents_once)))"
    )


_META_VALUES = "coalesce(list_filter(list_transform(metadata['{0}'], lambda v: lower(trim(v))), lambda v: length(v) > 0), [])"


def _metadata_sql(tokens, intent) -> str:
    table = S.FIELD_WEIGHTS | S.INTENT_FIELD_WEIGHTS[intent]
    listed = "[" + ", ".join(f"'{t}'" for t in tokens) + "]"
    return " + ".join(f"least(len(list_filter({listed}, lambda t: len(list_filter({_META_VALUES.format(f)}, lambda v: contains(v, t))) > 0)), 3) * {w}::DOUBLE" for f, w in table.items())


def _precise_sql(terms) -> str:
    values = "list_concat(CASE WHEN coalesce(source_path, '') <> '' THEN [lower(source_path)] ELSE [] END, " + "flatten([" + ", ".join(_META_VALUES.format(f) for f in S.PRECISE_FIELDS) + "]))"
    parts = []
    for t in terms:
        parts.append(
            f"CASE WHEN p = '{t}' OR list_contains(v, '{t}') THEN 6.0::DOUBLE ELSE CASE WHEN contains(p, '{t}') THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN contains(h, '{t}') THEN 2.4::DOUBLE ELSE 0 END + "
            f"CASE WHEN len(list_filter(v, lambda x: contains(x, '{t}'))) > 0 THEN 2.8::DOUBLE ELSE 0 END END"
        )
    return f"{_DOCS} SELECT doc_id, round({' + '.join(parts)}, 6) AS score FROM (SELECT doc_id, lower(coalesce(source_path, '')) AS p, lower(coalesce(title, '')) AS h, {values} AS v FROM documents_once)"


_PATH_PARTS = " + ".join(f"CASE WHEN lower(source_path) = '{t}' OR regexp_extract(lower(source_path), '[^/]*$') = '{t}' THEN 4.0::DOUBLE WHEN contains(lower(source_path), '{t}') THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END" for t in ["services", "main", "route", "src"])
_SYMBOLS = f"SELECT doc_id, unnest({_META_VALUES.format('called_symbols')}) AS symbol FROM documents_once"

def _topk_sql() -> str:
    """The whole score of ASKED, which is a startup question that names main.py."""
    asked = f"'{ASKED}'"
    listed = f"(SELECT list_filter(l, lambda x, i: length(x) >= 2 AND list_position(l, x) = i) FROM (SELECT list_concat({_LATIN.format(asked)}, {_HAN.format(asked)}) AS l))"
    table = S.FIELD_WEIGHTS | S.INTENT_FIELD_WEIGHTS["startup"]
    meta = " + ".join(f"least(len(list_filter(toks, lambda t: len(list_filter({_META_VALUES.format(f)}, lambda v: contains(v, t))) > 0)), 3) * {w}::DOUBLE" for f, w in table.items())
    values = "list_concat(CASE WHEN coalesce(source_path, '') <> '' THEN [lower(source_path)] ELSE [] END, " + "flatten([" + ", ".join(_META_VALUES.format(f) for f in S.PRECISE_FIELDS) + "]))"
    rarity = "coalesce((SELECT map_from_entries(list((token, ln((1 + (SELECT greatest(count(*), 1) FROM documents_once))::DOUBLE / (1 + df)) + 1))) FROM freq WHERE list_contains((SELECT toks FROM asked), token)), MAP {})"
    return f"""{_ANY}, asked AS (SELECT {listed} AS toks), w AS (SELECT {rarity} AS idf),
m AS (SELECT d.doc_id, d.repo_id, d.doc_type, d.content, d.metadata, lower(coalesce(d.source_path, '')) AS p, lower(coalesce(d.title, '')) AS h, {values} AS v, toks, idf, f.title AS ft, f.content AS fc, f.fields AS fm
 FROM documents_once d JOIN (SELECT doc_id, title, content, metadata AS fields FROM f) f ON f.doc_id = d.doc_id CROSS JOIN asked CROSS JOIN w),
s AS (SELECT *, list_sum(list_transform(toks, lambda t: CASE WHEN list_contains(ft, t) THEN coalesce(idf[t], 0) + 3 ELSE 0 END + CASE WHEN list_contains(fc, t) THEN coalesce(idf[t], 0) + 1 ELSE 0 END + CASE WHEN list_contains(fm, t) THEN coalesce(idf[t], 0) + 2 ELSE 0 END)) AS lexical,
 {meta} AS meta, list_sum(list_transform(toks, lambda t: CASE WHEN p <> '' AND (p = t OR regexp_extract(p, '[^/]*$') = t) THEN 4.0::DOUBLE WHEN p <> '' AND contains(p, t) THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END)) AS pathed,
 CASE WHEN p = 'main.py' OR list_contains(v, 'main.py') THEN 6.0::DOUBLE ELSE CASE WHEN contains(p, 'main.py') THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN contains(h, 'main.py') THEN 2.4::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(v, lambda x: contains(x, 'main.py'))) > 0 THEN 2.8::DOUBLE ELSE 0 END END AS exact,
 len(list_filter(toks, lambda t: list_contains(ft, t) OR list_contains(fc, t) OR list_contains(fm, t))) AS covered FROM m),
r AS (SELECT doc_id, repo_id, doc_type, content, 'startup' AS intent, lexical + meta + pathed + exact + CASE WHEN covered > 0 THEN least(covered, 4) * 0.9::DOUBLE + CASE WHEN covered >= least(len(toks), 2) THEN 1.2::DOUBLE ELSE 0 END ELSE 0 END AS raw, toks FROM s),
best AS (SELECT doc_id, repo_id, doc_type, round(raw * {FACTOR_SQL}, 4) AS score, replace(coalesce(content, ''), chr(10), ' ') AS c, toks FROM r QUALIFY row_number() OVER (ORDER BY round(raw * {FACTOR_SQL}, 4) DESC, repo_id, doc_id) <= 10)
SELECT doc_id, repo_id, doc_type, score, CASE WHEN q IS NULL THEN c[1:180] || CASE WHEN length(c) > 180 THEN '...' ELSE '' END ELSE CASE WHEN b > 0 THEN '...' ELSE '' END || regexp_replace(c[b + 1:e], '^\\s+|\\s+$', '', 'g') || CASE WHEN e < length(c) THEN '...' ELSE '' END END AS snippet
FROM (SELECT *, greatest(0, q - 51) AS b, least(length(c), q + 129) AS e FROM (SELECT *, list_filter(list_transform(toks, lambda t: instr(lower(c), t)), lambda x: x > 0)[1] AS q FROM best))"""


QUERIES = {
    "tokenize": (_tokens(T.tokenize), f"{_DOCS} SELECT token, count(*) AS documents FROM (SELECT doc_id, unnest({tok('content')}) AS token FROM documents_once) GROUP BY token"),
    "tokenize_verify": (_tokens(T.tokenize_verify), f"{_DOCS} SELECT token, count(*) AS documents FROM (SELECT doc_id, unnest({tok_verify('content')}) AS token FROM documents_once) GROUP BY token"),
    "tokenize_code": (
        _tokens(T.tokenize_code, "title"),
        f"{_DOCS} SELECT token, count(*) AS documents FROM (SELECT doc_id, unnest({_DISTINCT.format('list_concat(regexp_extract_all(t, $$[\\p{L}\\p{N}_\\-./]+$$), list_concat(list_transform(range(1, length(h)), lambda i: substr(h, i, 2)), regexp_extract_all(t, $$/[a-z0-9_\\-/{}/:]+$$)))')}) AS token "
        "FROM (SELECT doc_id, t, array_to_string(regexp_extract_all(t, '[一-鿿]'), '') AS h FROM (SELECT doc_id, lower(coalesce(title, '')) AS t FROM documents_once))) GROUP BY token",
    ),
    "precise_terms": (
        _explode(T.precise_terms, tables.documents, "doc_id", "content"),
        f"{_DOCS} SELECT doc_id, unnest(list_distinct(list_filter(list_transform(list_concat(list_concat(regexp_extract_all(t, '[a-z0-9_./:-]+\\.[a-z0-9_./:-]+'), regexp_extract_all(t, '/[a-z0-9_\\-/{{}}/:]+')), regexp_extract_all(t, '[a-z_][a-z0-9_]{{2,}}')), "
        "lambda x: trim(x, '.:')), lambda x: length(x) >= 3 AND regexp_matches(x, '[/._]')))) AS value FROM (SELECT doc_id, lower(coalesce(content, '')) AS t FROM documents_once)",
    ),
    "infer_intent": (infer_intent, f"SELECT case_id, {INTENT_SQL} AS intent FROM eval_cases"),
    "doc_frequency": (doc_frequency, f"{_ANY} SELECT token, df FROM freq"),
    "idf": (idf, f"{_ANY} SELECT token, round(ln((1 + (SELECT greatest(count(*), 1) FROM documents_once))::DOUBLE / (1 + df)) + 1, 6) AS idf FROM freq"),
    "token_pool_union": (
        token_pool_union,
        f"{_FIELDS} SELECT doc_id, len(list_distinct(list_concat(title, list_concat(content, metadata)))) AS tokens, len(list_intersect(title, content)) AS in_both, len(list_filter(title, lambda x: NOT list_contains(content, x))) AS title_only FROM f",
    ),
    "postings": (postings, f"{_FIELDS} SELECT field, token, count(*) AS documents FROM (SELECT 'title' AS field, unnest(title) AS token FROM f UNION ALL SELECT 'content', unnest(content) FROM f UNION ALL SELECT 'metadata', unnest(metadata) FROM f) GROUP BY 1, 2"),
    "search_topk": (search_topk, _topk_sql()),
    "score_lexical": (score_lexical, _BATCH + " SELECT query_id, doc_id, score FROM scored"),
    "batch_search": (batch_search, _BATCH + " SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 5"),
    "first_match": (first_match, _MATCH + " SELECT query_id, min(rank) AS rank, arg_min(doc_id, rank) AS doc_id FROM met GROUP BY query_id"),
    "eval_report": (eval_report, _MATCH + " SELECT count(*) AS total, count(*) FILTER (case_id IN (SELECT query_id FROM met)) AS passed, count(*) FILTER (case_id NOT IN (SELECT query_id FROM met)) AS failed FROM eval_cases"),
    "route_backend": (route_backend, f"{_DOCS} SELECT repo_id, count(*) AS documents, CASE WHEN count(*) <= {S.LOCAL_REPO_DOCS} THEN 'local' ELSE 'vector' END AS backend FROM documents_once GROUP BY repo_id"),
    "mult_intent": (mult_intent, f"{_DOCS} SELECT doc_type, intent, round({FACTOR_SQL}, 6) AS factor FROM (SELECT DISTINCT doc_type FROM documents_once) CROSS JOIN (SELECT DISTINCT {INTENT_SQL} AS intent FROM eval_cases)"),
    "score_path": (score_path, f"{_DOCS} SELECT doc_id, coalesce({_PATH_PARTS}, 0) AS score FROM documents_once"),
    "score_metadata": (score_metadata, f"{_DOCS} SELECT doc_id, round({_metadata_sql(['services', 'python', 'rust', 'merge'], 'implementation')}, 6) AS score FROM documents_once"),
    "score_precise": (score_precise, _precise_sql(["services/api", "vite.config.js", "refresh_token"])),
    "flatten_metadata": (flatten_metadata, f"{_DOCS} SELECT doc_id, count(*) AS n_values, CAST(sum(length(v)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(flatten(map_values(metadata))) AS v FROM documents_once) GROUP BY doc_id"),
    "metadata_values": (metadata_values, f"{_DOCS} SELECT doc_id, unnest({_META_VALUES.format('called_symbols')}) AS value FROM documents_once"),
    "snippet_local": (snippet_local, f"{_DOCS} {_snippet_sql(['缓存', 'token', 'route'])}"),
    "snippet_vector": (snippet_vector, f"{_DOCS} {_snippet_sql(['is the first question'], 40)}"),
    "number_lines": (
        number_lines,
        f"{tables.sql_with('key_files_once')}, l AS (SELECT repo_id, path, regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS p FROM key_files_once WHERE content <> ''), "
        "n AS (SELECT repo_id, path, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM l), "
        "j AS (SELECT repo_id, path, array_to_string(list_transform(range(3, least(len(p), 12) + 1), lambda k: 'L' || k || ': ' || p[k]), chr(10)) AS c FROM n WHERE len(p) >= 3) "
        "SELECT repo_id, path, CASE WHEN length(c) > 1800 THEN regexp_replace(c[1:1797], '\\s+$', '') || '...' ELSE c END AS chunk FROM j",
    ),
    "prefixed_value": (prefixed_value, f"{_DOCS} SELECT doc_id, trim(regexp_extract(coalesce(content, ''), '(?m)^[ \\t]*symbols:(.*)$', 1)) AS value FROM documents_once"),
    "contains_word": (contains_word, f"{_DOCS} SELECT doc_id FROM documents_once WHERE regexp_matches(lower(content), '(^|[^a-z0-9_])token($|[^a-z0-9_])')"),
    "expand_keys": (
        expand_keys,
        f"{_DOCS} SELECT doc_id, unnest(list_distinct(list_filter(list_transform([s, string_split(s, '.')[-1], string_split(s, ':')[-1], string_split(s, '/')[-1], string_split(s, '->')[-1]], lambda x: trim(x)), lambda x: length(x) > 0))) AS key "
        f"FROM (SELECT doc_id, replace(symbol, '()', '') AS s FROM ({_SYMBOLS}))",
    ),
    "source_path_keys": (
        source_path_keys,
        f"{_DOCS} SELECT doc_id, unnest(list_distinct(list_filter([p, n, regexp_replace(n, '(.)\\.[^.]+$', '\\1'), replace(p, '/', '.'), replace(regexp_replace(p, '\\.[^./]+$', ''), '/', '.')], lambda x: length(x) > 0))) AS key FROM "
        "(SELECT doc_id, p, regexp_extract(p, '[^/]*$') AS n FROM (SELECT doc_id, trim(lower(source_path)) AS p FROM documents_once WHERE source_path IS NOT NULL))",
    ),
    "location_text": (
        location_text,
        f"{_DOCS} SELECT doc_id, coalesce(source_path, '') || CASE WHEN n IS NULL THEN '' ELSE ':L' || n || '-L' || (n + 3) END AS location FROM (SELECT doc_id, source_path, try_cast(metadata['line_start'][1] AS INT) AS n FROM documents_once WHERE metadata['line_start'] IS NOT NULL)",
    ),
    "normalize_ref": (
        normalize_ref,
        f"{tables.sql_with('configs_once')} SELECT repo_id, source_path, trim(regexp_replace(trim(lower(coalesce(dep, ''))), '(?s)[\\[<>=~! ].*$', '')) AS ref FROM (SELECT repo_id, source_path, unnest(service_dependencies) AS dep FROM configs_once)",
    ),
    "fenced_block": (
        fenced_block,
        f"{tables.sql_with('key_files_once')} SELECT repo_id, path, b AS block FROM (SELECT repo_id, path, regexp_extract(coalesce(content, ''), '(?s)(?:^|\\n)```[^\\n]*\\n(.*?)\\n?```', 1) AS b FROM key_files_once WHERE path LIKE '%.md') WHERE b <> ''",
    ),
}
