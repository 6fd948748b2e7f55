"""Queries over definitions, calls, routes, entities and edges of code files. The SQL states its rules itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolith.operators import codegraph as G
from repolith.sources import tables

with_ = tables.sql_with


def _files(spark, d):
    return tables.key_files(spark, d)


def code_definitions(spark, d):
    own = G.definitions(_files(spark, d))
    return own.select("repo_id", "path", "kind", "name", "owner_class", "qualified_name", "line_start", "line_end", F.array_join("parameters", ",").alias("parameters"), F.array_join("bases", ",").alias("bases"))


def code_calls(spark, d):
    return G.calls(_files(spark, d)).select("repo_id", "path", "qualified_name", "called", "call_no", "line_number")


def join_class_methods(spark, d):
    own = G.class_methods(G.definitions(_files(spark, d)))
    return own.select("repo_id", "path", "class_name", "line_start", F.array_join("methods", ",").alias("methods"), F.array_join("method_refs", ",").alias("method_refs"))


def code_routes(spark, d):
    own = G.routes(_files(spark, d))
    return own.select("repo_id", "path", "language", "route_path", F.array_join("http_methods", ",").alias("http_methods"), "framework", "handler_name", "handler_qualified_name", "line_number")


def js_routes_regex(spark, d):
    return code_routes(spark, d).where("language = 'js'")


def py_routes(spark, d):
    return code_routes(spark, d).where("language = 'py'")


def join_route_handler(spark, d):
    files = _files(spark, d)
    own = G.route_handlers(G.routes(files), G.definitions(files))
    return own.select("repo_id", "path", "route_path", "handler_qualified_name", "handler_start", "handler_end")


def build_entities(spark, d):
    return G.entities(_files(spark, d))


def build_edges(spark, d):
    return G.edges(_files(spark, d))


def edge_counts(spark, d):
    """Edges of each relation type."""
    return build_edges(spark, d).groupBy("relation_type").agg(F.count(F.lit(1)).alias("edges"))


#: Lines of the indexed languages with the definition that each holds, the margin's statement above it and the definition around it.
LINES = f"""{with_('key_files_once')},
raw AS (SELECT repo_id, path, CASE WHEN regexp_matches(path, '\\.py$') THEN 'py' WHEN regexp_matches(path, '\\.(js|jsx|ts|tsx|mjs)$') THEN 'js' WHEN regexp_matches(path, '\\.go$') THEN 'go' WHEN regexp_matches(path, '\\.rs$') THEN 'rs' END AS language,
  regexp_split_to_array(content, '\\r\\n|[\\n\\r]') AS p FROM key_files_once WHERE content <> ''),
al AS (SELECT repo_id, path, language, CAST(unnest(range(1, len(p) + 1)) AS INT) AS line_number, unnest(p) AS line FROM raw WHERE language IS NOT NULL),
ru AS (SELECT *, CASE
  WHEN language = 'py' AND regexp_matches(line, '^class\\s+[A-Za-z_]\\w*') THEN 'class'
  WHEN language = 'py' AND regexp_matches(line, '^(?:async\\s+)?def\\s+[A-Za-z_]\\w*\\s*\\(') THEN 'function'
  WHEN language = 'py' AND regexp_matches(line, '^\\s+(?:async\\s+)?def\\s+[A-Za-z_]\\w*\\s*\\(') AND NOT regexp_extract(line, 'def\\s+(\\w+)', 1) IN ('if','for','while','switch','catch','function','return','else','do','with','new','await','super','constructor') THEN 'method'
  WHEN language = 'js' AND regexp_matches(line, '^(?:export\\s+)?(?:default\\s+)?(?:abstract\\s+)?class\\s+[A-Za-z_$]') THEN 'class'
  WHEN language = 'js' AND regexp_matches(line, '^(?:export\\s+)?(?:default\\s+)?(?:async\\s+)?function\\s*\\*?\\s*[A-Za-z_$][\\w$]*\\s*\\(') THEN 'function'
  WHEN language = 'js' AND regexp_matches(line, '^(?:export\\s+)?(?:const|let|var)\\s+[A-Za-z_$][\\w$]*\\s*=\\s*(?:async\\s*)?\\([^()]*\\)\\s*=>') THEN 'arrow'
  WHEN language = 'js' AND regexp_matches(line, '^\\s+(?:(?:static|async|get|set|public|private|protected)\\s+)*[A-Za-z_$][\\w$]*\\s*\\([^()]*\\)\\s*(?::[^{{]+)?\\{{')
    AND NOT regexp_extract(line, '^\\s+(?:(?:static|async|get|set|public|private|protected)\\s+)*([A-Za-z_$][\\w$]*)\\s*\\([^()]*\\)\\s*(?::[^{{]+)?\\{{', 1) IN ('if','for','while','switch','catch','function','return','else','do','with','new','await','super','constructor') THEN 'script method' END AS rule FROM al),
nm AS (SELECT repo_id, path, language, line_number, line, regexp_matches(line, '^[^\\s#}})\\]/*]') AS top, CASE rule WHEN 'arrow' THEN 'function' WHEN 'script method' THEN 'method' ELSE rule END AS kind,
  CASE WHEN rule = 'class' THEN regexp_extract(line, 'class\\s+([A-Za-z_$][\\w$]*)', 1) WHEN language = 'py' AND rule IS NOT NULL THEN regexp_extract(line, 'def\\s+([A-Za-z_]\\w*)', 1)
    WHEN rule = 'function' THEN regexp_extract(line, 'function\\s*\\*?\\s*([A-Za-z_$][\\w$]*)', 1) WHEN rule = 'arrow' THEN regexp_extract(line, '(?:const|let|var)\\s+([A-Za-z_$][\\w$]*)', 1)
    WHEN rule = 'script method' THEN regexp_extract(line, '([A-Za-z_$][\\w$]*)\\s*\\(', 1) END AS name,
  CASE WHEN rule = 'class' AND language = 'py' THEN regexp_extract(line, '^class\\s+\\w+\\s*\\(([^)]*)\\)', 1) WHEN rule = 'class' THEN regexp_extract(line, '\\sextends\\s+([\\w.$]+)', 1) WHEN rule IS NOT NULL THEN regexp_extract(line, '\\(([^)]*)', 1) END AS rest FROM ru),
ow AS (SELECT *, last_value(CASE WHEN top THEN {{'kind': coalesce(kind, ''), 'name': coalesce(name, '')}} END IGNORE NULLS) OVER (PARTITION BY repo_id, path ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS owner FROM nm),
qu AS (SELECT *, CASE WHEN kind IN ('class', 'function') THEN name WHEN kind = 'method' AND owner.kind = 'class' THEN owner.name || '.' || name END AS qualified_name FROM ow WHERE language IN ('py', 'js')),
li AS (SELECT *, last_value(CASE WHEN top OR qualified_name IS NOT NULL THEN {{'name': CASE WHEN kind = 'class' THEN NULL ELSE qualified_name END, 'ln': line_number}} END IGNORE NULLS) OVER (PARTITION BY repo_id, path ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS inside FROM qu),
df AS (SELECT *, CASE WHEN kind = 'class' THEN next_top ELSE next_any END AS stop FROM (SELECT *, min(CASE WHEN top THEN line_number END) OVER w AS next_top, min(CASE WHEN top OR qualified_name IS NOT NULL THEN line_number END) OVER w AS next_any, max(line_number) OVER (PARTITION BY repo_id, path) AS last_line
  FROM li WINDOW w AS (PARTITION BY repo_id, path ORDER BY line_number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) WHERE qualified_name IS NOT NULL),
parts AS (SELECT repo_id, path, line_number, k, CASE WHEN kind = 'class' AND contains(e, '=') THEN '' ELSE trim(regexp_replace(trim(e), '\\s*[:=].*$', '')) END AS part FROM (SELECT repo_id, path, line_number, kind, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS e FROM (SELECT repo_id, path, line_number, kind, string_split(regexp_replace(regexp_replace(rest, '\\[[^\\[\\]]*\\]', '', 'g'), '\\[[^\\[\\]]*\\]', '', 'g'), ',') AS l FROM df))),
pone AS (SELECT repo_id, path, line_number, part, min(k) AS k FROM parts WHERE part <> '' GROUP BY ALL),
pj AS (SELECT repo_id, path, line_number, string_agg(part, ',' ORDER BY k) AS parts FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, line_number ORDER BY k) AS n FROM pone) GROUP BY ALL),
defs AS (SELECT df.repo_id, df.path, df.kind, df.name, CASE WHEN df.kind = 'method' THEN owner.name END AS owner_class, df.qualified_name, df.line_number AS line_start, CAST(coalesce(stop - 1, last_line) AS INT) AS line_end, CASE WHEN df.kind = 'class' THEN '' ELSE coalesce(pj.parts, '') END AS parameters, CASE WHEN df.kind = 'class' THEN coalesce(pj.parts, '') ELSE '' END AS bases
  FROM df LEFT JOIN pj USING (repo_id, path, line_number)),
co AS (SELECT repo_id, path, inside.name AS qualified_name, inside.ln AS line_start, line_number, unnest(range(1, len(c) + 1)) AS k, CASE WHEN language = 'py' THEN regexp_replace(unnest(c), '^(?:self|cls)\\.', '') ELSE regexp_replace(unnest(c), '^this\\.', '') END AS called
  FROM (SELECT *, regexp_extract_all(line, '([A-Za-z_$][\\w$]*(?:\\.[A-Za-z_$][\\w$]*)*)\\s*\\(', 1) AS c FROM li WHERE inside.name IS NOT NULL AND qualified_name IS NULL)),
c1 AS (SELECT repo_id, path, qualified_name, line_start, called, min((line_number, k)) AS place FROM co WHERE called NOT IN ('if','for','while','switch','catch','function','return','elif','and','or','not','in','def','class','async','await','with','except','print','super','lambda','assert','yield','else') GROUP BY ALL),
cl AS (SELECT repo_id, path, qualified_name, line_start, called, CAST(row_number() OVER (PARTITION BY repo_id, path, qualified_name, line_start ORDER BY place, called) AS INT) AS call_no, place[1] AS line_number FROM c1 QUALIFY call_no <= 12)"""
_ROUTES = """,
pyr AS (SELECT repo_id, path, 'py' AS language, regexp_extract(line, '\\(\\s*(?:path\\s*=\\s*|rule\\s*=\\s*)?["'']([^"'']+)', 1) AS route_path, lower(regexp_extract(line, '^\\s*@[\\w.]+\\.(\\w+)\\(', 1)) AS verb, lower(regexp_extract(line, '^\\s*@([\\w.]+)\\.', 1)) AS router, line, line_number,
  (SELECT n.name FROM qu n WHERE n.repo_id = q.repo_id AND n.path = q.path AND n.kind IN ('function', 'method') AND n.line_number > q.line_number ORDER BY n.line_number LIMIT 1) AS handler_name
  FROM qu q WHERE language = 'py' AND regexp_matches(line, '^\\s*@[\\w.]+\\.(?:get|post|put|delete|patch|options|head|route|api_route|websocket)\\(\\s*(?:path\\s*=\\s*|rule\\s*=\\s*)?["''][^"'']+["'']')),
jsr AS (SELECT repo_id, path, unnest(regexp_extract_all(content, '(?i)\\b(?:app|router)\\.(?:get|post|put|delete|patch|options|head|all)\\s*\\(\\s*["''`]([^"''`]+)["''`]\\s*,\\s*[^\\n;]+', 1)) AS route_path FROM key_files_once WHERE regexp_matches(path, '\\.(js|jsx|ts|tsx|mjs)$'))"""
_RELATIONS = """,
rl AS (SELECT repo_id, path, 'import' AS relation_type, trim(regexp_extract(line, '^\\s*(?:import\\s+([\\w.]+))', 1)) AS target, line_number FROM al WHERE language = 'py' AND regexp_matches(line, '^\\s*import\\s+[\\w.]+')
 UNION ALL SELECT repo_id, path, 'import', regexp_extract(line, '^\\s*from\\s+([\\w.]+)\\s+import\\b', 1), line_number FROM al WHERE language = 'py' AND regexp_matches(line, '^\\s*from\\s+[\\w.]+\\s+import\\b')
 UNION ALL SELECT repo_id, path, CASE WHEN m <> '' THEN 'import' ELSE 'require' END, CASE WHEN m <> '' THEN m ELSE r END, line_number FROM (SELECT *, trim(regexp_extract(line, '^\\s*import\\s+(?:[^''"]*?\\s+from\\s+)?[''"]([^''"]+)[''"]', 1)) AS m, trim(regexp_extract(line, '\\brequire\\(\\s*[''"]([^''"]+)[''"]\\s*\\)', 1)) AS r FROM al WHERE language = 'js') WHERE m <> '' OR r <> ''
 UNION ALL SELECT repo_id, path, 'import', trim(regexp_extract(line, '^\\s*(?:import\\s+)?(?:[A-Za-z_.]\\w*\\s+)?"([^"]+)"$', 1)), line_number FROM al WHERE language = 'go' AND regexp_matches(line, '^\\s*(?:import\\s+)?(?:[A-Za-z_.]\\w*\\s+)?"[^"]+"$')
 UNION ALL SELECT repo_id, path, 'use', trim(regexp_extract(line, '^\\s*(?:pub\\s+)?use\\s+([^;{]+?)(?:::)?\\s*[;{]', 1)), line_number FROM al WHERE language = 'rs' AND regexp_matches(line, '^\\s*(?:pub\\s+)?use\\s+[^;{]+?(?:::)?\\s*[;{]')),
ps AS (SELECT repo_id, path, 'interface' AS symbol_type, regexp_extract(line, '^\\s*(?:export\\s+)?interface\\s+([A-Za-z_$][\\w$]*)', 1) AS name, line_number FROM al WHERE language = 'js' AND regexp_matches(line, '^\\s*(?:export\\s+)?interface\\s+[A-Za-z_$]')
 UNION ALL SELECT repo_id, path, 'function', regexp_extract(line, '^func\\s+(?:\\([^)]*\\)\\s*)?([A-Za-z_]\\w*)', 1), line_number FROM al WHERE language = 'go' AND regexp_matches(line, '^func\\s+(?:\\([^)]*\\)\\s*)?[A-Za-z_]')
 UNION ALL SELECT repo_id, path, 'function', regexp_extract(line, '^\\s*(?:pub(?:\\([^)]*\\))?\\s+)?(?:async\\s+)?fn\\s+([A-Za-z_]\\w*)', 1), line_number FROM al WHERE language = 'rs' AND regexp_matches(line, '^\\s*(?:pub(?:\\([^)]*\\))?\\s+)?(?:async\\s+)?fn\\s+[A-Za-z_]'))"""
_ROLE = lambda c: f"CASE WHEN regexp_matches(lower({c}), 'repository|repo|dao') THEN 'repository' WHEN regexp_matches(lower({c}), 'service|svc') THEN 'service' WHEN regexp_matches(lower({c}), 'handler|controller|view|endpoint') THEN 'handler' END"
_CALLED = "CASE WHEN regexp_matches(lower(called), 'repository|repo|dao') THEN 'delegate_repository' WHEN regexp_matches(lower(called), 'service|svc') THEN 'delegate_service' ELSE 'call' END"
_METHODS = "CASE WHEN verb = 'websocket' THEN 'WEBSOCKET' WHEN verb NOT IN ('route', 'api_route') THEN upper(verb) WHEN len(regexp_extract_all(line, '[\"'']([A-Za-z]+)[\"'']', 1)) > 1 AND contains(line, 'methods') THEN upper(array_to_string(regexp_extract_all(regexp_extract(line, 'methods\\s*=\\s*[\\[(]([^\\])]*)', 1), '[\"'']([A-Za-z]+)[\"'']', 1), ',')) ELSE 'GET' END"
_EDGES = f"""{LINES}{_RELATIONS},
e AS (SELECT repo_id, path AS source_ref, target AS target_ref, relation_type, path, line_number FROM rl
 UNION SELECT repo_id, path, name, 'contain_symbol', path, line_number FROM ps WHERE symbol_type <> 'function'
 UNION SELECT repo_id, path, qualified_name, 'contain_symbol', path, line_start FROM defs
 UNION SELECT repo_id, qualified_name, unnest(string_split(bases, ',')), 'inherit', path, line_start FROM defs WHERE kind = 'class' AND bases <> ''
 UNION SELECT repo_id, owner_class, qualified_name, 'define_method', path, line_start FROM defs WHERE kind = 'method'
 UNION SELECT repo_id, qualified_name, called, {_CALLED}, path, line_start FROM cl)"""

QUERIES = {
    "code_definitions": (code_definitions, f"{LINES} SELECT repo_id, path, kind, name, owner_class, qualified_name, line_start, line_end, parameters, bases FROM defs"),
    "code_calls": (code_calls, f"{LINES} SELECT repo_id, path, qualified_name, called, call_no, line_number FROM cl"),
    "join_class_methods": (
        join_class_methods,
        f"{LINES}, m AS (SELECT repo_id, path, owner_class AS class_name, name, qualified_name, min(line_start) AS place FROM defs WHERE kind = 'method' GROUP BY ALL), j AS (SELECT repo_id, path, class_name, string_agg(name, ',' ORDER BY place, name) AS methods, string_agg(qualified_name, ',' ORDER BY place, name) AS method_refs FROM m GROUP BY ALL) "
        "SELECT d.repo_id, d.path, d.qualified_name AS class_name, d.line_start, coalesce(j.methods, '') AS methods, coalesce(j.method_refs, '') AS method_refs FROM defs d LEFT JOIN j ON j.repo_id = d.repo_id AND j.path = d.path AND j.class_name = d.qualified_name WHERE d.kind = 'class'",
    ),
    "build_entities": (
        build_entities,
        f"{LINES}{_RELATIONS}, a AS (SELECT repo_id, 'symbol' AS entity_kind, name, name AS qualified_name, path, line_number AS line_start, NULL AS line_end, symbol_type AS tags FROM ps UNION ALL SELECT repo_id, CASE WHEN kind = 'class' THEN 'class' ELSE 'function' END, name, qualified_name, path, line_start, line_end, "
        f"concat_ws(',', CASE WHEN kind = 'class' THEN 'class' ELSE 'function' END, CASE WHEN kind = 'method' THEN 'method' END, CASE WHEN kind <> 'class' AND is_async THEN 'async' END, {_ROLE('qualified_name')}) FROM (SELECT defs.*, regexp_matches(line, '\\basync\\b') AS is_async FROM defs JOIN al ON al.repo_id = defs.repo_id AND al.path = defs.path AND al.line_number = defs.line_start)) "
        "SELECT repo_id, entity_kind, name, qualified_name, path, path || ':L' || line_start || CASE WHEN line_end IS NULL OR line_end = line_start THEN '' ELSE '-L' || line_end END AS location, tags FROM a QUALIFY row_number() OVER (PARTITION BY repo_id, entity_kind, qualified_name, path ORDER BY line_start, name) = 1",
    ),
    "build_edges": (build_edges, f"{_EDGES} SELECT * FROM e"),
    "edge_counts": (edge_counts, f"{_EDGES} SELECT relation_type, count(*) AS edges FROM e GROUP BY 1"),
    "py_routes": (py_routes, f"{LINES}{_ROUTES} SELECT repo_id, path, language, route_path, {_METHODS} AS http_methods, CASE WHEN verb IN ('api_route', 'websocket') OR contains(router, 'router') THEN 'fastapi' WHEN verb = 'route' THEN 'flask' END AS framework, handler_name, handler_name AS handler_qualified_name, line_number FROM pyr WHERE handler_name IS NOT NULL"),
    "js_routes_regex": (js_routes_regex, None),
    "join_route_handler": (join_route_handler, None),
}
