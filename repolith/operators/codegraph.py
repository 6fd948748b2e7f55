"""Definitions, calls, routes, entities and typed edges of code files, from their lines and windows over each file.

A file is a window ordered by line number, so that owners, ends and calls are found without a loop: the owner of a line is the last
statement before it that isn't indented, a definition ends before the next one or the next such statement, and a call belongs to
the last definition before it. Everything stays in the JVM and is shuffled once, by file.

Results: null and empty contents give no rows; a definition below a class is its method, one below a function is left out; repeated rows of a
file must have been removed (sources.tables). Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from repolith.functions import text as T
from repolith.operators import codeindex as C
from repolith.session import cut

#: Called symbols that are kept of each definition, as the caps of the index ask.
MAX_CALLS = 12
MAX_BASES = 8
MAX_RETURNS = 6
MAX_DECORATORS = 8

# First words of an indented line with a parenthesis that aren't methods, and names that aren't calls.
NO_METHODS = ["if", "for", "while", "switch", "catch", "function", "return", "else", "do", "with", "new", "await", "super", "constructor"]
NO_CALLS = ["if", "for", "while", "switch", "catch", "function", "return", "elif", "and", "or", "not", "in", "def", "class", "async", "await", "with", "except", "print", "super", "lambda", "assert", "yield", "else"]
# Verbs that a registration for all of them stands for.
ALL_VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD"]

#: Lines that begin a statement at the left margin.
TOP = r"^[^\s#})\]/*]"
# pattern, group of the name, group of the parameters or bases
_RULES = {
    "py": [
        ("class", r"^class\s+([A-Za-z_]\w*)\s*(?:\(([^)]*)\))?", 1, 2),
        ("function", r"^(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(([^)]*)", 1, 2),
        ("method", r"^\s+(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(([^)]*)", 1, 2),
    ],
    "js": [
        ("class", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([\w.$]+))?", 1, 2),
        ("function", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(([^)]*)", 1, 2),
        ("function", r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(([^()]*)\)\s*=>", 1, 2),
        ("method", r"^\s+(?:(?:static|async|get|set|public|private|protected)\s+)*([A-Za-z_$][\w$]*)\s*\(([^()]*)\)\s*(?::[^{]+)?\{", 1, 2),
    ],
}
CALL = r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\("
PYTHON_ROUTE = r"^\s*@([\w.]+)\.(get|post|put|delete|patch|options|head|route|api_route|websocket)\(\s*(?:path\s*=\s*|rule\s*=\s*)?[\"']([^\"']+)[\"']"
SCRIPT_ROUTE = r"(?i)\b(?:app|router)\.(get|post|put|delete|patch|options|head|all)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,\s*([^\n;]+)"


def _file() -> WindowSpec:
    return Window.partitionBy("repo_id", "path").orderBy("line_number")


def _so_far() -> WindowSpec:
    return _file().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _behind() -> WindowSpec:
    return _file().rowsBetween(1, Window.unboundedFollowing)


def _rule(language: str) -> Column:
    chain: Column = F
    for kind, pattern, name, rest in _RULES[language]:
        found = F.regexp_extract("line", pattern, name)
        real = found != ""
        if kind == "method":
            real = real & ~found.isin(NO_METHODS)
        chain = chain.when(real, F.struct(F.lit(kind).alias("kind"), found.alias("name"), F.regexp_extract("line", pattern, rest).alias("rest"), F.col("line").rlike(r"\basync\b").alias("is_async")))
    return chain


def _language() -> Column:
    ending = F.regexp_extract("path", r"\.(\w+)$", 1)
    return reduce(lambda chain, x: chain.when(ending.isin(C.SUFFIXES[x]), x), C.SUFFIXES, F)


def owned_lines(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Every line of Python and script files (or of all given languages) with its definition, the statement at the margin that it belongs to, and the definition around it."""
    own = C.numbered_lines(files.where(_language().isin(languages or list(_RULES)))).withColumn("language", _language())
    lines = own.withColumn("rule", reduce(lambda chain, x: chain.when(F.col("language") == x, _rule(x)), _RULES, F))
    top = F.col("line").rlike(TOP)
    held = lines.withColumn("top", top).withColumn(
        "owner", F.last(F.when(top, F.struct(F.col("rule.kind").alias("kind"), F.col("rule.name").alias("name"))), ignorenulls=True).over(_so_far())
    )
    method = (F.col("rule.kind") == "method") & (F.col("owner.kind") == "class")
    named = F.when(F.col("rule.kind").isin("class", "function"), F.col("rule.name")).when(method, F.concat_ws(".", "owner.name", "rule.name"))
    return held.withColumn("qualified_name", named).withColumn(
        "inside", F.last(F.when(F.col("top") | named.isNotNull(), F.struct(F.when(F.col("rule.kind") == "class", None).otherwise(named).alias("name"), F.col("line_number").alias("line_start"))), ignorenulls=True).over(_so_far())
    )


def _above(rest: Column) -> Column:
    """The classes that a class is derived from, of what stands behind its name."""
    return F.slice(T.ordered_distinct(F.filter(F.split(_without_types(rest), ","), lambda p: ~p.contains("="))), 1, MAX_BASES)


def _without_types(rest: Column) -> Column:
    # type arguments hold commas of their own
    return F.regexp_replace(F.regexp_replace(rest, r"\[[^\[\]]*\]", ""), r"\[[^\[\]]*\]", "")


def definitions(files: DataFrame) -> DataFrame:
    """(repo_id, path, language, kind, name, owner_class, qualified_name, line_start, line_end, parameters, bases, is_async,
    signature), one row for each class, function and method."""
    lines = owned_lines(files).withColumn("last_line", F.max("line_number").over(Window.partitionBy("repo_id", "path")))
    named = F.col("qualified_name").isNotNull()
    ends = F.first(F.when(F.col("top"), F.col("line_number")), ignorenulls=True).over(_behind())
    following = F.first(F.when(F.col("top") | named, F.col("line_number")), ignorenulls=True).over(_behind())
    until = F.coalesce(F.when(F.col("rule.kind") == "class", ends).otherwise(following) - 1, F.col("last_line"))
    parts = T.ordered_distinct(F.transform(F.split(_without_types(F.col("rule.rest")), ","), lambda p: F.regexp_replace(T.strip(p), r"\s*[:=].*$", "")))
    is_class = F.col("rule.kind") == "class"
    empty = F.array().cast("array<string>")
    return (
        lines.withColumn("line_end", until)
        .where(named)
        .select(
            "repo_id", "path", "language", F.col("rule.kind").alias("kind"), F.col("rule.name").alias("name"), F.when(F.col("rule.kind") == "method", F.col("owner.name")).alias("owner_class"), "qualified_name",
            F.col("line_number").alias("line_start"), "line_end", F.when(is_class, empty).otherwise(parts).alias("parameters"), F.when(is_class, _above(F.col("rule.rest"))).otherwise(empty).alias("bases"), F.col("rule.is_async").alias("is_async"),
            T.strip(F.regexp_replace("line", r"\s*[:{]\s*$", "")).alias("signature"),
        )
    )


def normalized_call(name: Column, language: Column) -> Column:
    """A call's target without the object that stands for the own class or instance: self and cls in Python, this in scripts."""
    return F.when(language == "py", F.regexp_replace(name, r"^(?:self|cls)\.", "")).otherwise(F.regexp_replace(name, r"^this\.", ""))


def calls(files: DataFrame) -> DataFrame:
    """(repo_id, path, qualified_name, line_start, called, call_no, line_number): the first MAX_CALLS different names that each function and method calls, in order."""
    return _ranked_calls(owned_lines(files).where("inside.name is not null and qualified_name is null").withColumn("calls", F.regexp_extract_all("line", F.lit(CALL), F.lit(1))))


def _ranked_calls(inside: DataFrame) -> DataFrame:
    """The same of lines inside of definitions with the names that they call."""
    found = inside.select("repo_id", "path", "language", F.col("inside.name").alias("qualified_name"), F.col("inside.line_start").alias("line_start"), "line_number", F.posexplode("calls").alias("k", "called"))
    bare = found.withColumn("called", normalized_call(F.col("called"), F.col("language"))).where(~F.col("called").isin(NO_CALLS))
    once = bare.groupBy("repo_id", "path", "qualified_name", "line_start", "called").agg(F.min(F.struct("line_number", "k")).alias("at"))
    order = Window.partitionBy("repo_id", "path", "qualified_name", "line_start").orderBy("at", "called")
    return once.withColumn("call_no", F.row_number().over(order)).where(F.col("call_no") <= MAX_CALLS).select("repo_id", "path", "qualified_name", "line_start", "called", "call_no", F.col("at.line_number").alias("line_number"))


def _first_lines(rows: DataFrame, value: str, cap: int, name: str) -> DataFrame:
    """(repo_id, path, qualified_name, line_start, name): the first `cap` different values of each definition in order of line."""
    keys = ["repo_id", "path", "qualified_name", "line_start"]
    once = rows.groupBy(*keys, value).agg(F.min("line_number").alias("at"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("at", value))).where(F.col("n") <= cap)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", value))), lambda x: x[value]).alias(name))


def returns(files: DataFrame) -> DataFrame:
    """(repo_id, path, qualified_name, line_start, return_signals): what the first returns of each function give back."""
    inside = owned_lines(files).where("inside.name is not null")
    found = inside.select("repo_id", "path", F.col("inside.name").alias("qualified_name"), F.col("inside.line_start").alias("line_start"), "line_number", F.regexp_extract("line", r"^\s*return\s+(.*?);?\s*$", 1).alias("value"))
    return _first_lines(found.where("value <> ''"), "value", MAX_RETURNS, "return_signals")


def decorators(files: DataFrame) -> DataFrame:
    """(repo_id, path, qualified_name, line_start, decorators): the decorating lines in front of a definition, without their mark."""
    named = F.when(F.col("qualified_name").isNotNull(), F.struct("qualified_name", F.col("line_number").alias("line_start")))
    found = owned_lines(files).withColumn("of", F.first(named, ignorenulls=True).over(_behind())).withColumn("value", F.regexp_extract("line", r"^\s*@([A-Za-z_].*?)\s*$", 1)).where("value <> '' and of is not null")
    return _first_lines(found.select("repo_id", "path", F.col("of.qualified_name").alias("qualified_name"), F.col("of.line_start").alias("line_start"), "line_number", "value"), "value", MAX_DECORATORS, "decorators")


def _next_handler() -> Column:
    named = F.struct(F.col("rule.name").alias("name"), F.coalesce("qualified_name", "rule.name").alias("qualified"))
    return F.first(F.when(F.col("rule.kind").isin("function", "method"), named), ignorenulls=True).over(_behind())


def _python_routes(lines: DataFrame) -> DataFrame:
    """Routes of decorating lines with the function behind them as handler."""
    verb = F.lower(F.regexp_extract("line", PYTHON_ROUTE, 2))
    listed = T.ordered_distinct(F.transform(F.regexp_extract_all(F.regexp_extract("line", r"methods\s*=\s*[\[(]([^\])]*)", 1), F.lit(r"[\"']([A-Za-z]+)[\"']"), F.lit(1)), F.upper))
    methods = F.when(verb == "websocket", F.array(F.lit("WEBSOCKET"))).when(~verb.isin("route", "api_route"), F.array(F.upper(verb))).when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GET")))
    on_router = F.lower(F.regexp_extract("line", PYTHON_ROUTE, 1)).contains("router")
    framework = F.when(verb.isin("api_route", "websocket") | on_router, "fastapi").when(verb == "route", "flask")
    return (
        lines.where(verb != "")
        .select("repo_id", "path", F.lit("py").alias("language"), F.regexp_extract("line", PYTHON_ROUTE, 3).alias("route_path"), methods.alias("http_methods"), framework.alias("framework"), F.col("handler.name").alias("handler_name"), F.col("handler.qualified").alias("handler_qualified_name"), "line_number")
        .where("handler_name is not null")
    )


def _script_routes(files: DataFrame) -> DataFrame:
    own = C.of_language(files, "js").where("content is not null")
    group = lambda k: F.regexp_extract_all("content", F.lit(SCRIPT_ROUTE), F.lit(k))
    zipped = F.arrays_zip(group(0).alias("whole"), group(1).alias("verb"), group(2).alias("path"), group(3).alias("rest"))
    found = own.select("repo_id", "path", "content", F.explode(zipped).alias("r"))
    before = F.substring("content", F.lit(1), F.instr("content", F.col("r.whole")) - 1)
    number = (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")
    rest = F.regexp_replace(T.strip(F.col("r.rest")), r"[),\s]+$", "")
    last = T.strip(F.element_at(F.split(rest, r",\s*(?![^()\[\]{}]*[)\]}])"), -1))
    inline = last.contains("=>") | last.rlike(r"^(?:function|async)\b") | rest.contains("=>")
    place = F.concat(F.lit("inline_handler@L"), number.cast("string"))
    bare = F.regexp_replace(last, r"^this\.", "")
    verb = F.upper("r.verb")
    return found.select(
        "repo_id", "path", F.lit("js").alias("language"), F.col("r.path").alias("route_path"), F.when(verb == "ALL", F.array(*map(F.lit, ALL_VERBS))).otherwise(F.array(verb)).alias("http_methods"), F.lit("express").alias("framework"),
        F.when(inline, place).otherwise(F.element_at(F.split(bare, r"\."), -1)).alias("handler_name"), F.when(inline, place).otherwise(bare).alias("handler_qualified_name"), number.alias("line_number"),
    )


def routes(files: DataFrame) -> DataFrame:
    """(repo_id, path, language, route_path, http_methods, framework, handler_name, handler_qualified_name, line_number) of decorators in Python and registrations
    on an app or a router in scripts, over several lines too. Equal registrations in a file count at their first place."""
    lines = owned_lines(C.of_language(files, "py")).withColumn("handler", _next_handler())
    return _distinct_routes(_python_routes(lines), _script_routes(files))


def _distinct_routes(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found).dropDuplicates(["repo_id", "path", "route_path", "http_methods", "handler_qualified_name"])


def route_handlers(routes: DataFrame, definitions: DataFrame) -> DataFrame:
    """Routes with the line range of their handler's definition in the same file: by qualified name, else by bare name, the first one; null where there is none."""
    own = definitions.where("kind <> 'class'")
    named = own.groupBy("repo_id", "path", F.col("qualified_name").alias("handler_qualified_name")).agg(F.min(F.struct("line_start", "line_end")).alias("q"))
    bare = own.groupBy("repo_id", "path", F.col("name").alias("handler_name")).agg(F.min(F.struct("line_start", "line_end")).alias("b"))
    joined = routes.join(named, ["repo_id", "path", "handler_qualified_name"], "left").join(bare, ["repo_id", "path", "handler_name"], "left")
    place = F.coalesce("q", "b")
    return joined.select(*routes.columns, place["line_start"].alias("handler_start"), place["line_end"].alias("handler_end"))


def class_methods(definitions: DataFrame) -> DataFrame:
    """(repo_id, path, class_name, line_start, bases, methods, method_refs): every class with its methods in order of line; a method's reference is its qualified name."""
    own = definitions.where("kind = 'class'").select("repo_id", "path", F.col("qualified_name").alias("class_name"), "line_start", "bases")
    methods = definitions.where("kind = 'method'").select("repo_id", "path", F.col("owner_class").alias("class_name"), "name", "qualified_name", F.col("line_start").alias("at"))
    # the rows of one class of one file, whose stored content is bounded
    held = methods.groupBy("repo_id", "path", "class_name").agg(F.array_sort(F.collect_list(F.struct("at", "name", "qualified_name"))).alias("m"))
    joined = own.join(held, ["repo_id", "path", "class_name"], "left")
    names = lambda f: F.coalesce(F.array_distinct(F.transform("m", lambda x: x[f])), F.array().cast("array<string>"))
    return joined.select("repo_id", "path", "class_name", "line_start", "bases", names("name").alias("methods"), names("qualified_name").alias("method_refs"))


def _ruled(rules: dict[str, list[tuple[str, str]]]) -> Column:
    """struct(kind, name) of the first rule of the line's language that fits; null where none does."""
    chain: Column = F
    for language, patterns in rules.items():
        for what, pattern in patterns:
            found = F.regexp_extract("line", pattern, 1)
            chain = chain.when((F.col("language") == language) & (found != ""), F.struct(F.lit(what).alias("kind"), T.strip(found).alias("name")))
    return chain


def _ruled_lines(files: DataFrame, rules: dict[str, list[tuple[str, str]]], kind: str, name: str) -> DataFrame:
    """One pass over the lines of all languages of the rules."""
    lines = C.numbered_lines(files.where(_language().isin(list(rules)))).withColumn("language", _language())
    return lines.withColumn("rule", _ruled(rules)).where("rule is not null").select("repo_id", "path", F.col("rule.kind").alias(kind), F.col("rule.name").alias(name), "line_number")


#: What the languages without definitions and the rules of scripts add.
PLAIN_RULES = {"js": [x for x in C.SYMBOL_RULES["js"] if x[0] == "interface"], "go": C.SYMBOL_RULES["go"], "rs": C.SYMBOL_RULES["rs"]}


def relations(files: DataFrame) -> DataFrame:
    """(repo_id, path, relation_type, target, line_number) of the imports of all indexed languages."""
    return _ruled_lines(files, C.RELATION_RULES, "relation_type", "target")


def plain_symbols(files: DataFrame) -> DataFrame:
    """(repo_id, path, symbol_type, name, line_number) of what the languages without definitions and the script rules add: functions of Go and Rust, interfaces."""
    return _ruled_lines(files, PLAIN_RULES, "symbol_type", "name")


def _route_ref(methods: Column, path: Column, separator: str) -> Column:
    return F.concat(F.array_join(methods, separator), F.lit(" "), path)


def entities(files: DataFrame) -> DataFrame:
    """(repo_id, entity_kind, name, qualified_name, path, location, tags), each (kind, qualified name, path) once, the first line wins."""
    plain = plain_symbols(files).select("repo_id", F.lit("symbol").alias("entity_kind"), "name", F.col("name").alias("qualified_name"), "path", F.col("line_number").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.array("symbol_type").alias("tags"))
    own = definitions(files)
    role = C.symbol_role(F.col("qualified_name"))
    is_class = F.col("kind") == "class"
    tags = F.array_compact(F.array(F.when(is_class, "class").otherwise("function"), F.when(F.col("kind") == "method", "method"), F.when(F.col("is_async") & ~is_class, "async"), role))
    defined = own.select("repo_id", F.when(is_class, "class").otherwise("function").alias("entity_kind"), "name", "qualified_name", "path", "line_start", "line_end", tags.alias("tags"))
    routed = routes(files).select("repo_id", F.lit("api_route").alias("entity_kind"), _route_ref(F.col("http_methods"), F.col("route_path"), ",").alias("name"), F.col("handler_qualified_name").alias("qualified_name"), "path", F.col("line_number").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.array(F.lit("route"), F.coalesce("framework", F.lit("unknown"))).alias("tags"))
    every = plain.unionByName(defined).unionByName(routed)
    first = every.groupBy("repo_id", "entity_kind", "qualified_name", "path").agg(F.min(F.struct("line_start", "name", "line_end", "tags")).alias("e"))
    return first.select("repo_id", "entity_kind", F.col("e.name").alias("name"), "qualified_name", "path", T.location(F.col("path"), F.col("e.line_start"), F.col("e.line_end")).alias("location"), F.array_join("e.tags", ",").alias("tags"))


def edges(files: DataFrame) -> DataFrame:
    """(repo_id, source_ref, target_ref, relation_type, path, line_number), each once: imports, contained symbols, inheritance, methods, calls, and routes with their
    handlers and the calls of these."""
    col, lit = F.col, F.lit
    edge = lambda source, target, kind: F.struct(source.alias("source_ref"), target.alias("target_ref"), kind.alias("relation_type"))
    # one pass over the lines leaves a narrow row of each that says something
    lines = owned_lines(files, list(C.SUFFIXES)).withColumn("handler", _next_handler()).withColumn("relation", _ruled(C.RELATION_RULES)).withColumn("symbol", _ruled(PLAIN_RULES))
    called_here = F.when(col("inside.name").isNotNull() & col("qualified_name").isNull() & col("language").isin(list(_RULES)), F.regexp_extract_all("line", lit(CALL), lit(1)))
    decorates = F.when((col("language") == "py") & col("line").rlike(PYTHON_ROUTE), col("line"))
    told = lines.withColumn("calls", F.coalesce(called_here, F.array().cast("array<string>"))).withColumn("line", decorates)
    held = cut(told.where("qualified_name is not null or relation is not null or symbol is not null or size(calls) > 0 or line is not null").select("repo_id", "path", "language", "line_number", "line", "rule", "owner", "qualified_name", "inside", "handler", "relation", "symbol", "calls"))

    name, defined = col("qualified_name"), col("qualified_name").isNotNull()
    single = [
        F.when(col("relation").isNotNull(), edge(col("path"), col("relation.name"), col("relation.kind"))),
        F.when(col("symbol.kind") != "function", edge(col("path"), col("symbol.name"), lit("contain_symbol"))),
        F.when(defined, edge(col("path"), name, lit("contain_symbol"))),
        F.when(defined & (col("rule.kind") == "method"), edge(col("owner.name"), name, lit("define_method"))),
    ]
    bases = F.when(defined & (col("rule.kind") == "class"), _above(col("rule.rest"))).otherwise(F.array().cast("array<string>"))
    of_lines = F.concat(F.array_compact(F.array(*single)), F.transform(bases, lambda b: edge(name, b, lit("inherit"))))
    called = _ranked_calls(held.where("size(calls) > 0"))
    routed = cut(_distinct_routes(_python_routes(held.where("line is not null")), _script_routes(files)))
    route_ref = _route_ref(col("http_methods"), col("route_path"), ",")
    by_route = routed.join(called.select("repo_id", "path", col("qualified_name").alias("handler_qualified_name"), "called"), ["repo_id", "path", "handler_qualified_name"])
    call = lambda source: edge(source, col("called"), C.call_relation(col("called"))).alias("e")
    branches = [
        held.select("repo_id", "path", "line_number", F.explode(of_lines).alias("e")),
        called.select("repo_id", "path", col("line_start").alias("line_number"), call(name)),
        routed.select("repo_id", "path", "line_number", F.explode(F.array(edge(col("path"), route_ref, lit("contain_route")), edge(route_ref, col("handler_qualified_name"), lit("handle_route")))).alias("e")),
        by_route.select("repo_id", "path", "line_number", call(col("handler_qualified_name"))),
    ]
    return reduce(DataFrame.unionByName, branches).select("repo_id", "e.*", "path", "line_number").distinct()
