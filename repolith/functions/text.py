"""Text functions as Spark columns: tokens, precise terms, snippets, numbered lines, keys of symbols and paths.

All of them are null-safe: a null text gives an empty array or an empty string, as each says. They stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the search tokens are made of.
LATIN = r"[a-z0-9_\-\.]+"
ROUTE = r"/[a-z0-9_\-/{}/:]+"
HAN = r"[一-鿿]{2,}"
LATIN_WITH_PATHS = r"[a-z0-9_\-\./]+"
ALNUM_RUN = r"[\p{L}\p{N}_\-./]+"
MIN_TOKEN_LENGTH = 2

STRIP = r"(?U)^\s+|\s+$"


def text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def strip(column: Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(column, STRIP, "")


def found_all(column: Column, pattern: str) -> Column:
    """All whole matches of a pattern, an array that may be empty."""
    return F.coalesce(F.regexp_extract_all(text(column), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def bigrams(run: Column) -> Column:
    """All pairs of neighbouring characters of a string of at least two characters."""
    return F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda k: F.substring(run, k, F.lit(2)))


def long_enough(tokens: Column) -> Column:
    return F.filter(F.array_distinct(tokens), lambda t: F.length(t) >= MIN_TOKEN_LENGTH)


def tokenize(column: Column) -> Column:
    """Distinct search tokens in order: latin runs, routes, then runs of Han characters each followed by its bigrams."""
    low = F.lower(text(column))
    han = F.flatten(F.transform(found_all(low, HAN), lambda run: F.concat(F.array(run), bigrams(run))))
    return long_enough(F.concat(found_all(low, LATIN), found_all(low, ROUTE), han))


def tokenize_verify(column: Column) -> Column:
    """Distinct tokens for comparing claims with evidence: latin runs that may hold slashes, then Han runs with bigrams."""
    low = F.lower(text(column))
    han = F.flatten(F.transform(found_all(low, HAN), lambda run: F.concat(F.array(run), bigrams(run))))
    return long_enough(F.concat(found_all(low, LATIN_WITH_PATHS), han))


def tokenize_code(column: Column) -> Column:
    """Distinct tokens for symbols: runs of letters, digits and _ - . /, bigrams of Han characters over gaps, routes."""
    low = F.lower(text(column))
    han = F.array_join(found_all(low, "[一-鿿]"), "")
    pairs = F.when(F.length(han) >= 2, bigrams(han)).otherwise(F.array().cast("array<string>"))
    return long_enough(F.concat(found_all(low, ALNUM_RUN), pairs, found_all(low, ROUTE)))


def precise_terms(column: Column) -> Column:
    """Dotted names, routes and identifiers that can name one place, in order, without repeats."""
    low = F.lower(text(column))
    terms = F.concat(found_all(low, r"[a-z0-9_./:-]+\.[a-z0-9_./:-]+"), found_all(low, ROUTE), found_all(low, r"[a-z_][a-z0-9_]{2,}"))
    bare = F.transform(terms, lambda t: F.regexp_replace(t, r"^[.:]+|[.:]+$", ""))
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 3) & t.rlike(r"[/._]")))


def flatten_metadata(metadata: Column) -> Column:
    """All values of all fields, joined by spaces; '' for null."""
    return text(F.array_join(F.flatten(F.map_values(metadata)), " "))


def cleaned(values: Column) -> Column:
    """Stripped non-empty values, lower-cased; an empty array for null."""
    return F.coalesce(F.filter(F.transform(values, lambda v: F.lower(strip(v))), lambda v: F.length(v) > 0), F.array().cast("array<string>"))


def metadata_values(metadata: Column, field: str) -> Column:
    """Stripped non-empty values of a field, lower-cased; an empty array where there is none."""
    return cleaned(F.try_element_at(metadata, F.lit(field)))


def ordered_distinct(values: Column) -> Column:
    """Stripped values without empty ones and repeats, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(values, strip), lambda v: F.length(v) > 0))


def snippet(content: Column, tokens: Column, around: int = 50, size: int = 180) -> Column:
    """The content around the first token, in token order, that occurs in it; else its beginning. Line ends become spaces."""
    flat = F.replace(text(content), F.lit("\n"), F.lit(" "))
    low = F.lower(flat)
    places = F.filter(F.transform(tokens, lambda t: F.instr(low, t)), lambda p: p > 0)
    at = F.try_element_at(places, F.lit(1)) - 1
    start = F.greatest(F.lit(0), at - around)
    end = F.least(F.length(flat), at + size - around)
    body = strip(F.substring(flat, start + 1, end - start))
    hit = F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(flat), "...").otherwise(""))
    head = F.concat(F.substring(flat, 1, size), F.when(F.length(flat) > size, "...").otherwise(""))
    return F.when(at.isNull(), head).otherwise(hit)


def lines(content: Column) -> Column:
    """Lines as Python's splitlines gives them, without a last empty one."""
    parts = F.split(text(content), r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def numbered(content: Column, first: Column, last: Column, max_lines: int = 24, max_chars: int = 1800) -> Column:
    """'L<n>: line' for the lines from first to last, at most max_lines of them, cut to max_chars with '...' at the end."""
    window = F.slice(lines(content), F.greatest(first, F.lit(1)), F.greatest(F.least(last - F.greatest(first, F.lit(1)) + 1, F.lit(max_lines)), F.lit(0)))
    begin = F.greatest(first, F.lit(1))
    joined = F.array_join(F.transform(window, lambda line, k: F.concat(F.lit("L"), (begin + k).cast("string"), F.lit(": "), line)), "\n")
    cut = F.concat(F.regexp_replace(F.substring(joined, 1, max_chars - 3), r"(?U)\s+$", ""), F.lit("..."))
    return F.when(F.length(joined) > max_chars, cut).otherwise(joined)


def prefixed_value(content: Column, prefix: str) -> Column:
    """What follows the prefix on the first line that starts with it, stripped; '' if none does."""
    import re

    return strip(F.regexp_extract(text(content), rf"(?md)^[ \t]*{re.escape(prefix)}(.*)$", 1))


def fenced_block(content: Column) -> Column:
    """The inside of the first fenced block, '' if there is none."""
    return F.regexp_extract(text(content), r"(?sd)(?:^|\n)```[^\n]*\n(.*?)\n?```", 1)


def split_arguments(arguments: Column) -> Column:
    """The parts between the commas that no bracket or quote encloses, stripped, without empty ones. A fold over the characters keeps the open brackets, the open quote
    and the part so far; a backslash protects the next character of a literal."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit("").alias("part"), F.array().cast("array<string>").alias("done"))

    def step(state: Column, c: Column) -> Column:
        quote, depth = state["quote"], state["depth"]
        inside = quote != ""
        protected = inside & (F.length(F.regexp_extract(state["part"], r"(\\\\*)$", 1)) % 2 == 1)
        closes = inside & (c == quote) & ~protected
        opens = ~inside & c.isin("'", '"', "`")
        now = F.when(closes, "").when(opens, c).otherwise(quote)
        level = F.when(inside, depth).when(c.isin("(", "[", "{"), depth + 1).when(c.isin(")", "]", "}"), F.greatest(depth - 1, F.lit(0))).otherwise(depth)
        cuts = ~inside & (c == ",") & (depth == 0)
        part = F.when(cuts, "").otherwise(F.concat(state["part"], c))
        done = F.when(cuts, F.array_append(state["done"], state["part"])).otherwise(state["done"])
        return F.struct(level.alias("depth"), now.alias("quote"), part.alias("part"), done.alias("done"))

    parts = F.aggregate(F.split(text(arguments), ""), start, step, lambda s: F.array_append(s["done"], s["part"]))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def contains_word(column: Column, word: str) -> Column:
    """Whether a word occurs that isn't part of a longer one (letters, digits, underscore)."""
    import re

    return F.lower(text(column)).rlike(f"(?<![a-z0-9_]){re.escape(word)}(?![a-z0-9_])")


def normalize_ref(column: Column) -> Column:
    """A dependency's bare name: lower case, without extras, version or environment marks."""
    return strip(F.regexp_replace(strip(F.lower(text(column))), r"(?s)[\[<>=~! ].*$", ""))


def expand_keys(symbol: Column) -> Column:
    """The names under which a symbol can be looked up: itself and its last segments, in lower case, without call brackets."""
    low = F.replace(strip(F.lower(text(symbol))), F.lit("()"), F.lit(""))
    last = [F.element_at(F.split(low, s), -1) for s in (r"\.", ":", "/", "->")]
    return F.array_distinct(F.filter(F.transform(F.array(low, *last), strip), lambda k: F.length(k) > 0))


def source_path_keys(path: Column) -> Column:
    """A path, its file name, stem, and dotted forms with and without extension, in lower case."""
    low = strip(F.lower(F.replace(text(path), F.lit("\\"), F.lit("/"))))
    name = F.element_at(F.split(low, "/"), -1)
    bare = F.regexp_replace(low, r"\.[^./]+$", "")
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    return F.array_distinct(F.filter(F.array(low, name, stem, F.replace(low, F.lit("/"), F.lit(".")), F.replace(bare, F.lit("/"), F.lit("."))), lambda k: F.length(k) > 0))


def location(path: Column, first: Column, last: Column) -> Column:
    """path:Lfirst-Llast, path:Lfirst or path."""
    return F.when(first.isNull(), text(path)).when(last.isNull() | (last == first), F.concat(text(path), F.lit(":L"), first.cast("string"))).otherwise(
        F.concat(text(path), F.lit(":L"), first.cast("string"), F.lit("-L"), last.cast("string"))
    )


def format_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal; null for null."""
    kb = 1024.0
    return (
        F.when(size < kb, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < kb**2, F.format_string("%.1f KB", size / kb))
        .when(size < kb**3, F.format_string("%.1f MB", size / kb**2))
        .when(size.isNotNull(), F.format_string("%.1f GB", size / kb**3))
    )
