"""Oversized texts cut into overlapping pieces at natural boundaries, by one regular expression in the JVM.

Alternatives in order of strength (blank line, line, sentence, white space, any character) each consume as much as the limit
allows; the bounded quantifiers keep every piece but the last longer than the overlap, so that the overlap of a piece comes from
the piece before it alone. Only built-in array and string functions are used: one pass, no shuffle, no Python.

Results: a text within the limit is one piece; null and empty texts have none; every character (code point) lies in exactly one
core, and pieces minus their overlaps joined give the text again. Repeated rows give their pieces again; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of sentences: a mark, closing quotes or brackets, then white space; marks of scripts without spaces need none.
MARKED = r"""(?:[.!?…؟।]["')\]”’»]{0,3}\s|[。！？]["'”’」』）]{0,3})"""


def core_pattern(size: int, overlap: int) -> str:
    """Consecutive matches cover a text; each has at most `size` characters and, unless it is the last, more than `overlap`."""
    half, least = max(size // 2, overlap + 1), overlap + 1
    block = r"\n[ \t\r]{0,20}\n"

    def up_to(low: int, tail: str, room: int) -> str:
        return f".{{{low},{size - room}}}{tail}"

    choices = [up_to(low, tail, room) for low in (half, least) for tail, room in ((block, 22), (r"\n", 1), (MARKED, 5))]
    # the end of the text counts as a boundary of any strength
    return "(?s)" + "|".join([f".{{1,{size}}}\\z", *choices, up_to(half, r"\s", 1), f".{{1,{size}}}"])


def tail_pattern(overlap: int) -> str:
    """Of the text before a piece: all from the first natural boundary on, which lies behind its first character or later."""
    return rf"(?s)\A.{{0,{overlap - 1}}}?(?:(?<=\n)|(?<={MARKED}))(.+)\z"


def cores(text: Column, limit: int = 1800, overlap: int = 150) -> Column:
    """The consecutive parts of a text without their overlaps, as array<string>."""
    size = limit - overlap
    parts = F.when(F.length(text) <= limit, F.filter(F.array(text), lambda t: F.length(t) > 0)).otherwise(F.regexp_extract_all(text, F.lit(core_pattern(size, overlap)), F.lit(0)))
    return F.coalesce(parts, F.array().cast("array<string>"))


def split(df: DataFrame, keys: list[str], text: str, limit: int = 1800, overlap: int = 150) -> DataFrame:
    """keys and (piece_no, start_pos, overlap, piece), a row for each piece; start_pos counts characters from 1, overlap included."""
    own = [F.col(k) for k in keys]
    cored = df.select(*own, cores(F.col(text), limit, overlap).alias("__cores"))
    measured = cored.select(*own, "__cores", F.transform("__cores", F.length).alias("__sizes"))
    # where each core begins: a running sum, one step for each core
    running = F.aggregate("__sizes", F.array(F.lit(0).cast("bigint")), lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + x))
    begun = measured.select(*own, "__cores", running.alias("__begins"))
    before_each = F.slice(F.concat(F.array(F.lit("")), "__cores"), F.lit(1), F.size("__cores"))
    zipped = F.arrays_zip(F.col("__cores").alias("core"), F.slice("__begins", F.lit(1), F.size("__cores")).alias("begin"), before_each.alias("before"))
    one = begun.select(*own, F.posexplode(zipped).alias("__k", "__p"))
    before = F.col("__p.before")
    natural = F.regexp_extract(F.right(before, F.lit(overlap + 1)), tail_pattern(overlap), 1)
    shared = F.when(F.length(natural) > 0, natural).otherwise(F.right(before, F.lit(overlap)))
    lapped = one.select(*own, "__k", "__p", shared.alias("__shared"))
    return lapped.select(
        *own,
        (F.col("__k") + 1).cast("bigint").alias("piece_no"),
        (F.col("__p.begin") + 1 - F.length("__shared")).cast("bigint").alias("start_pos"),
        F.length("__shared").cast("bigint").alias("overlap"),
        F.concat("__shared", F.col("__p.core")).alias("piece"),
    )
