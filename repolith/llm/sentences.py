"""Sentence units of texts in any language and script.

A text is first cut into blocks by its layout: blank lines, headings, list items, quote blocks and fenced code. Inside a block the
numbered rules of the standard for sentence boundaries decide, over the sentence-break properties of all characters: a paragraph
separator ends a sentence (SB4), marks of extension belong to the character before them (SB5), ATerm ends none before a number (SB6) or
between letters (SB7), nor where a small letter follows (SB8), no term ends one before what continues it (SB8a),
closing marks and white space belong to it (SB9, SB10), and all others end it (SB11). Tailored are: abbreviations of the paragraph's language
don't end a sentence, quotations and brackets are crossed as a whole, Latin marks need white space behind them, a single line break is a space,
and a script without sentence marks (Thai) is cut at its spaces. Offsets count code points. Work is row by row inside the scan's partitions, without a shuffle.

Results: null, empty and blank texts have no units; a paragraph's rest without a mark is a unit; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.session import spread


def _property(*names: str) -> str:
    """Members of sentence-break properties in all planes, as the inside of a character class."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    runs = regex.finditer("[" + "".join(rf"\p{{Sentence_Break={n}}}" for n in names) + "]+", every)
    return "".join(re.escape(m.group()[0]) + ("-" + re.escape(m.group()[-1]) if len(m.group()) > 1 else "") for m in runs)


def _closing() -> str:
    """The marks of the property Close that don't open, as the inside of a character class."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x20000))))
    return "".join(map(re.escape, regex.findall(r"[\p{Sentence_Break=Close}--[\p{Ps}\p{Pi}\p{So}]]", every, flags=regex.V1)))


# Abbreviations that never end a sentence, by language; "" has those that texts of all languages borrow.
NEVER_LAST = {
    "": "dr prof mr mrs vs cf e.g i.e al pp",
    "en": "ms mt st rev gen hon fig figs eq eqs nos eg ie approx resp p ch vol ed eds dept v viz",
    "de": "st nr abs kap bd bzw ca d z b s h ggü vgl evtl ggf inkl exkl sog u o hr fr str tel abb",
    "fr": "st m mm mme mlle env av apr p chap vol éd n° c.-à-d fig",
    "es": "sr sra srta dra d dña pág págs núm núms n.º aprox ej p vol fig",
    "ru": "см разд табл стр гл ст т п г ул пр тыс напр е ср",
    "hi": "डॉ प्रो श्री सुश्री पं",
    "ar": "د أ م ص ج ط ق.م هـ",
}
# Abbreviations that may also be a sentence's last word; what follows decides.
MAYBE_LAST = {
    "": "etc a.m p.m u.s u.k u.s.a e.u inc ltd co corp llc jr ph.d",
    "en": "sr ff",
    "de": "usw u.a v.chr n.chr ff",
    "es": "ee.uu",
    "ru": "д др пр",
}
# Abbreviations that are common words too. They don't end a sentence before a number, and do before another word that begins one.
WORD_TOO = {
    "en": "no max min tab est ref refs sec secs art cap ed",
    "de": "art tab",
    "fr": "art max min cap no tab réf",
    "es": "art cap max min máx mín ed ud uds tab",
    "ru": "рис",
}
# As before, but names or capital nouns follow these, so that only a frequent word behind them begins a sentence.
BEFORE_NAMES = {"de": "max min mind", "fr": "ex", "ru": "им"}
# Titles that are abbreviations only with a capital letter.
TITLES = {"en": "gen hon rev ms"}
# Units, which can end a sentence behind a number.
UNITS = frozenset("ms s min h d m mm g sec secs st г тыс".split())
# Month names after which a German ordinal stands.
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember"
# Frequent words by which the language of a paragraph is told.
FREQUENT = {
    "en": "the of and to in is that it for was on are as with they be at this have from or had by but what all were we when your can there an which their if will each how them then these some her would make him into has two more no not keep run you do does why its new old after before only i he she a an so plus me or",
    "de": "der die das und ist nicht mit ein eine einen einem einer zu von den dem des im auf für sich auch es an als er wie bei aus nach wird sind war werden noch nur oder aber wenn was wir ich sie am zum zur durch über vor dann danach diese dieser dieses warum wurde falls so hier bis kein keine alle jede in an man hat haben wurden will siehe",
    "fr": "le la les de des du un une et est en que qui dans pour pas ne sur au aux avec ce cette il elle se sont par plus ou mais nous vous ils son sa ses être ont été pourquoi si puis alors à l d c'est on tout toutes après avant aucun a on me or",
    "es": "el la los las de del un una y es en que no se por con para su al lo como más pero sus le ya o este esta son fue ha muy sin sobre también cuando si entre desde porque qué después luego antes todo todos cada a me he",
    "ru": "и в не на я что он с это а по но они мы она из за к у то для от так его же затем потом если как все этот эта почему после перед мне вы когда",
}
LATIN = ("en", "de", "fr", "es")


def _by_language(lists: dict[str, str]) -> dict[str, frozenset[str]]:
    return {k: frozenset((lists.get("", "") + " " + lists.get(k, "")).split()) for k in ("en", "de", "fr", "es", "ru", "hi", "ar")}


_never, _maybe, _word_too, _before_names, _titles, _frequent = map(_by_language, (NEVER_LAST, MAYBE_LAST, WORD_TOO, BEFORE_NAMES, TITLES, FREQUENT))
_any_listed = frozenset().union(*(ws for lists in (_never, _maybe, _word_too, _before_names) for ws in lists.values()))
_letters = re.compile(r"[^\W\d_]+")
_cyrillic, _devanagari, _arabic = re.compile("[\u0400-\u052f]"), re.compile("[\u0900-\u097f]"), re.compile("[\u0600-\u06ff]")
#: A number, also behind a stray word of another script.
_number_ahead = re.compile(r"(?:[^\x00-\u024f\s]+\s+)?[#§]?\d|(?=[IVXLC]{2}|[VX]\b)[IVXLC]+\b")
_number_behind = re.compile(r"\d\s*\Z")


def _told(text: str, label: str) -> list[str]:
    """The languages in Latin script whose frequent words stand most often in text; all of them where there is none. label decides ties."""
    words = [w.lower() for w in _letters.findall(text)]
    counts = [sum(w in _frequent[k] for w in words) + (k == label) / 2 for k in LATIN]
    return [k for k, n in zip(LATIN, counts, strict=True) if n == max(counts)]


class _Speech:
    """The language of each paragraph of a text: by the script of the word in question, then by its frequent words and the label, then by those of the text."""

    def __init__(self, text: str, label: str | None):
        self.text = text
        self.label = re.split("[-_ ]", (label or "").strip().lower())[0]
        self.told: dict[str, str] = {}

    def of(self, body: str, word: str) -> str:
        if _cyrillic.match(word):
            return "ru"
        if _devanagari.match(word):
            return "hi"
        if _arabic.match(word):
            return "ar"
        if body not in self.told:
            left = _told(body, self.label)
            if len(left) > 1 and self.label not in left:
                left = [k for k in _told(self.text, self.label) if k in left] or left
            self.told = {body: self.label if self.label in left else left[0]}
        return self.told[body]


_ATERM, _STERM, _LOWER, _UPPER, _OLETTER, _NUMERIC = (_property(n) for n in ("ATerm", "STerm", "Lower", "Upper", "OLetter", "Numeric"))
_SCONTINUE, _MARKS, _CLOSE = _property("SContinue"), _property("Extend"), _property("Close")
#: Marks that end a sentence without white space behind them.
_WIDE = "。｡！？．"
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_TERM = f"[{_ATERM}{_STERM}…‥]+"
#: SB8: a small letter behind white space and marks that open or close; behind other signs it begins a path or a tag, and with them a sentence.
_small_ahead = re.compile(rf"[\s{_CLOSE}{_MARKS}]*[{_LOWER}]")
_letter, _upper, _numeric, _aterm = (re.compile(f"[{c}]") for c in (_UPPER + _LOWER, _UPPER, _NUMERIC, _ATERM))
#: SB8a: what continues a sentence, behind closing marks and white space.
_continues = re.compile(rf"\s*[{_SCONTINUE}](?<![-–—])")
_OPEN = "\"'“‘„«‹「『（(\\[{¿¡`*_"
_SHUT = re.sub(r"[\"']", "", _closing())
#: Quotations, brackets and code spans, which sentences cross as a whole.
_SPAN = "|".join(
    ["“[^”]*”", "„[^“”]*[“”]", "«[^»]*»", "「[^」]*」", "『[^』]*』", '"[^"]*"', r"‘(?:[^’]|’(?=\w))*’(?!\w)", r"\([^()]*\)", "（[^（）]*）", "`[^`]*`"]
)
_mark = re.compile(f"(?P<span>{_SPAN})|(?P<term>{_TERM})[{_MARKS}]*(?P<shut>[{_SHUT}]*|(?<=[{_ATERM}!?])[\"'{_SHUT}]*)|(?P<para>\u2029)|(?P<thai>(?<=[฀-๿])\\s+(?=[฀-๿])|(?<=\\w)\\s+(?=[฀-๿]))")
# openers and the last place at which each can still be closed
_CLOSERS = {"“": re.compile("[”]"), "„": re.compile("[“”]"), "«": re.compile("»"), "「": re.compile("」"), "『": re.compile("』"), "‘": re.compile(r"’(?!\w)"), "`": re.compile("`")}
_opener = re.compile(f"[{''.join(_CLOSERS)}]")
_inner_end = re.compile(rf"({_TERM})\s*[\"'“{_SHUT}]+\Z")
#: Things of no language: special tokens, zero-width characters, pictures.
_JUNK = r"(?:</?s>|<\|\w+\|>|[​-‏﻿☀-➿\U0001f000-\U0001faff]+)"
_next = re.compile(rf"(?:\s|{_JUNK})*(?P<dots>\.\.+|…+)?(?P<open>[{_OPEN}]*)(?P<word>\S*)(?P<version>\s+v\d)?")
_junk = re.compile(_JUNK)
_rest_is_junk = re.compile(rf"(?:\s|{_JUNK})*\Z")
_lower = re.compile(f"[{_LOWER}]")
_identifier = re.compile(r"\w+(?:[._]\w\w|\w*[._]\w+[._]\w)|\w*_\w")
_before = re.compile(r"[^\s(（\[\"“„«‘]*\Z")
_thai = re.compile("[฀-๿]")

_heading = re.compile(r"\s{0,3}#{1,6}(?:\s|\Z)")
_item = re.compile(r"\s*(?:[-*+•]|\d{1,9}[.)])\s+(?=\S)")
_fence = re.compile(r"\s*(```+|~~~+)")
_quote = re.compile(r"\s*(?:>\s?)+")


def blocks(text: str) -> Iterator[tuple[int, int, str | None]]:
    """(start, end, masked) of each block. masked has spaces for list and quote marks; None for blocks that are one unit."""
    lines = text.split("\n")
    at = 0
    begin, kind, parts = 0, "", []
    fence = ""
    for line in lines:
        end = at + len(line)
        first = line.lstrip()[:1]
        if fence:
            if line.lstrip().startswith(fence) and not line.strip().strip(fence[0]):
                yield begin, end, None
                fence = ""
        elif first in "`~" and first and (m := _fence.match(line)):
            if parts:
                yield begin, at, "\n".join(parts)
                parts = []
            fence, begin = m.group(1), at
        elif not first:
            if parts:
                yield begin, at, "\n".join(parts)
                parts = []
        elif first == "#" and _heading.match(line):
            if parts:
                yield begin, at, "\n".join(parts)
                parts = []
            yield at, end, None
        elif (first in "-*+•" or first.isdigit()) and (m := _item.match(line)):
            if parts:
                yield begin, at, "\n".join(parts)
            begin, kind, parts = at, "item", [" " * m.end() + line[m.end() :]]
        elif first == ">":
            m = _quote.match(line)
            inner = line[m.end() :]
            if parts and (kind != "quote" or _item.match(inner) or not inner.strip()):
                yield begin, at, "\n".join(parts)
                parts = []
            if not parts:
                begin, kind = at, "quote"
            parts.append(" " * m.end() + inner)
        else:
            if parts and kind == "quote":
                yield begin, at, "\n".join(parts)
                parts = []
            if not parts:
                begin, kind = at, "text"
            parts.append(line)
        at = end + 1
    if fence:
        yield begin, len(text), None
    elif parts:
        yield begin, len(text), "\n".join(parts)


def _standard(body: str, at: int, end: int, last: str, following: int) -> bool:
    """Whether SB6 to SB11 end a sentence behind the term that ends with `last`, begins at `at` and is closed until `end`; following: where what follows begins."""
    if _aterm.match(last):
        if body[end - 1 : end] == last and (_numeric.match(body, end) or at > 0 and _letter.match(body, at - 1) and _upper.match(body, end)):
            return False  # SB6, SB7
        if _small_ahead.match(body, following):
            return False  # SB8
    return not _continues.match(body, following)  # SB8a, SB9 to SB11


def _ends(body: str, start: int, mark: str, at: int, end: int, span: str, speech: _Speech) -> bool:
    """Whether the sentence that began at `start` ends with `mark` at `at`, closed until `end`. span: the quotation closed here, or ''."""
    follow = _next.match(body, end)
    spaced = end < len(body) and body[end].isspace()
    last = mark[-1]
    cjk_before = at > 0 and re.match(f"[{_CJK}]", body[at - 1]) is not None
    wide = last in _WIDE or (cjk_before and last in ".!?" and len(mark) == 1)
    dots = "…" in mark or "‥" in mark or mark.endswith("..")
    if span:
        opened = _junk.sub("", body[start : end - len(span)]).rstrip()
        if span[0] in "(（":
            if wide:
                # a bracket inside a sentence follows its word without a space
                return not opened or body[end - len(span) - 1].isspace()
        elif wide:
            return opened.endswith((":", "："))
    if dots and last in ".…‥":
        if not spaced:
            return False
        if not re.search(r"\S\s+\S", _junk.sub("", body[start:at]).strip()):
            return False
    elif wide:
        return True
    if not spaced:
        return last not in ".!?" and not dots
    word, opening = follow["word"], follow["open"]
    if not word and not opening and not follow["dots"]:
        return True
    starts = not _lower.match(word) or bool(_identifier.match(word)) or follow["version"] is not None
    if last == "." and not dots and not span:
        before = _before.search(body, max(start, at - 24), at).group()
        plain = before.rstrip(".").lower()
        tail = plain.rsplit("-", 1)[-1]
        single = len(plain) == 1 and plain.isalpha()
        if single or plain in _any_listed or tail in _any_listed:
            language = speech.of(body, plain)
            if plain in UNITS and before[:1].islower() and _number_behind.search(body, max(start, at - 40), at - len(before)):
                return (starts and not _number_ahead.match(body, follow.start("word"))) or follow["dots"] is not None
            if plain in _maybe[language]:
                return starts or follow["dots"] is not None
            if plain in _word_too[language] or plain in _titles[language] and before[:1].islower():
                return (starts and not _number_ahead.match(body, follow.start("word"))) or follow["dots"] is not None
            if plain in _before_names[language]:
                return (starts and "".join(_letters.findall(word)[:1]).lower() in _frequent[language]) or follow["dots"] is not None
            if plain in _never[language] or tail in _never[language] or single:
                return False
        if before.isdigit() and len(before) <= 2 and word.rstrip(".,;:") in MONTHS.split():
            return False
    if follow["dots"] is not None:
        return True
    return starts and (follow["version"] is not None or bool(_identifier.match(word)) or _standard(body, at, end, last, follow.start("open")))


def _closable(body: str) -> str:
    """body with a dash for every opening mark that nothing closes any more, so that no search for its end runs to the end of the text."""
    for opener, closer in _CLOSERS.items():
        if opener in body and not (opener == "“" and "„" in body):  # which closes the other one
            last = max((m.start() for m in closer.finditer(body)), default=-1)
            body = body[: last + 1] + body[last + 1 :].replace(opener, "-")
    return body


def unit_ends(text: str, label: str | None = None) -> list[int]:
    """End of each unit: the number of characters up to and including its last non-blank one. label: the text's language, where known."""
    found: list[int] = []
    speech = _Speech(text, label)
    for begin, end, body in blocks(text):
        if body is None:
            found.append(begin + len(text[begin:end].rstrip()))
            continue
        start = 0
        has_thai = _thai.search(body) is not None
        for m in _mark.finditer(_closable(body) if _opener.search(body) else body):
            kind = m.lastgroup
            if m["para"] is not None:
                stop = m.start()
            elif m["thai"] is not None:
                token = body[max(start, body.rfind(" ", start, m.start()) + 1) : m.start()]
                if not _thai.search(token):
                    continue
                stop = m.start()
            else:
                span = m["span"]
                if span is not None:
                    inner = _inner_end.search(span)
                    if inner is None or span[0] == "`":
                        continue
                    mark, at, stop = inner.group(1), m.start() + inner.start(), m.end()
                    shut = m.end()
                    while shut < len(body) and body[shut] in "\"'”’»」』）)]":
                        shut += 1
                    stop = shut
                    span = body[m.start() : stop]
                else:
                    mark, at, stop, span = m["term"], m.start(), m.end(), ""
                if not _ends(body, start, mark, at, stop, span, speech):
                    continue
            if _rest_is_junk.match(body, stop):
                break
            if body[start:stop].strip():
                found.append(begin + start + len(body[start:stop].rstrip()))
                start = stop
        rest = body[start:].rstrip()
        if rest.strip():
            found.append(begin + start + len(rest))
    return found


def sentence_ends(df: DataFrame, key: str, text: str, label: str | None = None) -> DataFrame:
    """(key, end_pos), a row for each unit of each text. label: the column of the texts' languages, if there is one."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [unit_ends(t, k) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            owners = pa.array([k for k, e in enumerate(ends) for _ in e], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owners), pa.array([e for es in ends for e in es], type=pa.int64())], names=[key, "end_pos"])

    language = F.col(label) if label else F.lit(None)
    return spread(df.select(key, text, language.cast("string").alias("language")).where(F.col(text).isNotNull())).mapInArrow(run, f"`{key}` {kind}, end_pos bigint")
