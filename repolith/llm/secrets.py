"""Usable credentials in code, configuration and prose: found by place, and redacted without touching what surrounds them.

Code is read as lexical tokens: a literal is looked at if it is assigned to an identifier whose words name a credential (in snake, kebab
or camel case), stands under it as a key, or is passed to a call that sets one; annotations, fallbacks of the environment, constructors and
line breaks in between are crossed, and literals in parts ("a" + "b") are read as one. Comments, prose and configuration have no tokens of a
language: there, a name is followed over its delimiters on its line. Values with a telling form (signed tokens, keys with a provider's prefix, addresses with
user and password, authorisation headers, private-key blocks) need no name. Placeholders, masks, references, identifiers, hashes and
public keys are let through. Redaction overwrites the literal's characters only: delimiters, escapes and line ends stay.

Work is row by row inside the scan's partitions. Results: null and empty texts have no findings; a value counts on the line on which
it starts; a private key counts once; repeated rows count once.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm import codetokens
from repolith.llm.codetokens import Token

# Words that name a credential, alone or as a pair of neighbours.
CREDENTIAL_WORDS = frozenset("password passwd pwd passphrase secret secrets apikey credential credentials passcode".split())
CREDENTIAL_PAIRS = frozenset(
    "api key, api token, auth token, access token, refresh token, private token, session token, bearer token, bot token, secret key, signing key, encryption key, "
    "private key, access key, tls key, master key, license key, account key, db pass, smtp pass, user pass, root pass, admin pass, admin pw, db pw, root pw, user pw".split(", ")
)
# Words of a name whose value a person chose.
PASSWORD_WORDS = frozenset("password passwd pwd passphrase passcode pass pw".split())
# Names that hold other things as often as a credential; only a value that can't be one of these counts.
WEAK_NAMES = frozenset(["token"])
# First words of calls that take a credential to keep it, and constructors that only wrap a literal.
SETTERS = frozenset("set with use update change put store add assign configure".split())
WRAPPERS = frozenset("String string str bytes bytearray Buffer from SecretStr SecretString Secret Some Ok to_string byte".split())
# Words that make a name speak about a credential instead of holding one.
ABOUT_WORDS = frozenset(
    "hint name names length len min max budget prefix suffix env id ids url uri path file dir policy pool count ttl expiry expires age rotation label field title "
    "header regex pattern format type kind hash digest fingerprint integrity etag public limit size help prompt reset page form".split()
)

_split_words = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

_last_words = {n.rsplit(" ", 1)[-1] for n in CREDENTIAL_WORDS | CREDENTIAL_PAIRS}
#: What every credential's name has in it: the last words that hold no other one.
_stems = "|".join(sorted(w for w in _last_words if not any(o != w and o in w for o in _last_words)))
#: Where a line in small letters deserves a closer look: a stem, or what every telling form of a value has in it.
_hint = re.compile(rf"{_stems}|://|akia|gh[pousr]_|xox[abprs]-|sk_live_|rk_live_|eyj|basic\s|bearer\s|aiza|glpat-|\?sig|&sig")
#: The same for names only: their words with any separator or none.
_cred_hint = re.compile("|".join(sorted(n.replace(" ", "[_-]*") for n in CREDENTIAL_WORDS | CREDENTIAL_PAIRS)))
_code_hint = re.compile(_cred_hint.pattern + "|token")
_name = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:[_-]+[A-Za-z0-9]+)*")
_annotation = r"""(?:\s*:\s*(?:&\s*)?(?:'\w+\s+)?(?:static\s+)?[A-Za-z_][\w.<>\[\]]*(?=[ \t]+=\s)|\s*:\s*\([^()]*\)(?=\s*=)|\s+(?:string|str|String)(?=\s*=))?"""
_assign = re.compile(
    rf"""(?P<quote>["'`]?){_annotation}\s*(?P<sep>:=|=>|\|\||\?\?|=(?!=)|:(?!:)|\||,)[ \t]*"""
    r"""(?:(?:process\.env\.\w+|process\.env\[[^\]]*\]|os\.getenv\(\s*["']\w+["']\s*\)|os\.environ\.get\(\s*["']\w+["']\s*\))\s*(?:\|\||\?\?|or)\s*)?"""
    r"""(?:(?:[(]|>-?|\|-?)?[ \t\r]*\n(?:[ \t\r]*\n)?(?:L\d+:)?[ \t]+(?:L\d+:[ \t]*)?)?"""
)
_apart = re.compile(r"""`?\s+(?=\S)""")
_quoted = re.compile(r"""(?:[rbfuRBFU]{0,2})(\"\"\"|'''|["'`])((?:\\.|(?!\1)[^\\\n])*)\1""")
_parts = re.compile(r"""(["'])(?:[ \t]*\+[ \t]*|[ \t]+)\1""")
_plus = re.compile(r"[ \t]*(?:\+[ \t]*)?")
_bare = re.compile(r"""[^\s"'`,;|（）()\[\]{}<>]+""")

_forms = re.compile(
    r"(?P<jwt>\beyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{10,})"
    r"|(?P<prefixed>\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{16,}|[sr]k_live_[A-Za-z0-9]{12,}|AIza[\w-]{35}|glpat-[\w-]{20,}|AKIA[A-Z0-9]{16}\b))"
    r"|(?P<header>\bBasic\s+[A-Za-z0-9+/]{8,}={0,2}|\bBearer\s+[A-Za-z0-9._~+/-]{16,}=*)"
    r"|(?P<hook>https?://hooks?\.[^\s/\"'`]+/services/\w{6,}/\w{6,}/(?P<hooked>\w{16,}))"
    r"|(?P<url>\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@\"'`]*:(?P<inner>[^\s@/\"'`]+)@)"
    r"|[?&](?P<query>(?:api_?key|access_token|auth_token|token|sig|signature|secret|password|client_secret)=(?P<asked>[A-Za-z0-9%._~+/-]{8,}))"
)
_pem = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?P<body>(?:\\[nr]|\s|(?:L\d+:)?[ \t]*[A-Za-z0-9+/=]+|[\"'+`,])*)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?")

_reference = re.compile(r"\$\{|\$\(|\{\{|%\(|^\$|^<|^%[A-Z_]+%$|^env[:.]|^vault:|^secret:|^arn:|^ref\+|^@")
_masked = re.compile(r"^[xX*.•#_=+-]*$|x{5,}|\*{4,}|•{3,}|\.{3,}")
_placeholder = re.compile(
    r"(?i)^(?:your|my|the|some|any)[-_ ]|change[-_ ]?(?:me|this|it)|replace[-_ ]?(?:me|this|with)|example|place[-_ ]?holder|dummy|redacted|todo|fixme|insert[-_ ]|^(?:none|null|nil|true|false|undefined|password|passwd|secret|token|test|string|str)$"
)
#: Labels, messages, commands and types that stand under a password's name.
_speaks_about = re.compile(r"(?i)\b(?:passwords?|passwd|passphrases?|passcodes?|secrets?|credentials?)\b|\b(?:must|should|required|optional|invalid|missing|please|enter|confirm|forgot|at least)\b|(?:^|\s)--?[a-z]|^(?:text|hidden|boolean|varchar|char|number|object|any)$")
_constant = re.compile(r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*$")
_dotted = re.compile(r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$")

#: Languages in which a value without quotes is an expression, not a literal.
CODE = frozenset("py js mjs cjs jsx ts tsx go rs java c h cc cpp cs rb php".split())


def _small(text: str) -> str:
    """text in small letters, each at its place."""
    small = text.lower()
    return small if len(small) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def names_credential(name: str) -> bool:
    words = [w.lower() for w in _split_words.findall(name)]
    if ABOUT_WORDS.intersection(words):
        return False
    return bool(CREDENTIAL_WORDS.intersection(words)) or any(f"{a} {b}" in CREDENTIAL_PAIRS for a, b in zip(words, words[1:], strict=False))


def names_weakly(name: str) -> bool:
    return name.lower() in WEAK_NAMES


def sets_credential(callee: str) -> bool:
    """Whether a call by that name takes a credential."""
    words = [w.lower() for w in _split_words.findall(callee)]
    return len(words) > 1 and words[0] in SETTERS and (names_credential(callee) or words[1:] == ["token"])


def names_password(name: str) -> bool:
    """Whether a credential's name speaks of a word that a person chose, which can have any form."""
    return bool(PASSWORD_WORDS.intersection(w.lower() for w in _split_words.findall(name)))


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)


def is_usable(value: str, quoted: bool, chosen: bool = False) -> bool:
    """Whether a literal under a credential's name can be a real value. chosen: whether the name is one of a password."""
    if quoted and chosen:
        return bool(value.strip()) and not (_reference.search(value) or _masked.search(value) or _placeholder.search(value) or _constant.match(value) and "_" in value or _dotted.match(value) and not any(_mixed(p) or len(p) >= 20 for p in value.split(".")) or "://" in value or _speaks_about.search(value))
    if len(value) < 6 or " " in value or value.isdigit() or _reference.search(value) or _masked.search(value) or _placeholder.search(value):
        return False
    if _constant.match(value) and not (any(c.isdigit() for c in value) and "_" not in value and len(value) >= 16):
        return False
    if _dotted.match(value) and not any(_mixed(p) or len(p) >= 20 for p in value.split(".")):
        return False
    if "://" in value:
        return False
    strange = any(not c.isalnum() and c not in "_-." for c in value)
    if not any(c.isdigit() for c in value):
        return len(value) >= 12 and any(c.isupper() for c in value) and any(c.islower() for c in value) and (quoted or strange or len(value) >= 20) and not re.match(r"^(?:[A-Z]?[a-z]+)+$", value)
    if not any(c.isalpha() for c in value):
        return False
    return True


def _is_strong(value: str) -> bool:
    """Whether a value looks made by a machine: letters in both cases and digits, long, in one piece."""
    return len(value) >= 16 and _mixed(value) and re.fullmatch(r"[A-Za-z0-9_+/=.~-]+", value) is not None


def _follow(text: str, found: list[Token], at: int, key: bool) -> int | None:
    """Index of the string token that is assigned to, or stands under, the name in front of index `at`; key: the name is a string itself."""
    n = len(found)
    mark = lambda k: text[found[k].start : found[k].end] if k < n and found[k].kind in "on" else ""
    if key and mark(at) == "]":
        at += 1
    sep = mark(at)
    if sep == ":" and not key:
        # a type between the colon and the assignment, on the same line
        k, deep = at + 1, 0
        while k < n and k - at < 24 and found[k].kind in "on" and (deep or mark(k) not in ("=", ",", ";", ")", "{", "}")):
            deep += (mark(k) in "<[(") - (mark(k) in ">])")
            k += 1
        if mark(k) == "=" and k > at + 1 and "\n" not in text[found[at].start : found[k].start]:
            at = k
    elif sep in ("string", "str", "String") and mark(at + 1) == "=":
        at += 1
    if at >= n or mark(at) not in ("=", ":=", ":", "=>", "||", "??") and not (key and mark(at) == ","):
        return None
    at += 1
    grouped = False
    for _ in range(4):  # wrappers inside each other, and a fallback of the environment
        while mark(at) in ("(", "new", "await", "&"):
            grouped = grouped or mark(at) == "("
            at += 1
        word = mark(at)
        if word in ("process", "os") or word == "getenv":
            k = at
            while k < n and k - at < 14 and mark(k) not in ("||", "??", "or", ";"):
                k += 1
            if k >= n or mark(k) not in ("||", "??", "or"):
                return None
            at = k + 1
        elif word in WRAPPERS or word == "[" and mark(at + 2) == "byte":
            k = at
            while k < n and k - at < 8 and mark(k) != "(":
                k += 1
            if mark(k) != "(" or not all(mark(x) in WRAPPERS or mark(x) in (".", "::", ":", "[", "]", "byte") for x in range(at, k)):
                return None
            at = k + 1
        else:
            break
    # the first of several values in brackets is none that is assigned
    return at if at < n and found[at].kind == "s" and not (grouped and mark(at + 1) == ",") else None


def _with_parts(text: str, found: list[Token], at: int) -> tuple[str, list[tuple[int, int]]]:
    """The value of a string token and of those that are joined to it, and the places of their characters."""
    spans = codetokens.contents(text, found[at])
    while at + 1 < len(found):
        step = 2 if text[found[at + 1].start : found[at + 1].end] == "+" and found[at + 1].kind == "o" else 1
        if at + step >= len(found) or found[at + step].kind != "s" or step == 1 and "\n" in text[found[at].end : found[at + 1].start]:
            break
        at += step
        spans += codetokens.contents(text, found[at])
    return "".join(text[a:b] for a, b in spans), spans


def _code_secrets(text: str, extension: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """(value, places) of the literals in code that are assigned or passed to credentials."""
    found = [t for t in codetokens.tokens(text, extension) if t.kind != "c"]
    taken: list[tuple[str, list[tuple[int, int]]]] = []
    for k, token in enumerate(found):
        if token.kind == "n":
            name, key = text[token.start : token.end], False
        elif token.kind == "s" and token.end - token.start < 60:
            name, key = text[token.start : token.end].strip("\"'`"), True
            if not _name.fullmatch(name):
                continue
        else:
            continue
        low = name.lower()
        if not (_cred_hint.search(low) or low in WEAK_NAMES or "token" in low):
            continue
        weak = names_weakly(name)
        at: int | None = None
        if not key and sets_credential(name) and k + 2 < len(found) and text[found[k + 1].start : found[k + 1].end] == "(":
            # the last literal among the direct arguments
            depth, x = 1, k + 2
            while x < len(found) and depth and x - k < 40:
                sign = text[found[x].start : found[x].end] if found[x].kind == "o" else ""
                depth += (sign in ("(", "[", "{")) - (sign in (")", "]", "}"))
                if depth == 1 and found[x].kind == "s":
                    at = x
                x += 1
        elif weak or names_credential(name):
            at = _follow(text, found, k + 1, key)
        if at is None:
            continue
        value, spans = _with_parts(text, found, at)
        if value and (_is_strong(value) if weak else True) and is_usable(value, True, names_password(name)):
            taken.append((value, spans))
    return taken


def _real(form: re.Match[str]) -> tuple[int, int] | None:
    """The secret's place in a match of _forms, or None if it is none."""
    kind = form.lastgroup
    text = form.group()
    if form["prefixed"]:
        body = re.sub(r"^(?:gh[pousr]_|xox[abprs]-|[sr]k_live_|AIza|glpat-|AKIA)", "", text)
        return None if _masked.search(body) or "EXAMPLE" in text.upper() or len(set(body)) < 6 else form.span()
    if form["jwt"]:
        return form.span()
    if form["header"]:
        scheme, value = text.split(None, 1)
        if _masked.search(value) or _placeholder.search(value):
            return None
        if scheme == "Basic":
            try:
                plain = base64.b64decode(value + "=" * (-len(value) % 4)).decode("utf-8")
            except (binascii.Error, UnicodeDecodeError, ValueError):
                return None
            if ":" not in plain or _masked.search(plain.split(":", 1)[1]) or _placeholder.search(plain.split(":", 1)[1]):
                return None
        elif not (_mixed(value) or re.match(r"^[0-9a-f]{20,}$", value)):
            return None
        return form.end() - len(value), form.end()
    for group in ("hooked", "inner", "asked"):
        if form[group]:
            value = form[group]
            if _reference.search(value) or _masked.search(value) or _placeholder.search(value) or _constant.match(value) and "_" in value or re.match(r"^[:{]", value):
                return None
            if group == "asked" and not any(c.isdigit() for c in value) and not (any(c.islower() for c in value) and any(c.isupper() for c in value)):
                return None
            return form.span(group)
    raise AssertionError(kind)


def _join_parts(text: str, begin: int, end: int) -> tuple[str, list[int]]:
    """text[begin:end] with literals in parts joined, and the place of each of its characters."""
    piece = text[begin:end]
    if not _parts.search(piece):
        return piece, []
    places: list[int] = []
    at = 0
    for m in _parts.finditer(piece):
        places += range(begin + at, begin + m.start())
        at = m.end()
    places += range(begin + at, end)
    return "".join(text[p] for p in places), places


def _literal(text: str, at: int, sep: str, code: bool, limit: int) -> tuple[str, list[tuple[int, int]], bool] | None:
    """The literal at `at`: its value, the places of its contents and whether it is quoted."""
    m = _quoted.match(text, at)
    if m:
        spans = codetokens.outside_holes(text, *m.span(2)) if "f" in text[m.start() : m.start(1)].lower() else [m.span(2)]
        value = "".join(text[a:b] for a, b in spans)
        while (p := _plus.match(text, m.end())) and text[p.end() : p.end() + 1] in ('"', "'") and text[p.end() : p.end() + 1] == m.group(1):
            n = _quoted.match(text, p.end())
            if n is None or n.group(1) != m.group(1):
                break
            value += n.group(2)
            spans.append(n.span(2))
            m = n
        return (value, spans, True) if spans else None
    if code:
        return None
    m = _bare.match(text, at)
    if m and m.end() <= limit and text[m.end() : m.end() + 1] not in ("(", "["):
        end = m.end()
        value = m.group()
        while value and (value[-1] in ".:\\" or ord(value[-1]) >= 0x2000):
            value, end = value[:-1], end - 1
        return value, [(at, end)], False
    return None


def find_secrets(text: str, extension: str = "") -> list[list[tuple[int, int]]]:
    """For each value, the places of its characters."""
    found: dict[int, list[tuple[int, int]]] = {}
    taken: list[tuple[int, int]] = []
    for m in _pem.finditer(text):
        body = re.sub(r"\\[nr]|L\d+:|[\s\"'+`,]", "", m["body"])
        if len(body) >= 24 and not _masked.search(body[:24]) and len(set(body)) > 8:
            found[m.start()] = [m.span("body")]
        taken.append(m.span())
    done = -1
    length = len(text)
    small = _small(text)
    for hint in _hint.finditer(small):
        if hint.start() < done:
            continue
        begin = text.rfind("\n", 0, hint.start()) + 1
        end = text.find("\n", hint.start())
        end = length if end < 0 else end
        done = end
        if any(a <= begin and end <= b for a, b in taken):
            continue
        line, places = _join_parts(text, begin, end)
        for form in _forms.finditer(line):
            spot = _real(form)
            if spot:
                spans = [(begin + spot[0], begin + spot[1])] if not places else _runs(places[spot[0] : spot[1]])
                found.setdefault(spans[0][0], spans)
        row = text[begin:end]
        if not _cred_hint.search(small, begin, end):
            continue
        code_line = extension in CODE
        comment = re.match(r"\s*(?:L\d+:\s*)?(?:#|//|\*|/\*|--|;|<!--)", row)
        for name in _name.finditer(row):
            if not _cred_hint.search(small, begin + name.start(), begin + name.end()) or not names_credential(name.group()):
                continue
            at = begin + name.end()
            before = row[max(0, name.start() - 2) : name.start()]
            inside = before[-1:] in ("'", '"', "`")
            flag = before == "--" or before[-1:] == "-"
            m = _assign.match(text, at)
            if m and (m["quote"] in ("", before[-1:]) or m["quote"] == "`") and (m["sep"] != "," or inside) and (m["sep"] != "|" or row.lstrip().startswith("|")):
                value = _literal(text, m.end(), m["sep"], code_line and not comment and not flag and not (inside and not m["quote"]), length)
            elif flag or before[-1:] in (" ", "") and (n := _apart.match(text, at)) and (text[n.end()] == "`" or re.match(r"\s*(?:L\d+:\s*)?(?:#\s*)?(?:ENV|ARG)\s+\Z|\s*#\s*(?:old\s+|tmp\s+)?\Z", row[: name.start()])):
                n = _apart.match(text, at)
                value = _literal(text, n.end(), " ", code_line and not comment and not flag, end) if n else None
                if value and not value[2] and not flag and n and row[n.end() - begin :].strip() != value[0]:
                    value = None
            else:
                continue
            if value and is_usable(value[0], value[2], names_password(name.group())) and not any(a <= value[1][0][0] < b for a, b in taken):
                if _forms.search(value[0]) or re.match(r"(?:Basic|Bearer)\b", value[0]) or "AKIA" in value[0][:4]:
                    continue
                found.setdefault(value[1][0][0], value[1])
    if extension in CODE and _code_hint.search(small):
        for value, spans in _code_secrets(text, extension):
            if any(a <= spans[0][0] < b for a, b in taken) or _forms.search(value) or re.match(r"(?:Basic|Bearer)\b", value) or "AKIA" in value[:4]:
                continue
            if not any(a < spans[0][1] and spans[0][0] < b for held in found.values() for a, b in held):
                found[spans[0][0]] = spans
    return [found[k] for k in sorted(found)]


def _runs(places: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for p in places:
        if runs and runs[-1][1] == p:
            runs[-1] = (runs[-1][0], p + 1)
        else:
            runs.append((p, p + 1))
    return runs


def line_numbers(text: str, found: list[list[tuple[int, int]]]) -> list[int]:
    lines: list[int] = []
    at, line = 0, 1
    for spans in found:
        line += text.count("\n", at, spans[0][0])
        at = spans[0][0]
        if not lines or lines[-1] != line:
            lines.append(line)
    return lines


_secret_char = re.compile(r"(\\.|L\d+:)|[^\s\\\"'`+,]")


def redact(text: str, found: list[list[tuple[int, int]]]) -> str:
    """text with each character of the values replaced by *; escapes, quotes, line ends and what joins parts stay."""
    out: list[str] = []
    at = 0
    for a, b in sorted(s for spans in found for s in spans):
        if a < at:
            continue
        out += [text[at:a], _secret_char.sub(lambda m: m[1] or "*", text[a:b])]
        at = b
    return "".join(out) + text[at:]


def secret_lines(df: DataFrame) -> DataFrame:
    """(kind, key, line_no) of df's columns kind, key, part, extension and text. Where part isn't null, it is the line number of all of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            lines: list[int] = []
            for k, (part, extension, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                found = find_secrets(text, extension or "")
                if found:
                    own = line_numbers(text, found) if part is None else [part]
                    owner += [k] * len(own)
                    lines += own
            at = pa.array(owner, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lines, type=pa.int64())], names=["kind", "key", "line_no"])

    chosen = df.select("kind", "key", F.col("part").cast("bigint").alias("part"), "extension", "text").where("text is not null and text <> ''")
    return chosen.mapInArrow(run, "kind string, key string, line_no bigint").distinct()


def redacted(df: DataFrame) -> DataFrame:
    """(kind, key, part, secrets, text): every row with its number of values and its text without them; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[int] = []
            texts: list[str | None] = []
            for extension, text in zip(*(batch.column(c).to_pylist() for c in (3, 4)), strict=True):
                found = find_secrets(text, extension or "") if text else []
                counts.append(len(found))
                texts.append(redact(text, found) if found else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(counts, type=pa.int64()), pa.array(texts, type=pa.string())], names=["kind", "key", "part", "secrets", "text"])

    chosen = df.select("kind", "key", F.col("part").cast("bigint").alias("part"), "extension", "text")
    return chosen.mapInArrow(run, "kind string, key string, part bigint, secrets bigint, text string")
