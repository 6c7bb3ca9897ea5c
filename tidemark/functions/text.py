"""Text functions: Column in, Column out, inside whole-stage code wherever Spark can say it.

A null gives a null unless a docstring says otherwise. Word boundaries are ASCII ones, spelled as
look-arounds, since Java's ``\\b`` knows all letters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

B, E = "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", "(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
#: Fixed value: white space of all kinds.
SPACES = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"
#: The same characters one by one, for trimming without a pattern.
SPACE_CHARACTERS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Longest text that redaction lets through.
MAX_TEXT = 50_000

#: Shapes that are redacted, in the order in which they are replaced.
BEARER = rf"(?i){B}(bearer|basic)\s+[a-z0-9._~+/=:-]+"
QUERY_SECRET = r"(?i)([?&](?:token|access_token|api[_-]?key|key|secret|signature|sig|password|session)=)[^&#\s]+"
WEB_TOKEN = rf"{B}eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}(?:\.[A-Za-z0-9_-]{{8,}})?{E}"
PREFIXED = rf"(?i){B}(?:sk|pk|ghp|github_pat|xox[baprs])[-_A-Za-z0-9]{{12,}}{E}"
ASSIGNMENT = (
    rf"(?i){B}(password|passwd|secret|api[-_]?key|access[-_]?token|token|session|signature|sig)\s*[:=]\s*[^\s,;]+"
)
EMAIL = rf"(?i){B}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{E}"
PHONE = r"(?<![A-Za-z0-9_])\+?[0-9][0-9 ().-]{6,}[0-9](?![A-Za-z0-9_])"
#: Shapes that change with every rendering.
VOLATILE_UUID = rf"(?i){B}[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-5][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}{E}"
VOLATILE_LABEL = rf"(?i){B}(?:session|request|render|cache)[ _-]?(?:id|key|token)\s*[:=]\s*[A-Za-z0-9._-]{{6,}}{E}"
RENDER_TIME = (
    rf"(?i){B}(?:page\s+rendered|generated|rendered)\s+(?:at|on)\s+[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9:.+-]+(?:Z|UTC)?{E}"
)


def _form(col: Column, form: str) -> Column:
    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    udf = F.pandas_udf(batch, T.StringType())
    foreign = col.rlike(r"[^\x00-\x7f]")
    # Python sees only texts outside ASCII; for the others it gets a null.
    return F.when(foreign, udf(F.when(foreign, col))).otherwise(col)


def nfc(col: Column) -> Column:
    return _form(col, "NFC")


def nfkc(col: Column) -> Column:
    return _form(col, "NFKC")


def collapse(col: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(col, SPACES, " "))


def is_phone(candidate: str) -> bool:
    """Whether a run of digits and separators is a phone number and no date or plain number."""
    text = candidate.strip()
    digits = sum(c.isdigit() for c in text)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) or not 10 <= digits <= 15 or text.isdigit():
        return False
    return text.startswith("+") or any(c in " ().-" for c in text)


#: A pattern that no text has.
_NEVER = "(?!)"


def _where(col: Column, base: Column, signs: tuple[str, ...], pattern: str, by: str) -> Column:
    """A replacement that is only tried where one of its signs stands in the lower-case ``base``.

    Finding a literal is far cheaper than trying a pattern at every word. The choice is made in
    the pattern, not around the replacement, so that ``col`` stands in the expression once.
    """
    low = F.lower(base)
    found = low.contains(signs[0])
    for sign in signs[1:]:
        found = found | low.contains(sign)
    return F.regexp_replace(col, F.when(found, F.lit(pattern)).otherwise(F.lit(_NEVER)), F.lit(by))


def _secrets(col: Column, base: Column) -> Column:
    col = F.replace(col, F.lit("\r\n"), F.lit("\n"))
    col = _where(col, base, ("bearer", "basic"), BEARER, "$1 [REDACTED]")
    col = _where(col, base, ("?", "&"), QUERY_SECRET, "$1[REDACTED]")
    col = _where(col, base, ("eyj",), WEB_TOKEN, "[REDACTED]")
    col = _where(col, base, ("sk", "pk", "ghp", "github_pat", "xox"), PREFIXED, "[REDACTED]")
    return _where(col, base, ("passw", "secret", "api", "token", "session", "sig"), ASSIGNMENT, "$1=[REDACTED]")


def redact_secrets(col: Column) -> Column:
    """Credentials in their five shapes replaced."""
    return _secrets(col, col)


def redact_emails(col: Column) -> Column:
    return _where(col, col, ("@",), EMAIL, "[REDACTED_EMAIL]")


def redact(col: Column, limit: int = 2_000) -> Column:
    """Secrets, e-mail addresses and phone numbers replaced, trimmed and cut to ``limit``."""
    shape = re.compile(PHONE)

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: None
            if t is None
            else shape.sub(lambda m: "[REDACTED_PHONE]" if is_phone(m.group()) else m.group(), t)
        )

    phones = F.pandas_udf(batch, T.StringType())
    base = nfc(col)
    hidden = _where(_secrets(base, base), base, ("@",), EMAIL, "[REDACTED_EMAIL]")
    # A phone number has ten digits at least, a date has eight; only such texts go to Python.
    shaped = base.rlike(r"[0-9](?:[ ().-]*[0-9]){9}")
    done = F.when(shaped, phones(F.when(shaped, hidden))).otherwise(hidden)
    return F.substring(F.btrim(done, F.lit(SPACE_CHARACTERS)), 1, max(0, min(limit, MAX_TEXT)))


def clean(col: Column, limit: int = 2_000) -> Column:
    return redact(collapse(col), limit)


def nullable(col: Column, limit: int = 2_000) -> Column:
    """:func:`clean`, null where nothing is left."""
    return F.nullif(clean(col, limit), F.lit(""))


def mask_volatile(col: Column) -> Column:
    """Identifiers and times that change with every rendering replaced by fixed marks."""
    col = F.regexp_replace(col, VOLATILE_UUID, "[volatile-id]")
    col = F.regexp_replace(col, VOLATILE_LABEL, "[volatile-id]")
    return F.regexp_replace(col, RENDER_TIME, "[render-time]")


def glob_column(pattern: Column) -> Column:
    """Regular expression of a glob in a column: * up to 500 characters, ? any one."""
    safe = F.regexp_replace(pattern, r"([.+^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("(?is)"), F.regexp_replace(F.regexp_replace(safe, r"\?", "."), r"\*", ".{0,500}?"))


def drop_globs(col: Column, patterns: Column) -> Column:
    """Matches of the first ten globs of an array column replaced by a blank."""
    tried = F.coalesce(F.slice(patterns, 1, 10), F.array().cast("array<string>"))
    return F.aggregate(tried, col, lambda acc, p: F.regexp_replace(acc, glob_column(p), F.lit(" ")))


def _held(pattern: str) -> re.Pattern:
    """A shape for texts that Python holds; its ``\\b`` can be told to know ASCII alone, and also ends before a word."""
    return re.compile(pattern.replace(B, r"\b").replace(E, r"\b"), re.A)


#: Shapes with signs of which one stands in each lower-case text that has the shape.
_HELD_VOLATILE = tuple(
    (signs, _held(pattern), by)
    for signs, pattern, by in (
        (("-1", "-2", "-3", "-4", "-5"), VOLATILE_UUID, "[volatile-id]"),
        (("session", "request", "render", "cache"), VOLATILE_LABEL, "[volatile-id]"),
        (("generated", "rendered"), RENDER_TIME, "[render-time]"),
    )
)
_HELD_SECRETS = tuple(
    (signs, _held(pattern), by)
    for signs, pattern, by in (
        (("bearer", "basic"), BEARER, r"\1 [REDACTED]"),
        (("?", "&"), QUERY_SECRET, r"\1[REDACTED]"),
        (("eyj",), WEB_TOKEN, "[REDACTED]"),
        (("sk", "pk", "ghp", "github_pat", "xox"), PREFIXED, "[REDACTED]"),
        (("passw", "secret", "api", "token", "session", "sig"), ASSIGNMENT, r"\1=[REDACTED]"),
        (("@",), EMAIL, "[REDACTED_EMAIL]"),
    )
)
#: Runs of white space that are no single blank.
_HELD_SPACES = re.compile(f" {SPACES}|(?! ){SPACES}", re.A)
_HELD_PHONE = re.compile(PHONE)
_TEN_DIGITS = re.compile(r"[0-9](?:[ ().-]*[0-9]){9}")


def _held_shapes(value: str, shapes: tuple) -> str:
    low = value.lower()
    for signs, pattern, by in shapes:
        if any(sign in low for sign in signs):
            value = pattern.sub(by, value)
    return value


def _held_nfc(value: str) -> str:
    return value if value.isascii() else unicodedata.normalize("NFC", value)


def _held_redact(value: str, limit: int) -> str:
    value = _held_shapes(_held_nfc(value).replace("\r\n", "\n"), _HELD_SECRETS)
    if _TEN_DIGITS.search(value):
        value = _HELD_PHONE.sub(lambda m: "[REDACTED_PHONE]" if is_phone(m.group()) else m.group(), value)
    return value.strip(SPACE_CHARACTERS)[: max(0, min(limit, MAX_TEXT))]


@lru_cache(4_096)
def _held_glob(glob: str) -> tuple[int, list[re.Pattern], re.Pattern]:
    """Leading stars of a glob, the pieces between its stars, and the expression of what follows the leading stars."""
    made = lambda text: "".join("." if c == "?" else ".{0,500}?" if c == "*" else re.escape(c) for c in text)
    pieces = [re.compile(made(piece), re.I | re.S) for piece in glob.split("*") if piece]
    rest = glob.lstrip("*")
    return len(glob) - len(rest), pieces, re.compile(made(rest), re.I | re.S)


def _held_drop(value: str, glob: str) -> str:
    """Matches of a glob replaced by a blank.

    A leading star takes up to 500 characters before the first match of what follows, so this is
    searched for alone; trying the star at every character would take 500 steps for each.
    """
    ahead, pieces, rest = _held_glob(glob)
    if not pieces:  # It matches nothing at every place; Python's sub would go on from such a match to a longer one.
        return " ".join(["", *value, ""])
    at = 0
    for piece in pieces:
        found = piece.search(value, at)
        if found is None:
            return value
        at = found.end()
    if not ahead:
        return rest.sub(" ", value)
    kept, at = [], 0
    for found in rest.finditer(value):
        kept.append(value[at : max(at, found.start() - 500 * ahead)])
        at = found.end()
    return " ".join([*kept, value[at:]])


def held_noise(value: str, patterns=None) -> str | None:
    """What :func:`suppress_noise` does, for a text that Python holds."""
    value = _held_shapes(_HELD_SPACES.sub(" ", _held_nfc(value)).strip(" "), _HELD_VOLATILE)
    for glob in () if patterns is None else patterns[:10]:
        if glob is None:
            return None
        value = _held_drop(value, glob)
    return _held_redact(_HELD_SPACES.sub(" ", value).strip(" "), MAX_TEXT)


def held_noise_lines(value: str, patterns=None) -> str | None:
    """:func:`held_noise` of each line of a text, the lines kept."""
    made = [held_noise(line, patterns) for line in value.split("\n")]
    return None if None in made else "\n".join(made)


def _noise(held, col: Column, patterns: Column | None) -> Column:
    def batch(texts: pd.Series, globs: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else held(t, g) for t, g in zip(texts, globs, strict=True)], dtype=object)

    udf = F.pandas_udf(batch, T.StringType()).asNondeterministic()
    return udf(col, F.lit(None).cast("array<string>") if patterns is None else patterns)


def suppress_noise(col: Column, patterns: Column | None = None) -> Column:
    """Text without what changes by itself: volatile marks, ignored globs, secrets.

    One function in Python: as expressions, each step would stand several times in the next, and
    the whole in a filter over it once more. For that it also counts as not deterministic.
    """
    return _noise(held_noise, col, patterns)


def suppress_lines(col: Column, patterns: Column | None = None) -> Column:
    """:func:`suppress_noise` of each line of a text, the lines kept."""
    return _noise(held_noise_lines, col, patterns)


def slug(col: Column, ascii_only: bool = False) -> Column:
    """Lower-case words joined by dashes, 100 characters at most; 'unknown' if none."""
    col = F.lower(col if ascii_only else nfkc(col))
    col = F.regexp_replace(F.regexp_replace(col, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(F.substring(col, 1, 100), F.lit("")), F.lit("unknown"))


def model_id(col: Column) -> Column:
    return F.regexp_replace(F.upper(nfkc(col)), "[^A-Z0-9]", "")


def availability(col: Column) -> Column:
    low = F.lower(col)
    return (
        F.when(low.rlike("outofstock|out[ -]?of[ -]?stock|unavailable|sold[ -]?out"), "out_of_stock")
        .when(low.rlike("instock|in[ -]?stock|available"), "in_stock")
        .when(low.rlike("pre-?order"), "preorder")
        .otherwise(slug(col))
    )


#: Units in the order in which they are tried.
UNITS = (
    ("kilograms?|kgs?", "kg"),
    ("grams?|gms?", "g"),
    ("litres?|liters?|ltrs?", "l"),
    ("millilitres?|milliliters?|mls?", "ml"),
    ("metres?|meters?|mtrs?", "m"),
    ("centimetres?|centimeters?|cms?", "cm"),
    ("pieces?|pcs?", "piece"),
    ("months?|mo", "month"),
    ("years?|yr", "year"),
)


def unit(col: Column) -> Column:
    """Unit that is named first in the order of UNITS; null if none."""
    low = F.regexp_replace(F.lower(col), r"\.", "")
    return F.coalesce(*[F.when(low.rlike(f"{B}(?:{p}){E}"), F.lit(u)) for p, u in UNITS])


def pack_quantity(col: Column) -> Column:
    """Digits of the first of three ways to state a pack's size; null if none."""
    shapes = (
        rf"(?i){B}(?:pack\s+of|qty|quantity)\s*[:=]?\s*([0-9]{{1,5}}){E}",
        rf"(?i){B}([0-9]{{1,5}})\s*(?:pack|pk|pcs?|pieces?|units?){E}",
        rf"(?i){B}([0-9]{{1,5}})\s*[x×]",
    )
    return F.coalesce(*[F.nullif(F.regexp_extract(col, s, 1), F.lit("")) for s in shapes])


def currency(col: Column, fallback: Column | None = None) -> Column:
    """First word of three letters in upper case, else the symbol's code, else the fallback."""
    word = F.nullif(F.regexp_extract(col, f"(?i){B}([A-Z]{{3}}){E}", 1), F.lit(""))
    sign = (
        F.when(F.instr(col, "€") > 0, "EUR")
        .when(F.instr(col, "£") > 0, "GBP")
        .when(F.instr(col, "₹") > 0, "INR")
        .when(F.instr(col, "¥") > 0, "JPY")
    )
    found = F.coalesce(F.upper(word), sign)
    return found if fallback is None else F.coalesce(found, F.upper(fallback))


def version(col: Column) -> Column:
    """First version after 'v' or 'version': a number, then parts of letters, digits and dashes; null if none."""
    return F.nullif(F.regexp_extract(col, rf"(?i){B}v(?:ersion)?\s*([0-9]+(?:\.[0-9A-Za-z-]+)+){E}", 1), F.lit(""))


def escape_markdown(col: Column) -> Column:
    return F.regexp_replace(col, r"([\\`*_{}\[\]()#+.!|>-])", r"\\$1")


def csv_cell(col: Column) -> Column:
    """Quoted cell; an apostrophe goes before what a spreadsheet would run. Null is empty."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    text = F.when(text.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def clean_id(col: Column, length: int = 64, fallback: Column | None = None) -> Column:
    """Only letters, digits, - and _ kept; the fallback, or null, if none is left."""
    made = F.nullif(F.substring(F.regexp_replace(col, "[^A-Za-z0-9_-]", ""), 1, length), F.lit(""))
    return made if fallback is None else F.coalesce(made, fallback)
