"""Template residue and error-page text.

Lines of the content areas go down a prefix tree of fixed depth (number of words, then the first
words, with figures and site names masked); each leaf is a template. A template is classified once
by where it occurs, not by what it says: messages of servers, gates and scripts stand alone, on
pages whose content area holds nothing but a few such lines, on several hosts. The verdict is
carried to all lines of the leaf. Templates too rare to be judged so are taken for messages if a
page holds nothing else and they have words of messages. Unresolved slots, raw values and filler
inside ordinary lines are found separately, in every line.
"""

from __future__ import annotations

import re
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import main_content
from tidemark.session import cut_lineage

#: Words of a line that the tree looks at, besides their number.
DEPTH = 5
#: Lines of a content area that may stand alone, words of a line, and characters of an area of rare messages.
ALONE_LINES, ALONE_WORDS, ALONE_CHARACTERS = 3, 25, 160
#: Share of its lines that stand alone for a template of messages, and lines of doubt: a template
#: is judged when the share is on one side for these lines standing alone as well as for not.
ALONE_SHARE, DOUBT = 0.6, 3
#: Share of filler words, and words at least, for a line of filler.
FILLER_SHARE, FILLER_WORDS = 0.25, 4

_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
#: Slot forms of common template languages.
SLOT = (
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|#\{{\s*{_NAME}\s*\}}|\{{{_NAME}\}}|<%=?\s*{_NAME}\s*%>"
    rf"|\{{%\s*{_NAME}\s*%\}}|@@{_NAME}@@|%%{_NAME}%%|\$[A-Za-z][A-Za-z_.]*\$|«{_NAME}»"
    r"|(?<![A-Za-z0-9_])__[A-Za-z](?:[A-Za-z0-9.]|_(?!_))*__(?![A-Za-z0-9_])"
    r"|(?<![^\s(,])(?::[A-Za-z][A-Za-z_.]*:)(?![A-Za-z0-9])"
    r"|\[[a-z][a-z_.]*\]|\[[A-Z][A-Z_.]+\]|%[sd] of %[sd]"
)
#: Words of sentences that speak of slots instead of leaving one open.
SPEAKING = r"(?i)\bvariables?\b|\bplaceholders? (?:such|like)\b|\bstands for\b|\bin the editor\b|\bsyntax\b"
_SLOT, _SPEAKING = re.compile(SLOT), re.compile(SPEAKING)
#: Characters without which no slot can stand in a line; cheaper to look for than all forms.
_SIGN = re.compile(r"[{$<@%«#\[]|__|:[A-Za-z]")

#: Raw keys and values that code left where a text or a number belongs, at the
#: start of a line, or anywhere where one of the words stands.
RAW_START = re.compile(
    r"[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*){2,}$|MISSING_TRANSLATION|undefined\b(?! (?:limit|means|is|are|behaviou?r))"
    r"|(?:undefined|null|None)$|(?:undefined|null|NaN)\s[|–\-]"
    r"|(?:Price|Preis|Prix|Precio|価格)\s?:\s*(?:[£$€₹¥]|USD|EUR|GBP|INR|JPY)?\s*$"
)
RAW_WORDS = ("object Object", "Invalid Date", "NaN", "null", "undefined")
RAW_WITHIN = re.compile(
    r"\[object Object\]|\bInvalid Date\b|(?:^|[\s:£$€₹¥])NaN(?=$|[\s%€])|\bHello (?:null|undefined)\b|[|–\-]\s(?:undefined|null|NaN)$"
)
#: Sample texts of templates and editors, at the start of a line or anywhere.
SAMPLE_START = re.compile(
    r"(?:x{3,}\s*)+$|TODO\b|TBD\b|Sample (?:heading|text)\b|Text block:|Your Company Name\b|New page \(copy\)"
    r"|Untitled(?: document| page)?$|Lorem ipsum\b"
)
SAMPLE_WITHIN = (
    "Your text here", "Replace this paragraph", "(placeholder)", "title goes here", "your headline here",
    "Hier steht Ihr Text", "Votre texte ici", "Su texto aquí", "ここにテキスト", "ここに本文",
)
#: Words of the printers' filler passage, and those of them that no language uses.
FILLER = frozenset(
    (
        "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim "
        "minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure "
        "reprehenderit voluptate velit cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt "
        "culpa officia deserunt mollit anim laborum"
    ).split()
)
ONLY_FILLER = ("lorem", "ipsum", "consectetur", "adipiscing", "eiusmod", "incididunt", "ullamco", "cupidatat", "excepteur")
_PHRASE = re.compile(r"lorem\W+ipsum")
_WORD = re.compile(r"[^\W\d_]+")

#: Words of messages in five languages, for templates too rare to be judged by their places.
CUES = re.compile(
    r"(?i)^(?:http |error )?[45]\d\d(?:$|[ :–-]+[^\W\d])|javascript|\bscripts\b|\bcookies\b|\byour browser\b|not found"
    r"|cannot find|could not be (?:found|located)|\bdenied\b|\bforbidden\b|\bwas refused\b|\bhas expired\b|\btimed out\b"
    r"|\bunavailable\b|\bnot available\b|\bdown for\b.*\bmaintenance\b|\bagain later\b|\bplease (?:log|sign) in\b"
    r"|\brobot\b|\bhuman\b|^gone\b|too many requests|\bstart page\b|\b(?:use|try) the search\b|^loading\b|^error\b|\bfatal\b|exception\b|^traceback\b|went wrong|\boops\b|nicht gefunden"
    r"|verweigert|\bfehler (?:ist|\d)|interner fehler|ihr browser|sitzung|abgelaufen|skripten|wartungsarbeiten|wird gerade gewartet|introuvable"
    r"|accès refusé|erreur (?:interne|\d|est)|a expiré|en maintenance|no encontrada|acceso denegado|ha (?:caducado|expirado)"
    r"|mantenimiento|pruebe (?:a|el|la|con)\b|startseite\b|die suche\b|la recherche\b|お試しください|スクリプトが必要|見つかりません|エラーが|アクセスが拒否|メンテナンス中|ブラウザー?を|ログインして|読み込み中"
)
_STATUS = re.compile(r"[45]\d\d [A-Z]")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")


def open_slot(text: str) -> bool:
    """Whether a line has a slot outside a sentence that speaks of slots."""
    if not _SIGN.search(text) or not _SLOT.search(text):
        return False
    return any(_SLOT.search(s) and not _SPEAKING.search(s) for s in re.split(r"(?<=[.!?。])\s+", text))


def is_raw(text: str) -> bool:
    """Whether a line is a raw key, or has a raw or empty value where a text or number belongs."""
    text = text.strip()
    if RAW_START.match(text):
        return True
    return ("null" in text or "NaN" in text or "undefined" in text or any(w in text for w in RAW_WORDS)) and bool(RAW_WITHIN.search(text))


def is_filler(text: str) -> bool:
    """Whether a line is filler or sample text; to name the filler passage by its first words is neither."""
    text = text.strip()
    if SAMPLE_START.match(text) or any(w in text for w in SAMPLE_WITHIN):
        return True
    lower = text.lower()
    if not ("ipsum" in lower or "lorem" in lower or any(w in lower for w in ONLY_FILLER[2:])):
        return False
    words = _WORD.findall(lower)
    if len(words) >= FILLER_WORDS and len(FILLER.intersection(words)) >= 2 and sum(w in FILLER for w in words) >= FILLER_SHARE * len(words):
        return True
    return not set(ONLY_FILLER).isdisjoint(_WORD.findall(_PHRASE.sub(" ", lower)))


@lru_cache(maxsize=50_000)
def _short_residue(text: str) -> str | None:
    return _residue(text)


def _residue(text: str) -> str | None:
    return "slot" if open_slot(text) else "raw" if is_raw(text) else "filler" if is_filler(text) else None


def residue(text: str) -> str | None:
    """'slot', 'raw', 'filler', or null for a line without any of them."""
    return _short_residue(text) if len(text) <= main_content._LONG else _residue(text)


def leaf(masked: str) -> int:
    """Leaf of the prefix tree that a masked line goes to, as 64 bits: its words' number and first words."""
    words = masked.split()
    start = _NUMBER.sub("0", " ".join(words[:DEPTH]))
    made = xxhash.xxh3_64_intdigest(f"{len(words)} {start}")
    return made - (1 << 64) if made >= 1 << 63 else made


#: One row a page: what its title and lines hold, and its content area if it may stand alone or holds messages.
_SCHEMA = (
    "page_id long, host_id long, reason string, short boolean, few boolean, lines int, reals int, leaves array<long>, "
    "real array<boolean>, cues array<boolean>"
)
_ORDER = ("slot", "raw", "filler")


def _page(page, lookup) -> list[tuple]:
    sections = None if page.sections is None else list(page.sections)
    read = main_content.read_page(page.visible_text, sections, page.host or "", lookup, only_lines=True)
    area = [x for x, keep in zip(read.lines, read.content, strict=True) if keep]
    # What a template left is no link, so lines that were unsure by themselves are read as well.
    kinds = {residue(x.text) for x, keep, open_ in zip(read.lines, read.content, read.unsure, strict=True) if keep or open_}
    title = page.title or ""
    if title:
        kinds.add(residue(title))
    reason = next((k for k in _ORDER if k in kinds), None)
    value = [x.valued and not _STATUS.match(x.text) for x in area]
    reals = sum(x.sentence or v for x, v in zip(area, value, strict=True))
    short = len(area) <= ALONE_LINES and not any(v or x.words > ALONE_WORDS for x, v in zip(area, value, strict=True))
    few = sum(len(x.text) for x in area) <= ALONE_CHARACTERS
    told = short and few and title.count(" ") < DEPTH and bool(CUES.search(title))
    # Longer lines are no messages, so they need no template.
    held = [(x, v) for x, v in zip(area, value, strict=True) if x.words <= ALONE_WORDS]
    leaves = [leaf(x.masked) for x, _ in held]
    real = [x.sentence or v for x, v in held]
    cues = [short and few and (told or bool(CUES.search(x.text))) for x, _ in held]
    return [(page.page_id, page.host_id, reason, short, few, len(area), reals, leaves, real, cues)]


def message_templates(pages: DataFrame) -> DataFrame:
    """Leaves (leaf, lines, message) of rows of :func:`_page`; each template is classified once.

    A line stands alone on a page of at most ALONE_LINES short lines, none with a value, that all
    recur. ``message`` is null for templates with too few lines to be judged.
    """
    lines = pages.select("page", "host_id", "short", F.explode("leaves").alias("leaf"))
    counts = lines.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("lines"), (F.min("host_id") != F.max("host_id")).alias("hosts")
    )
    on_short = lines.filter("short").select("page", "leaf").join(counts, "leaf", "left")
    alone = (
        on_short.groupBy("page")
        .agg(F.collect_set("leaf").alias("leaves"), F.min("lines").alias("fewest"))
        .filter(F.col("fewest") >= 3)
        .select(F.explode("leaves").alias("leaf"))
        .groupBy("leaf")
        .agg(F.count(F.lit(1)).alias("alone"))
    )
    least = F.coalesce("alone", F.lit(0)) / (F.col("lines") + DOUBT)
    most = (F.coalesce("alone", F.lit(0)) + DOUBT) / (F.col("lines") + DOUBT)
    verdict = F.when(F.col("hosts") & (least >= ALONE_SHARE), True).when(most < ALONE_SHARE, False)
    return counts.join(alone, "leaf", "left").select("leaf", "lines", verdict.alias("message")).filter("message IS NOT NULL")


def residue_pages(pages: DataFrame) -> DataFrame:
    """Distinct (page_id, reason) of pages that a template or server left something on.

    Only the content area of ``visible_text`` and the title are read. A title counts for slots, raw
    values and filler; one with words of messages counts for the lines below it that are too rare
    to be judged, so a page without a content area is never a case of a message. Null and blank fields are left out. Messages count where no more sentences, list lines
    and prices stand beside them than messages. Pages without an id and repeated rows count once
    or not at all.
    """
    made = cut_lineage(main_content.over_sites(pages, _page, _SCHEMA))
    made = made.withColumn("page", F.xxhash64("page_id", "leaves"))
    lines = made.filter("reason IS NULL").select(
        "page", "page_id", "short", "few", F.col("lines").alias("lines_"), "reals", F.posexplode("leaves").alias("at", "leaf"), "real", "cues"
    )
    judged = lines.join(message_templates(made), "leaf", "left").select(
        "page",
        "page_id",
        "short",
        "few",
        F.col("lines_").alias("lines"),
        "reals",
        F.coalesce("message", F.lit(False)).alias("message"),
        F.coalesce(~F.col("message"), F.lit(False)).alias("ordinary"),
        F.get("real", F.col("at")).alias("real"),
        (F.col("message").isNull() & F.get("cues", F.col("at"))).alias("cue"),
    )
    told = (
        judged.groupBy("page", "page_id", "short", "few", "lines", "reals")
        .agg(
            F.count_if("message").alias("messages"),
            F.count_if(F.col("real") & F.col("message")).alias("real_messages"),
            (2 * F.count_if(F.col("message") | F.col("cue")) >= F.col("lines")).alias("mostly"),
            F.count_if("ordinary").alias("ordinary"),
        )
        .filter(((F.col("messages") > 0) & (F.col("reals") - F.col("real_messages") <= F.col("messages"))) | (F.col("short") & F.col("few") & F.col("mostly") & (F.col("ordinary") == 0)))
        .select("page_id", F.lit("message").alias("reason"))
    )
    return made.filter("reason IS NOT NULL").select("page_id", "reason").unionByName(told).groupBy("page_id").agg(
        F.max("reason").alias("reason")
    )
