"""Main body of web pages without the furniture of their site.

Each page is a stream of parser events that give lines with their text and tags. Texts of tables
have lost their tags, so the tags of a line are made from what the site does with it: a line that
many pages of its host repeat, an entry of a menu, an item of a list of links counts as tagged
text. The text-to-tag ratios of a page's lines, on a log scale, are smoothed with a Gaussian and
cut at a threshold; the lines above it form the content regions. No phrases are listed: which
lines are furniture, open a list of links or belong to a menu is counted over all pages.

Counts are made with map-side aggregation. What is known of a host's lines goes to the tasks that
hold its pages as rows of the same shuffle, so nothing is broadcast or collected; hosts with
many pages are split.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import each_part, hot_parts, part_of, with_parts
from tidemark.session import cut_lineage

#: Shares of a host's pages from which a sentence, or another line, counts as fully tagged.
SENTENCE_SHARE, LINE_SHARE = 0.05, 0.09
#: The same for a line with figures and site names masked, on the host that repeats it most.
TEMPLATE_SHARE = 0.3
#: Share of its occurrences in which a line is followed by two short lines, to open a list of links,
#: and its share on the host that repeats it most.
OPENS, OPENER_SHARE = 0.75, 0.06
#: Share of its occurrences in which a label stands in a menu at the top of a page.
MENU = 0.5
#: Tags of a line: a base, and as many per word; entries of a menu count as more.
TAGS, TAGS_WORD, TAGS_ENTRY = 4, 3, 4
#: Text-to-tag ratio at the threshold, and most characters of a line that count.
THRESHOLD, CHARACTERS = 4.0, 400
#: Width of the Gaussian in lines, and bound of a log ratio.
SIGMA, BOUND = 0.5, 3.0
#: Log ratio of lines that may be a link or a heading: just below the threshold, so that the
#: lines beside them decide.
UNSURE = 0.02
#: Log ratio from which a line surely begins the body.
BODY = 0.5
#: Pages of a host from which it is split, and of a part.
PAGES = 5_000

_DIGITS = re.compile(r"\d+")
_END = re.compile(r"[.!?。！？…:;]['”\")]*$")
_LINKED = re.compile(r"\s(?:\(\d+[^()]{0,20}\)|[–—]\s\S+(?:\s\S+)?|[→»›])$")
_SEPARATOR = re.compile(r"\s(?:[|·/•»>›])\s|\s{2,}")
_DATE = re.compile(r"\d{4}-\d\d?-\d\d?|\d{1,2}\.? [^\W\d]+ \d{4}|[^\W\d]+ \d{1,2}, \d{4}|\d{4}年")
_PRICE = re.compile(r"\d[\d.,]*\s?(?:[A-Z]{3}|[€$£¥₹円])$|[€$£¥₹]\s?\d[\d.,]*$")
_WIDE = re.compile(r"[⺀-鿿가-힣豈-﫿＀-￯]")
_NAMES = re.compile(r"[^a-z0-9]+")
_SENTENCE_WORDS, _ENTRY, _SHORT = 5, 24, 80
#: Characters from which a sentence counts as it is, without a template.
_LONG = 200


class LineEvents(HTMLParser):
    """Collects (text, tags) per line from parser events; feed() takes a page in pieces."""

    BLOCKS = frozenset(
        "p div section article main header footer nav aside ul ol li table tr td th h1 h2 h3 h4 h5 h6 br hr form "
        "blockquote pre dl dt dd figure figcaption title body html".split()
    )
    SKIPPED = frozenset(("script", "style", "noscript", "template"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self._text: list[str] = []
        self._tags = 0
        self._skip = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append((text, self._tags))
            self._tags = 0
        self._text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self._skip += 1
        if tag in self.BLOCKS:
            self._flush()
        self._tags += 1

    def handle_endtag(self, tag):
        if tag in self.SKIPPED and self._skip:
            self._skip -= 1
        self._tags += 1
        if tag in self.BLOCKS:
            self._flush()

    def handle_data(self, data):
        if not self._skip:
            self._text.append(data)

    def close(self):
        super().close()
        self._flush()


class Line(NamedTuple):
    """A line: text, text with figures and site names masked, words, weight in characters, and forms."""

    text: str
    masked: str
    words: int
    weight: int
    sentence: bool
    valued: bool  # begins with a figure, or holds a date or price
    dated: bool  # holds a date or price
    label: bool  # a few words without figures
    entries: int  # of a menu in one line
    linked: bool  # ends like a link: reading time, arrow, call
    tags: int
    parted: bool  # by separators of menus and trails
    ended: bool  # by a full stop or the like
    exact: bool  # whether it counts as it is, besides its template


class Known(NamedTuple):
    """What the site does with a line: its share of the host's pages, and see the parameters above."""

    share: float = 0.0
    most: float = 0.0
    menu: bool = False
    opener: bool = False


_NOTHING = Known()


@lru_cache(maxsize=4096)
def _site_names(host: str):
    names = sorted({x for x in _NAMES.split(host.lower()) if len(x) > 3}, key=lambda x: (-len(x), x))
    return re.compile(r"(?<![^\W_])(?:" + "|".join(names) + r")(?![^\W_])", re.IGNORECASE) if names else None


def is_sentence(text: str) -> bool:
    return bool(_END.search(text)) and (text.count(" ") + 1 >= _SENTENCE_WORDS or not text.isascii() and len(text) >= 8)


def menu_entries(text: str) -> int:
    """Number of short entries that separators join; 0 for less than three, or for other text."""
    parts = [p for p in _SEPARATOR.split(text) if p]
    return len(parts) if len(parts) >= 3 and all(len(p) <= _ENTRY and not p.endswith(".") for p in parts) else 0


def _line(text: str, host: str) -> Line:
    plain, tags = text, 0
    if "<" in text or "&" in text:
        parser = LineEvents()
        parser.feed(text)
        parser.close()
        plain = " ".join(t for t, _ in parser.lines) or text
        tags = sum(n for _, n in parser.lines)
    if len(plain) > _LONG and is_sentence(plain):
        wide = 0 if plain.isascii() else len(_WIDE.findall(plain))
        return Line(text, text, plain.count(" ") + 1 + wide // 3, len(plain) + 2 * wide, True, False, False, False, 0, False, tags, False, True, False)
    masked, figures = _DIGITS.subn("0", " ".join(plain.split()))
    if (names := _site_names(host)) is not None:
        masked = names.sub("#", masked)
    wide = 0 if plain.isascii() else len(_WIDE.findall(plain))
    words = plain.count(" ") + 1 + wide // 3
    ended = bool(_END.search(plain[-8:]))
    sentence = ended and is_sentence(plain)
    parted = not sentence and bool(_SEPARATOR.search(plain))
    dated = not sentence and bool(figures) and bool(_DATE.search(plain) or _PRICE.search(plain))
    return Line(
        text,
        masked,
        words,
        len(plain) + 2 * wide,
        sentence,
        not sentence and bool(figures) and (plain[0].isdigit() or dated),
        dated,
        words <= 3 and not figures and not ended,
        menu_entries(plain) if parted else 0,
        not sentence and bool(_LINKED.search(plain)),
        tags,
        parted,
        ended,
        bool(figures) or masked != text,
    )


@lru_cache(maxsize=50_000)
def _short_line(text: str, host: str) -> Line:
    return _line(text, host)


def line_of(text: str, host: str) -> Line:
    """The line of a text on a host; lines recur on pages, so the short ones are remembered."""
    return _short_line(text, host) if len(text) <= 160 else _line(text, host)


def page_lines(text: str | None, host: str) -> tuple[list[int], list[Line]]:
    """Numbers and lines of the non-blank lines of a page."""
    numbers, lines = [], []
    for k, part in enumerate((text or "").split("\n")):
        part = part.strip()
        if part:
            numbers.append(k)
            lines.append(line_of(part, host))
    return numbers, lines


def top_menu(lines: list[Line]) -> int:
    """Number of different labels that a page begins with, if these are a menu: three at least."""
    seen: set[str] = set()
    for x in lines:
        if not x.label or x.text in seen:
            break
        seen.add(x.text)
    return len(seen) if len(seen) >= 3 else 0


def _item(x: Line) -> bool:
    """Whether a line may be an item of a list of links."""
    return not x.ended and not x.valued and not x.entries and len(x.text) <= _SHORT


@lru_cache(maxsize=8)
def _kernel(sigma: float) -> tuple[float, ...]:
    """Weights of the neighbours on one side, up to three widths away."""
    return tuple(math.exp(-k * k / (2 * sigma * sigma)) for k in range(1, int(3 * sigma) + 1))


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing with the kernel renormalised at both ends."""
    n = len(values)
    total, weight = list(values), [1.0] * n
    for k, w in enumerate(_kernel(sigma), 1):
        for i in range(n - k):
            total[i] += w * values[i + k]
            total[i + k] += w * values[i]
            weight[i] += w
            weight[i + k] += w
    return [t / w for t, w in zip(total, weight, strict=True)]


def log_ratio(weight: float, tags: float) -> float:
    """Text-to-tag ratio on a log scale; 0 is the threshold."""
    return max(-BOUND, min(BOUND, math.log(max(1.0, min(weight, CHARACTERS)) / (1 + tags) / THRESHOLD)))


def repeated(x: Line, known: Known) -> float:
    """From 0 to 1, how much a line is one that the site repeats.

    Dates and prices aren't: their form says nothing of them.
    """
    if x.dated:
        return 0.0
    own = 0.0 if x.valued else min(1.0, (known.share / (SENTENCE_SHARE if x.sentence else LINE_SHARE)) ** 2)
    return own if x.label else max(own, min(1.0, (known.most / TEMPLATE_SHARE) ** 6))


def line_scores(lines: list[Line], lookup) -> tuple[list[float], list[bool]]:
    """Smoothed log ratios of a page's lines, and which lines were unsure by themselves.

    ``lookup`` gives what is known of a line. Lines that the site repeats, before the body begins,
    are left out of the smoothing: a notice between a heading and its body doesn't part them.
    """
    menu = top_menu(lines)
    ratios, cut, unsure = [], [], []
    entries: set[str] = set()
    in_list = False
    for i, x in enumerate(lines):
        known = lookup(x)
        f = 0.0 if known is _NOTHING else repeated(x, known)
        heading = False  # an entry of the menu that stands elsewhere
        if x.label and known.menu:
            f, heading = (1.0, False) if i < menu else (0.0, True)
        elif x.label and x.text in entries:
            f, heading = 0.0, True
        if known.opener:
            f = 1.0
        tags = x.tags + f * (TAGS + TAGS_WORD * x.words) if f else x.tags
        joined = x.entries
        if joined:
            entries.update(_SEPARATOR.split(x.text))
        elif x.parted:
            parts = _SEPARATOR.split(x.text)
            joined = len(parts) if len(parts) > 2 or lookup(line_of(parts[0] or " ", "")).share > 0.2 else 0
        if joined:
            tags = max(tags, TAGS_ENTRY * joined + x.words)
        ratio = log_ratio(x.weight, tags)
        open_ = False
        if known.opener:
            in_list = True
        elif x.linked:
            ratio = log_ratio(x.weight, max(tags, TAGS + TAGS_WORD * x.words))
        elif in_list and _item(x) and f < 0.5 and not heading:
            ratio, open_ = min(ratio, -UNSURE), True
        else:
            in_list = False
        ratios.append(ratio)
        unsure.append(open_)
        cut.append((f >= 0.9 or joined > 0) and not known.opener)
    out = list(ratios)
    kept, begun = [], False
    for i, ratio in enumerate(ratios):
        if cut[i] and not begun:
            continue
        kept.append(i)
        begun = begun or ratio > BODY
    for i, v in zip(kept, smooth([ratios[i] for i in kept]), strict=True):
        if not cut[i]:
            out[i] = v
    return out, unsure


def html_content(pieces) -> list[str]:
    """Lines of the content regions of an HTML page that is given in pieces, by its own tags."""
    parser = LineEvents()
    for piece in pieces:
        parser.feed(piece)
    parser.close()
    lines = [line_of(text, "")._replace(tags=3 * tags) for text, tags in parser.lines]
    scores, _ = line_scores(lines, lambda x: _NOTHING)
    return [x.text for x, s in zip(lines, scores, strict=True) if s > 0]


def joined_lines(section: str, texts: list[str]) -> list[int]:
    """Places of the lines that a section joins; empty if they make less than half of it."""
    best: list[int] = []
    most = 0
    for start, text in enumerate(texts):
        if not section.startswith(text):
            continue
        at, used = 0, []
        for k in range(start, len(texts)):
            piece = texts[k]
            if section.startswith(piece, at) and (at + len(piece) == len(section) or section[at + len(piece)] == " "):
                used.append(k)
                at += len(piece) + 1
                if at >= len(section):
                    break
        if at > most:
            best, most = used, at
    return best if most >= 0.5 * len(section) else []


def section_score(section: str, host: str, lookup, longest: int = 24) -> float:
    """Log ratio of a section that no line of its page begins.

    The longest runs of words that the site repeats as lines of their own are its tagged parts.
    """
    words = section.split()
    tags, k = 0.0, 0
    while k < len(words):
        step = 1
        for n in range(min(longest, len(words) - k), 0, -1):
            x = line_of(" ".join(words[k : k + n]), host)
            f = repeated(x, lookup(x))
            if f >= 0.5:
                tags += f * (TAGS + TAGS_WORD * x.words)
                step = n
                break
        k += step
    x = line_of(section, host)
    return log_ratio(x.weight, max(tags, TAGS_ENTRY * x.entries + x.words if x.entries else x.tags))


class Page(NamedTuple):
    """A page's lines with their numbers, which are content, which were unsure, and its sections' verdicts."""

    numbers: list[int]
    lines: list[Line]
    content: list[bool]
    unsure: list[bool]
    sections: list[int]


def read_page(visible: str | None, sections: list[str | None] | None, host: str, lookup, only_lines: bool = False) -> Page:
    """Content lines and sections of a page; with ``only_lines`` sections are only asked about unsure lines.

    A section is one block and of one kind: its lines above the threshold against those below,
    by their characters. Lines that were unsure don't vote where others do, and follow the others.
    """
    numbers, lines = page_lines(visible, host)
    scores, unsure = line_scores(lines, lookup)
    verdict = [s > 0 for s in scores]
    found: list[tuple[int, list[int], str]] = []
    if sections is not None and len(sections) and (not only_lines or any(unsure)):
        texts = [" ".join(x.text.split()) for x in lines]
        for k, section in enumerate(sections):
            joined = " ".join((section or "").split())
            if joined:
                found.append((k, joined_lines(joined, texts), joined))
        for _, used, _ in found:
            sure = [i for i in used if not unsure[i]]
            if not sure and len(used) > 1:
                # Two headings in a row are rarer than a list of links without its last line.
                for i in used:
                    verdict[i] = False
            if sure:
                weight = sum((1 + len(texts[i])) * (1 if verdict[i] else -1) for i in sure)
                for i in used:
                    if unsure[i]:
                        verdict[i] = weight > 0
    kept = []
    for k, used, joined in [] if only_lines else found:
        if used:
            keep = sum((1 + len(texts[i])) * (1 if verdict[i] else -1) for i in used) > 0
        else:
            keep = section_score(joined, host, lookup) > 0
        if keep:
            kept.append(k)
    return Page(numbers, lines, verdict, unsure, kept)


# ---------------------------------------------------------------- counts over all pages


def _key(kind: str, host: str, text: str) -> int:
    """Signed 64-bit key of a text; templates ('t') have the same key on all hosts."""
    made = xxhash.xxh3_64_intdigest(f"{kind}{text}" if kind == "t" else f"{kind}{host}\0{text}")
    return made - (1 << 64) if made >= 1 << 63 else made


def _host_id(host) -> Column:
    return F.xxhash64(F.coalesce(host, F.lit("")))


_COUNTS = "host_id long, key long, template boolean, pages long, menus long, seen long, opens long"


def _count_batches(frames):
    """Counts of the lines of pages, aggregated per batch: see :func:`line_statistics`."""
    for frame in frames:
        templates: dict[tuple[int, str], dict[str, list[int]]] = {}
        exact: dict[tuple[int, str], dict[str, int]] = {}
        for host_id, host, text in zip(*(frame[c].tolist() for c in ("host_id", "host", "visible_text")), strict=True):
            site = host_id, host or ""
            of_template, of_line = templates.setdefault(site, {}), exact.setdefault(site, {})
            _, lines = page_lines(text, site[1])
            menu = top_menu(lines)
            met: set = set()
            for i, x in enumerate(lines):
                c = of_template.get(x.masked)
                if c is None:
                    c = of_template[x.masked] = [0, 0, 0, 0]
                if x.masked not in met:
                    met.add(x.masked)
                    c[0] += 1
                if not x.sentence:
                    c[1] += i < menu
                    if not x.linked:
                        c[2] += 1
                        if i + 2 < len(lines):
                            y, z = lines[i + 1], lines[i + 2]
                            c[3] += _item(y) and _item(z) and not y.label and not z.label
                if x.exact and (x.text, x.masked) not in met:
                    met.add((x.text, x.masked))
                    of_line[x.text] = of_line.get(x.text, 0) + 1
        rows = [(h, _key("t", n, m), True, *c) for (h, n), made in templates.items() for m, c in made.items()]
        rows += [(h, _key("x", n, x), False, c, 0, 0, 0) for (h, n), made in exact.items() for x, c in made.items()]
        yield pd.DataFrame(rows, columns=["host_id", "key", "template", "pages", "menus", "seen", "opens"])


def line_statistics(pages: DataFrame) -> DataFrame:
    """Rows (host_id, key, share, most, menu, opener) of the lines that sites repeat.

    ``key`` is of a line as it is, or of its template (figures and site names masked). Two pages
    may agree by chance, so shares start at the third. Lines that no site repeats have no row.
    """
    # Read twice, by host and by template; to count the lines again would cost more.
    counts = cut_lineage(
        pages.select(_host_id(F.col("host")).alias("host_id"), "host", "visible_text")
        .mapInPandas(_count_batches, _COUNTS)
        .groupBy("host_id", "key")
        .agg(
            F.first("template").alias("template"),
            *[F.sum(c).alias(c) for c in ("pages", "menus", "seen", "opens")],
        )
    )
    totals = pages.groupBy(_host_id(F.col("host")).alias("host_id")).agg(F.count(F.lit(1)).alias("total"))
    share = F.greatest(F.col("pages") - 2, F.lit(0)) / (F.col("total") + 2)
    shares = counts.join(totals, "host_id").withColumn("share", share)
    templates = (
        shares.filter("template")
        .groupBy("key")
        .agg(F.max("share").alias("most"), F.sum("seen").alias("seen_"), F.sum("opens").alias("opens_"))
        .filter(F.col("most") >= OPENER_SHARE)
        .select("key", "most", ((F.col("opens_") / (F.col("seen_") + 0.5)) >= OPENS).alias("opener"))
    )
    return (
        shares.join(templates, "key", "left")
        .filter((F.col("share") >= 0.02) | F.col("most").isNotNull())
        .select(
            "host_id",
            "key",
            F.col("share").cast("float").alias("share"),
            F.coalesce("most", F.lit(0.0)).cast("float").alias("most"),
            ((F.col("menus") >= MENU * F.col("seen")) & (F.col("menus") > 0) & (F.col("share") > 0.03)).alias("menu"),
            F.coalesce("opener", F.lit(False)).alias("opener"),
        )
    )


class _Lookup:
    """Finds what is known of a host's lines in sorted arrays of keys."""

    def __init__(self, host_id: int) -> None:
        self.host_id = host_id
        self.table: dict[int, Known] = {}
        self.found: dict[tuple[str, str], Known] = {}

    def add(self, entries) -> None:
        for e in entries:
            self.table[e["key"]] = Known(e["share"], e["most"], e["menu"], e["opener"])

    def of(self, host: str):
        table, found = self.table, self.found

        def lookup(x: Line) -> Known:
            known = found.get((x.masked, x.text))
            if known is None:
                known = table.get(_key("t", "", x.masked), _NOTHING)
                if x.exact:
                    exact = table.get(_key("x", host, x.text), _NOTHING)
                    known = known._replace(share=exact.share)
                if len(x.text) <= 160:
                    if len(found) >= 50_000:
                        found.clear()
                    found[x.masked, x.text] = known
            return known

        return lookup


def over_sites(pages: DataFrame, decide, schema: str) -> DataFrame:
    """Rows that ``decide(page, lookup)`` gives for every page, as a DataFrame of ``schema``.

    ``page`` has page_id, host, host_id, title, visible_text and sections; ``lookup`` gives what
    is known of a line (see :func:`line_scores`). Pages without an id are left out, repeated pages
    come repeatedly.

    One shuffle brings pages to the lines that their site repeats (at most the lines of a page
    divided by the smallest share, for a host, and those that other sites repeat). Pages of hosts
    with more than PAGES are split by a hash of the id, with the host's lines for each part.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(frames):
        known: _Lookup | None = None
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                if known is None or known.host_id != row.host_id:
                    known = _Lookup(row.host_id)
                if row.lines is not None:
                    known.add(row.lines)
                else:
                    out += decide(row, known.of(row.host or ""))
            yield pd.DataFrame(out, columns=names)

    pages = pages.filter(F.col("page_id").isNotNull()).select(
        _host_id(F.col("host")).alias("host_id"),
        "page_id",
        "host",
        "title",
        "visible_text",
        F.col("selected_sections.text").alias("sections"),
    )
    parts = hot_parts(pages, "host_id", PAGES)
    lines = (
        line_statistics(pages)
        .groupBy("host_id", F.pmod("key", F.lit(16)).alias("some"))
        .agg(F.collect_list(F.struct("key", "share", "most", "menu", "opener")).alias("lines"))
    )
    lines = with_parts(lines, F.col("host_id"), parts).select("host_id", each_part().alias("part"), "lines")
    placed = with_parts(pages, F.col("host_id"), parts).withColumn("part", part_of("page_id")).drop("parts_")
    return (
        placed.unionByName(lines, allowMissingColumns=True)
        .repartition("host_id", "part")
        .sortWithinPartitions("host_id", "part", F.col("lines").isNull())
        .mapInPandas(batches, schema)
    )


def _blocks_of(page, lookup) -> list[tuple]:
    sections = None if page.sections is None else list(page.sections)
    found = read_page(page.visible_text, sections, page.host or "", lookup)
    of_page = zip(found.numbers, found.lines, found.content, strict=True)
    out = [(page.page_id, page.host, "visible_text", n, x.text) for n, x, keep in of_page if keep]
    return out + [(page.page_id, page.host, "selected_sections", k, sections[k]) for k in found.sections]


def main_blocks(pages: DataFrame) -> DataFrame:
    """Rows (page_id, host, block_field, block_no, text) of the content blocks of all pages.

    Null and blank fields have no blocks, a null host is a host of its own, repeated pages come
    out repeated, pages without an id are left out. Blank lines count for block_no but are never
    blocks.
    """
    return over_sites(
        pages.withColumn("title", F.lit(None).cast("string")),
        _blocks_of,
        "page_id long, host string, block_field string, block_no int, text string",
    )
