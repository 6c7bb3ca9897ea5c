"""Evaluation texts leaking into training text.

One Aho-Corasick automaton over the normalised questions, answers and passages of the test items
(passages as windows of two words) scans each text once. Its hits, mapped back to word places, are
chained per item: a document carries an item if pieces of its passage, in order, hold at least
half of the passage's words.

A text is normalised once and scanned by the automata of all blocks of items in the same task, so
there is one pass over the documents however many items there are. The items go to the executors
as files of the shared folder, not through the driver.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import sent_files

#: Words of a window of a passage.
SEED = 2
#: Share of a passage's words that a document must hold.
SHARE = 0.5
#: Shortest piece, in words, that counts towards the share: less are loose words.
PIECE = 4
#: Most words that may differ between two parts of one piece at the same place.
REPLACED = 1
#: Least windows of a piece for each of its words: every third word may be a replaced one.
WINDOWS = 1 / (SEED + REPLACED)
#: Items of which a window must be for it to be left out of the first count, and part of the least
#: number of windows that must be left.
COMMON, LEFT = 50, 0.6
#: Items per automaton, and characters of their texts.
BLOCK, BLOCK_CHARACTERS = 2_000, 20_000_000
#: Characters of texts that are held normalised while the blocks' automata pass over them.
HELD_CHARACTERS = 32_000_000

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = frozenset("\xad\u200b\u200c\u200d\u2060\ufeff")
_UNSEEN = re.compile(f"[{''.join(sorted(_INVISIBLE))}]")


@lru_cache(maxsize=50_000)
def _folded(word: str) -> str:
    return unicodedata.normalize("NFKC", word).casefold()


def words_with_offsets(text: str) -> tuple[list[str], list[int]]:
    """Normalised words of a text and where each begins in it.

    Letter case, punctuation, markup, white space and invisible characters don't matter.
    """
    plain = _TAG.sub(lambda m: " " * len(m.group()), text)
    words, places = [], []
    if not plain.isascii() and _UNSEEN.search(plain):
        kept = [(c, i) for i, c in enumerate(plain) if c not in _INVISIBLE]
        plain, at = "".join(c for c, _ in kept), [i for _, i in kept]
    else:
        at = None
    if "&" in plain:
        plain = re.sub(r"&#?\w{1,10};", lambda m: (html.unescape(m.group()) + " " * 12)[: len(m.group())], plain)
    for m in _WORD.finditer(plain):
        word = m.group()
        word = word.lower() if word.isascii() else _folded(word)
        words.append(word)
        places.append(at[m.start()] if at else m.start())
    return words, places


def plain_words(text: str) -> list[str]:
    """The words of :func:`words_with_offsets` without their places, faster for plain text."""
    if "<" in text or "&" in text:
        return words_with_offsets(text)[0]
    if text.isascii():
        return _WORD.findall(text.lower())
    if _UNSEEN.search(text):
        return words_with_offsets(text)[0]
    return [w.lower() if w.isascii() else _folded(w) for w in _WORD.findall(text)]


class Item(NamedTuple):
    """A test item as normalised words."""

    item_id: int
    passage: tuple[str, ...]
    question: tuple[str, ...]
    answer: tuple[str, ...]


class Scanner:
    """The automaton of a block of items, and what its patterns stand for.

    ``own`` has the places of an item's windows; ``counted`` only what the first count needs. A document that carries an item has at least WINDOWS * SHARE * length of its
    windows; windows of many items may be left out of the count if the least number of an item
    is lowered by as many.
    """

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        self.own: list[dict[str, list[int]]] = [defaultdict(list) for _ in items]
        self.told: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for number, item in enumerate(items):
            words = item.passage
            width = min(SEED, len(words))
            for j in range(len(words) - width + 1 if width else 0):
                self.own[number][" ".join(words[j : j + width])].append(j)
            for kind, told in (("q", item.question), ("a", item.answer)):
                if told:
                    self.told[" ".join(told)].append((number, kind))
        users = Counter(pattern for own in self.own for pattern in own)
        self.least: list[float] = [0.0] * len(items)
        self.counted: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, own in enumerate(self.own):
            least = WINDOWS * SHARE * len(items[number].passage)
            floor = LEFT * least
            for pattern in sorted(own, key=lambda p: (-users[p], p)):
                times = len(own[pattern])
                if users[pattern] > COMMON and least - times >= floor:
                    least -= times
                else:
                    self.counted[pattern].append((number, times))
            self.least[number] = least
        self.automaton = ahocorasick.Automaton()
        for pattern in {*users, *self.told}:
            self.automaton.add_word(f" {pattern} ", pattern)
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, text: str, line: str) -> list[tuple]:
        """Items in a text: (item_id, share, pieces, start, last word, question, answer).

        ``line`` has the text's normalised words. Start and the last word's place are offsets in
        the text, null where the passage isn't in it; the share is that of the passage's words.
        """
        if not len(self.automaton):
            return []
        met = {pattern for _, pattern in self.automaton.iter(line)}
        told: dict[int, set[str]] = defaultdict(set)
        seen: dict[int, int] = defaultdict(int)
        for pattern in met:
            for number, times in self.counted.get(pattern, ()):
                seen[number] += times
            for number, kind in self.told.get(pattern, ()):
                told[number].add(kind)
        likely = {n for n, times in seen.items() if times >= self.least[n]}
        held = self._held(line, likely) if likely else {}
        if not held and not told:
            return []
        offsets = words_with_offsets(text)[1] if held else []
        out = []
        for number in sorted({*held, *told}):
            share, pieces = held.get(number, (0.0, []))
            first = offsets[min(i for i, _, _ in pieces)] if pieces else None
            last = offsets[max(i + n - 1 for i, _, n in pieces)] if pieces else None
            item = self.items[number].item_id
            out.append((item, share, len(pieces), first, last, "q" in told.get(number, ()), "a" in told.get(number, ())))
        return out

    def _held(self, line: str, likely: set[int]) -> dict[int, tuple[float, list[tuple[int, int, int]]]]:
        """Share and pieces of the items of ``likely`` that the line carries."""
        hits: list[tuple[int, str]] = []
        last_end = index = 0
        for end, pattern in self.automaton.iter(line):
            # Hits come in the order of their ends, so words are counted once along the line.
            index += line.count(" ", last_end, end)
            last_end = end
            hits.append((index, pattern))
        cells: dict[int, set[tuple[int, int]]] = {}
        for number in likely:
            own = self.own[number]
            width = min(SEED, len(self.items[number].passage))
            at = cells[number] = set()
            for index, pattern in hits:
                for j in own.get(pattern, ()):
                    for k in range(width):
                        at.add((index - width + k, j + k))
        found = {}
        for number, at in cells.items():
            length = len(self.items[number].passage)
            pieces = [p for p in _pieces(at) if p[2] >= min(PIECE, length)]
            if sum(p[2] for p in pieces) < SHARE * length:
                continue
            words = _chain(pieces, length)
            if words >= SHARE * length:
                found[number] = (words / length, pieces)
        return found


def _pieces(cells: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs (text word, passage word, length) along diagonals, over single replaced words."""
    diagonals: dict[int, list[int]] = defaultdict(list)
    for i, j in cells:
        diagonals[i - j].append(j)
    pieces = []
    for d, js in diagonals.items():
        js.sort()
        first = last = js[0]
        for j in js[1:]:
            if j - last > REPLACED + 1:
                pieces.append((first + d, first, last - first + 1))
                first = j
            last = j
        pieces.append((first + d, first, last - first + 1))
    return pieces


def _chain(pieces: list[tuple[int, int, int]], length: int) -> int:
    """Most passage words in pieces that follow one another in the text and in the passage."""
    best = [0] * (length + 1)  # best[j]: most words in pieces that end at or before word j
    waiting: list[tuple[int, int, int]] = []
    top = 0
    for i, j, n in sorted(pieces):
        still = []
        for end_i, end_j, score in waiting:
            if end_i > i:
                still.append((end_i, end_j, score))
                continue
            for k in range(end_j, length + 1):
                if best[k] >= score:
                    break
                best[k] = score
        waiting = still
        score = best[j] + n
        waiting.append((i + n, min(j + n, length), score))
        top = max(top, score)
    return top


def item_of(item_id: int, passage: str | None, question: str | None, answer: str | None) -> Item:
    return Item(item_id, *(tuple(plain_words(t or "")) for t in (passage, question, answer)))


@lru_cache(maxsize=2)
def _scanner(file: str) -> Scanner:
    """The scanner of a block's file; a worker holds two at most."""
    rows = pq.read_table(file, columns=["item_id", "passage", "question", "answer"]).to_pylist()
    rows.sort(key=lambda r: (r["item_id"], *(r[c] or "" for c in ("passage", "question", "answer"))))
    return Scanner([item_of(**r) for r in rows])


_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("share", T.DoubleType()),
        T.StructField("pieces", T.IntegerType()),
        T.StructField("start_offset", T.LongType()),
        T.StructField("last_word_offset", T.LongType()),
        T.StructField("question_found", T.BooleanType()),
        T.StructField("answer_found", T.BooleanType()),
    ]
)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_SCHEMA.fieldNames())
    for offset in ("start_offset", "last_word_offset"):
        frame[offset] = frame[offset].astype("Int64")
    return frame


def _texts(frames):
    """(doc_id, text, line) of all rows in groups of HELD_CHARACTERS."""
    held: list[tuple[int, str, str]] = []
    characters = 0
    for frame in frames:
        for doc, text in zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
            held.append((doc, text, f" {' '.join(plain_words(text))} "))
            characters += len(text)
            if characters >= HELD_CHARACTERS:
                yield held
                held, characters = [], 0
    if held:
        yield held


def item_hits(spark: SparkSession, documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Distinct rows (doc_id, item_id, share, pieces, start_offset, last_word_offset, question_found, answer_found).

    One row for each document and item of which the document holds half of the passage (share is
    0 otherwise), the whole question or the whole answer. Null and blank texts hold nothing,
    documents and items without an id are left out, a null or empty text of an item is in no
    document, items that share a text are all reported.
    """
    texts = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    items = eval_items.select("item_id", "passage", "question", "answer").filter(F.col("item_id").isNotNull())
    length = sum((F.coalesce(F.length(c), F.lit(0)) for c in ("passage", "question", "answer")), F.lit(0))
    n, characters = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    blocks = max(-(-n // BLOCK), -(-characters // BLOCK_CHARACTERS), 1)
    names = sent_files(items.repartition(blocks, F.pmod(F.xxhash64("item_id"), F.lit(blocks))))

    def batches(frames):
        for group in _texts(frames):
            for name in names:
                scanner = _scanner(SparkFiles.get(name))
                out = [(doc, *hit) for doc, text, line in group for hit in scanner.scan(text, line)]
                if out:
                    yield _frame(out)

    return texts.mapInPandas(batches, _SCHEMA).distinct()


def leaked_items(spark: SparkSession, documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """The rows of :func:`item_hits` of documents that hold half of an item's passage."""
    return item_hits(spark, documents, eval_items).filter(F.col("share") >= SHARE)
