"""Keyword-stuffed and link-list pages.

Several weak labelling functions vote on every page, each by another feature of its content or its
links; they often disagree, and pages without a clear majority stay unlabelled. Bagged decision
trees are fitted on a bounded sample of the labelled pages and predict all pages; the predictions
are then smoothed with the rate of predicted spam of the page's host, by a weight that is fitted
too. All features are of form (links, tags, codes, repetition, running text, ends of sentences,
separators), none is of words, so no language is spam for being unknown.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

#: Weakly labelled rows that the trees and the weight of hosts are fitted on, at most.
FIT_ROWS = 20_000
#: Trees, their depth, and the smallest leaf.
TREES, DEPTH, LEAF = 25, 7, 2
#: Share of the features that a split may choose from, drawn for each split.
DRAWN = 0.5
#: Votes from which a page is labelled as spam, and up to which as none.
SPAM_VOTES, FINE_VOTES = 1, -2
#: Weight of the host's log odds against the page's own before the sample is seen, how many
#: labelled rows that is worth, and bounds of both probabilities.
HOST_WEIGHT, HOST_ROWS, CLIP = 0.5, 50, 0.02
#: Words of a window in which repetition is measured.
WINDOW = 30

FEATURES = (
    "link_share",  # characters in links and their texts
    "tag_share",  # in hash tags
    "code_share",  # in codes of letters and figures
    "running_share",  # in parts that run like sentences
    "distinct_share",  # of the words of a window
    "fresh_share",  # the same, each part taken once
    "log_words",
    "log_size",  # characters
    "letter_share",
    "separators",  # commas and the like for each word
    "digit_share",
    "top_share",  # of the commonest word
    "repeats",  # words for each different word, each part taken once
    "ended_share",  # of parts that end with a full stop or the like
)

_LINK = re.compile(r"<a\b[^<>]*>[^<>]*</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+")
_MARKUP = re.compile(r"</?(?!a\b)[A-Za-z!][^<>]*>")
_BREAK = re.compile(r"([.!?]+(?=\s|$)|[。！？]+)|\n")
_SHORT_LINE = re.compile(r"(?:^|(?<=\n))([^\n]*)\n(?=[^\n])")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_TAG = re.compile(r"#\w+")
_CODE = re.compile(r"[a-z]{2,}\d{3,}|\d+[a-z]{2}")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
_UNSEEN = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f\xad\u200b-\u200f\u2060\ufeff\ufffd]+")
_REPEATED = re.compile(r"(\w{1,4}?)\1{15,}")
_NOT_DIGIT = re.compile(r"\D+")


def _solid(text: str) -> int:
    """Characters of a text but for white space."""
    return sum(map(len, text.split()))


def page_features(text: str | None) -> list[float]:
    """Features of a page in the order of FEATURES; a blank page has none of anything."""
    text = text or ""
    if "&" in text:
        text = html.unescape(text)
    text = _UNSEEN.sub(" ", text)
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if max(map(len, text.split()), default=0) > 60:
        text = _REPEATED.sub(" ", text)  # repeated characters are no words
    text = text.strip()
    total = _solid(text)
    if not total:
        return [0.0] * len(FEATURES)
    linked = "](" in text or "://" in text or "www." in text or "<a" in text
    links = sum(_solid(m) for m in _LINK.findall(text)) if linked else 0
    rest = _LINK.sub(" \x00 ", text) if links else text
    tags = sum(map(len, _TAG.findall(rest))) if "#" in rest else 0
    # Lines of one or two words are no list by themselves: a sentence may be broken at every word.
    joined = _SHORT_LINE.sub(lambda m: m.group(1) + (" " if m.group(1).count(" ") < 2 else "\n"), rest) if "\n" in rest else rest
    running = parts = ended = separators = 0
    words: list[str] = []
    fresh: list[str] = []
    met: set[str] = set()
    pieces = _BREAK.split(joined.lower())
    for k in range(0, len(pieces), 2):
        part = pieces[k]
        found = _WORD.findall(part)
        if not found:
            continue
        words += found
        bare = part.strip()
        if bare not in met:
            # A sentence that stands there twice is no stuffing: what it repeats counts once.
            met.add(bare)
            fresh += found
        parts += 1
        ended += k + 1 < len(pieces) and pieces[k + 1] is not None
        between = part.count(",") + part.count(";") + part.count(" | ") + part.count(" / ") + part.count("、")
        separators += between
        if "\x00" in part or part.count("#") > 1:
            continue
        if not part.isascii() and _UNSPACED.search(part):
            running += _solid(part) if len(part) >= 8 else 0
        elif len(found) >= 5 and len(set(found)) >= 0.6 * len(found) and between <= 0.25 * len(found):
            running += _solid(part)
    n = len(words)
    counts = Counter(words)
    letters = digits = codes = 0
    for word, times in counts.items():
        if word.isalpha():
            letters += times * len(word)
        else:
            digits += times * len(_NOT_DIGIT.sub("", word))
            if _CODE.fullmatch(word):
                codes += times * len(word)

    def distinct(of: list[str]) -> float:
        windows = [of[i : i + WINDOW] for i in range(0, len(of), WINDOW)]
        return sum(len(set(w)) / len(w) for w in windows) / len(windows) if windows else 1.0

    return [
        links / total,
        tags / total,
        codes / total,
        running / total,
        distinct(words),
        distinct(fresh),
        math.log1p(n),
        math.log1p(total),
        letters / total,
        separators / n if n else 0.0,
        digits / total,
        max(counts.values()) / n if n else 0.0,
        len(fresh) / len(counts) if n else 1.0,
        ended / parts if parts else 0.0,
    ]


def votes(x: np.ndarray) -> np.ndarray:
    """Votes of the labelling functions on rows of features: one column each, above 0 for spam."""
    f = dict(zip(FEATURES, x.T, strict=True))
    n = np.expm1(f["log_words"])
    bare = (f["link_share"] >= 0.4) | (f["tag_share"] >= 0.4)

    def vote(spam, fine=None, weight: int = 1):
        return np.where(spam, weight, 0 if fine is None else np.where(fine, -1, 0))

    return np.stack(
        [
            vote(f["link_share"] >= 0.4, weight=4),
            vote(f["tag_share"] >= 0.4, weight=3),
            vote(f["code_share"] >= 0.15, weight=5),
            vote((f["distinct_share"] < 0.6) & (f["running_share"] < 0.6) & (n >= 20), (f["distinct_share"] >= 0.75) & (n >= 20), weight=2),
            vote((f["running_share"] < 0.3) & (n >= 15), f["running_share"] >= 0.6),
            vote((f["fresh_share"] < 0.4) & (n >= 20), f["fresh_share"] >= 0.75),
            vote((f["ended_share"] < 0.2) & (n >= 25), f["ended_share"] >= 0.5),
            vote((f["separators"] >= 0.25) & (n >= 20), f["separators"] < 0.15),
            vote((f["repeats"] >= 4) & (n >= 40), f["repeats"] < 2),
            vote(np.zeros(len(x), dtype=bool), (n < 12) & ~bare),
            # Blank pages and pages of odd or repeated characters list nothing.
            np.where((f["letter_share"] < 0.3) & ~bare & (f["code_share"] < 0.15), -3, 0),
        ],
        axis=1,
    )


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 spam, 0 not, -1 unsure, for rows of features."""
    total = votes(x).sum(axis=1)
    return np.where(total >= SPAM_VOTES, 1, np.where(total <= FINE_VOTES, 0, -1))


class Tree(NamedTuple):
    """A decision tree as arrays; a node with feature -1 is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH + 1):
            inner = self.feature[node] >= 0
            if not inner.any():
                break
            f = np.maximum(self.feature[node], 0)
            below = x[np.arange(len(x)), f] <= self.threshold[node]
            node = np.where(inner, np.where(below, self.left[node], self.right[node]), node)
        return self.value[node]


def _split(x: np.ndarray, y: np.ndarray, drawn: np.ndarray) -> tuple[float, int, float] | None:
    """Best split by Gini impurity, in the middle of the widest gap among equals."""
    best = None
    n, ones = len(y), y.sum()
    for f in drawn:
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])[:-1]
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= LEAF) & (n - k >= LEAF)
        if not ok.any():
            continue
        left, right = s / k, (ones - s) / (n - k)
        impurity = (k * left * (1 - left) + (n - k) * right * (1 - right)) / n
        impurity = np.where(ok, impurity, np.inf)
        at = int(np.argmin(impurity))
        key = (round(float(impurity[at]), 9), -float(v[at + 1] - v[at]))
        if best is None or key < best[0]:
            best = (key, f, float(v[at] + v[at + 1]) / 2)
    return best and (best[0][0], best[1], best[2])


def fit_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Tree:
    draws = max(1, round(DRAWN * x.shape[1]))
    rows: list[list[float]] = []

    def grow(index: np.ndarray, depth: int) -> int:
        node = len(rows)
        share = float(y[index].mean())
        rows.append([-1, 0.0, 0, 0, share])
        if depth < DEPTH and 0 < share < 1 and len(index) >= 2 * LEAF:
            found = _split(x[index], y[index], rng.permutation(x.shape[1])[:draws])
            if found and found[0] < share * (1 - share) - 1e-9:
                _, f, at = found
                below = x[index, f] <= at
                rows[node][0:2] = [f, at]
                rows[node][2] = grow(index[below], depth + 1)
                rows[node][3] = grow(index[~below], depth + 1)
        return node

    grow(np.arange(len(y)), 0)
    a = np.array(rows)
    return Tree(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4])


class Model(NamedTuple):
    """Bagged trees and the weights of the page's and its host's log odds."""

    trees: list[Tree]
    page_weight: float = 1.0
    host_weight: float = 0.0


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, CLIP, 1 - CLIP)
    return np.log(p / (1 - p))


def host_weights(page: np.ndarray, host: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weights of the log odds of pages and of hosts: a logistic regression by Newton's steps.

    It starts from (1, HOST_WEIGHT) as if HOST_ROWS labelled rows had said so. A host never speaks
    against itself, so its weight is 0 at least.
    """
    x = np.stack([page, host], axis=1)
    start = np.array([1.0, HOST_WEIGHT])
    w = start.copy()
    held = np.eye(2) * HOST_ROWS
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + held @ (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + held, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 0.1), max(float(w[1]), 0.0)


def fit(x: np.ndarray, y: np.ndarray, hosts: list[str], seed: int = 7) -> Model:
    """Trees on bootstrap samples of the rows; weights from the rows that each tree hasn't seen."""
    rng = np.random.default_rng(seed)
    trees, total, seen = [], np.zeros(len(y)), np.zeros(len(y))
    for _ in range(TREES):
        drawn = rng.integers(0, len(y), len(y))
        trees.append(fit_tree(x[drawn], y[drawn], rng))
        out = np.ones(len(y), dtype=bool)
        out[drawn] = False
        total[out] += trees[-1].predict(x[out])
        seen[out] += 1
    page = np.where(seen > 0, total / np.maximum(seen, 1), y.mean())
    _, of = np.unique(np.array(hosts, dtype=object).astype(str), return_inverse=True)
    rows, spam = np.bincount(of), np.bincount(of, weights=page)
    others = (spam[of] - page + y.mean()) / rows[of]  # the other rows of the host, and one of average
    relative = log_odds(others) - log_odds(np.array([y.mean()]))
    return Model(trees, *host_weights(log_odds(page), relative, y))


def predict(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Mean vote of the trees."""
    return np.mean([t.predict(x) for t in trees], axis=0)


def spam_scores(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, source, page_score, host_rate, score), one per row of ``documents``.

    A null or blank text is labelled as no spam. A null host is a host of its own. Where the
    labels are all of one class there is nothing to learn: the label is the page's score, and 0.5
    that of a page without one. Rates are pre-aggregated before the shuffle where hosts are
    skewed, and the join back is left to the adaptive skew join.
    """
    size = len(FEATURES)
    columns = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])

    def batch(texts: pd.Series) -> pd.DataFrame:
        made = [page_features(t) for t in texts]
        labels = weak_labels(np.array(made).reshape(len(made), size)) if made else np.array([], dtype=int)
        return pd.DataFrame({"x": pd.Series(made, dtype=object), "label": labels.astype("int32")}, index=texts.index)

    features = F.pandas_udf(batch, columns)
    pages = cut_lineage(
        documents.select("doc_id", "source", features("text").alias("f")).select("doc_id", "source", "f.x", "f.label")
    )
    # Half of the sample for each class at most, by a hash of the id: the same rows at every run.
    parts = [
        pages.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(FIT_ROWS // 2).collect()
        for k in (0, 1)
    ]
    model = None
    if all(parts):
        sample = [r for p in parts for r in p]
        model = fit(
            np.array([r["x"] for r in sample]), np.array([float(r["label"]) for r in sample]), [r["source"] or "" for r in sample]
        )

    def score_batch(xs: pd.Series, labels: pd.Series) -> pd.Series:
        if model is None or not len(xs):
            return labels.map({0: 0.0, 1: 1.0, -1: 0.5}).astype("float64")
        return pd.Series(predict(model.trees, np.stack(xs.to_list()).reshape(len(xs), size)), index=xs.index)

    score = F.pandas_udf(score_batch, T.DoubleType())
    # The scores are read for the rates and for the pages, so they are stored.
    scored = cut_lineage(
        pages.select("doc_id", "source", F.coalesce("source", F.lit("")).alias("host_"), score("x", "label").alias("page_score"))
    )
    bounded = lambda p: F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    odds = lambda p: F.ln(bounded(p) / (1 - bounded(p)))
    average = scored.agg(F.avg("page_score")).first()[0]
    average = 0.5 if average is None else float(average)
    rates = scored.groupBy("host_").agg(
        # One page of average odds keeps the rate of a host with few pages near the average.
        ((F.sum("page_score") + average) / (F.count(F.lit(1)) + 1)).alias("host_rate")
    )
    w_page, w_host = (model.page_weight, model.host_weight) if model else (1.0, 0.0)
    blended = w_page * odds(F.col("page_score")) + w_host * (odds(F.col("host_rate")) - odds(F.lit(average)))
    return scored.join(rates, "host_", "left").select(
        "doc_id", "source", "page_score", "host_rate", (1 / (1 + F.exp(-blended))).alias("score")
    )


def spam_pages(documents: DataFrame) -> DataFrame:
    """Distinct (doc_id) of pages made of search words, bare links or product tags."""
    return spam_scores(documents).filter("score > 0.5 AND doc_id IS NOT NULL").select("doc_id").distinct()
