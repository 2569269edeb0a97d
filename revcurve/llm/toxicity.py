"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs to Latin letters and undoes digit and sign substitutions,
so ``1D10T`` and ``idiοt`` read ``idiot``. The lexicon holds whole words and word beginnings
with their weights (smoothed log odds of toxic against other labelled documents), and exception
phrases: two-word phrases around a lexicon word that occur in harmless documents cancel that match.
A document's matched weight is normalised by its length and mapped to a probability.

:func:`learn` counts in Spark over a bounded sample of labelled documents (``per_class`` of
each label value) and returns a lexicon of at most ``max_terms`` terms and as many exception
phrases; :func:`score` is one pass over all whole texts without a shuffle. A lexicon can also be
written by hand (:class:`Lexicon`).

Defined results: null text reads as empty text; a text without words scores the same as one
without a match (the curve at weight 0). Repeated rows score equal. No labelled rows of one
class: empty lexicon, and every score is 0.0. Other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcurve.llm.common import drop_stored, labelled_sample, store, text_of

# Letters of other scripts that look like Latin ones, and signs used for letters.
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁɡһԛԝαβεικνορτυχℓ", "abekmhopctyxijsdghqwabeikvoptuxl", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}

_MARKS = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_GLYPHS = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | _MARKS
_SIGN_MAP = {ord(k): v for k, v in SIGNS.items()}
_FOREIGN = re.compile("[" + "".join(HOMOGLYPHS) + "ａ-ｚ­​-‍⁠﻿]")
_SUBSTITUTED = re.compile(r"[^\W\d_]*[0134578@$!|]+[^\W\d_][\w@$!|]*")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower-case text with homoglyphs and in-word digit / sign substitutions undone.

    A sign is read as a letter only inside a token that also holds a letter after it, so
    numbers and final exclamation marks stay.
    """
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = text.translate(_GLYPHS)
    return _SUBSTITUTED.sub(lambda m: m[0].translate(_SIGN_MAP), text)


@dataclass
class Lexicon:
    """Terms with weights, exception phrases, and the curve from matched weight to score.

    ``terms``: folded word -> weight; a term that ends in ``*`` is a word beginning.
    ``exceptions``: folded two-word phrases (one space) that cancel a match inside them.
    ``curve``: (bias, factor of log1p(weight), factor of log1p(weight per 100 words)).
    """

    terms: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] = (-4.0, 2.0, 2.0)

    def automaton(self) -> ahocorasick.Automaton:
        """Matches ``\\n`` + beginning and ``\\n`` + word + ``\\n`` in text whose words are framed by ``\\n``."""
        a = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            a.add_word("\n" + term[:-1] if term.endswith("*") else f"\n{term}\n", (len(term), weight, term.endswith("*")))
        if self.terms:
            a.make_automaton()
        return a

    def matched(self, text: str, automaton: ahocorasick.Automaton) -> tuple[float, int]:
        """(weight of the matches that no exception cancels, number of words).

        Of several terms on one word the largest weight counts, once.
        """
        words = _WORD.findall(fold(text))
        if not words or not self.terms:
            return 0.0, len(words)
        framed = "\n" + "\n".join(words) + "\n"
        best: dict[int, float] = {}
        for end, (length, weight, beginning) in automaton.iter(framed):
            start = end - length + 2 if beginning else end - length  # of the word in the framed text
            best[start] = max(weight, best.get(start, weight))
        total = 0.0
        for start, weight in best.items():
            if not (self.exceptions and self._excepted(framed, start)):
                total += weight
        return total, len(words)

    def _excepted(self, framed: str, start: int) -> bool:
        stop = framed.index("\n", start)
        before = framed.rfind("\n", 0, start - 1)
        after = framed.find("\n", stop + 1)
        word = framed[start:stop]
        return (before >= 0 and f"{framed[before + 1 : start - 1]} {word}" in self.exceptions) or (
            after > 0 and f"{word} {framed[stop + 1 : after]}" in self.exceptions
        )

    def probability(self, weight: float, words: int) -> float:
        """Score of a document from its matched weight and its length in words."""
        if not self.terms:
            return 0.0
        b, k, d = self.curve
        x = b + k * math.log1p(weight) + d * math.log1p(100 * weight / max(words, 1))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _features(texts: pa.Array, shortest: int, longest: int) -> pa.Array:
    """Distinct terms of each text: its words, and their beginnings of ``shortest`` to ``longest`` letters."""
    out = []
    for t in texts.to_pylist():
        words = set(_WORD.findall(fold(t)))
        out.append(sorted(words | {f"{w[:n]}*" for w in words for n in range(shortest, min(longest, len(w)) + 1)}))
    return pa.array(out, pa.list_(pa.string()))


def learn(
    docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "toxic", text_col: str = "text",
    id_col: str = "doc_id", per_class: int = 4000, max_terms: int = 5000, min_docs: int = 3,
    min_share: float = 0.01, min_odds: float = 30.0,
) -> Lexicon:
    """Learn a weighted lexicon from at most ``2 * per_class`` labelled documents.

    A term enters when at least ``min_docs`` and a share ``min_share`` of the toxic documents hold
    it and that share is ``min_odds`` times the one among the others; a longer term is left out
    when a beginning of it already explains all its toxic documents. Equal texts count once.
    """
    sample = labelled_sample(labels, label, train_rows, per_class, id_col)
    texts = store(
        docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
        .join(F.broadcast(sample), "id").groupBy("text").agg(F.max("y").alias("y"), F.min("id").alias("id")),
        "toxicity-sample",
    )
    try:
        return _learn(texts, max_terms, min_docs, min_share, min_odds)
    finally:
        drop_stored(texts)


def _learn(texts: DataFrame, max_terms: int, min_docs: int, min_share: float, min_odds: float) -> Lexicon:
    by_class = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic_docs, other_docs = by_class.get(1, 0), by_class.get(0, 0)
    if not toxic_docs or not other_docs:
        return Lexicon({})
    features = F.arrow_udf(lambda texts: _features(texts, 4, 8), "array<string>")
    counted = (
        texts.select("y", F.explode(features("text")).alias("term")).groupBy("term")
        .agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    )
    odds = ((F.col("bad") + 0.5) / (toxic_docs + 1.0)) / ((F.col("good") + 0.5) / (other_docs + 1.0))
    rows = (
        counted.withColumn("odds", odds).where((F.col("bad") >= max(min_docs, min_share * toxic_docs)) & (F.col("odds") >= min_odds))
        .orderBy(F.col("bad").desc(), F.length("term"), "term").limit(4 * max_terms).collect()
    )
    terms: dict[str, float] = {}
    support: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (len(r["term"]), r["term"])):
        stem = r["term"].rstrip("*")
        shorter = [f"{stem[:n]}*" for n in range(4, len(stem) + 1) if f"{stem[:n]}*" in terms]
        # a word beginning already listed that is as specific explains this longer term
        if any(terms[s] >= math.log(r["odds"]) or support[s] >= r["bad"] and terms[s] >= math.log(r["odds"]) - 0.7 for s in shorter):
            continue
        if len(terms) < max_terms:
            terms[r["term"]], support[r["term"]] = math.log(r["odds"]), r["bad"]
    lexicon = Lexicon(terms)
    lexicon.exceptions = _learn_exceptions(texts, lexicon, min_docs, max_terms)
    lexicon.curve = _fit_curve(texts, lexicon)
    return lexicon


def _learn_exceptions(texts: DataFrame, lexicon: Lexicon, min_docs: int, limit: int) -> set[str]:
    """Phrases of a lexicon word and a neighbour that harmless documents hold, toxic ones rarely."""
    if not lexicon.terms:
        return set()
    automaton = lexicon.automaton()

    def phrases(batch: pa.Array) -> pa.Array:
        out = []
        for t in batch.to_pylist():
            words, found = _WORD.findall(fold(t)), set()
            framed = "\n" + "\n".join(words) + "\n"
            for end, (length, _, beginning) in automaton.iter(framed):
                start = end - length + 2 if beginning else end - length
                i = framed.count("\n", 0, start) - 1
                found.update(" ".join(words[a : a + 2]) for a in (i - 1, i) if 0 <= a < len(words) - 1)
            out.append(sorted(found))
        return pa.array(out, pa.list_(pa.string()))

    rows = (
        texts.select("y", F.explode(F.arrow_udf(phrases, "array<string>")("text")).alias("phrase")).groupBy("phrase")
        .agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
        .where((F.col("good") >= min_docs) & (F.col("good") > 4 * F.col("bad")))
        .orderBy(F.col("good").desc(), "phrase").limit(limit).collect()
    )
    return {r["phrase"] for r in rows}


def _fit_curve(texts: DataFrame, lexicon: Lexicon, steps: int = 400) -> tuple[float, float, float]:
    """Logistic curve over (log weight, log weight per 100 words) of the sample, classes of equal weight."""
    automaton = lexicon.automaton()

    def measure(batch: pa.Array) -> pa.Array:
        got = [lexicon.matched(t, automaton) for t in batch.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], ["weight", "words"])

    rows = texts.select("id", "y", F.arrow_udf(measure, "struct<weight: double, words: bigint>")("text").alias("m")).orderBy("id").collect()
    y = np.array([r["y"] for r in rows], float)
    w = np.array([r["m"]["weight"] for r in rows])
    n = np.maximum(1, np.array([r["m"]["words"] for r in rows]))
    x = np.column_stack([np.ones(len(y)), np.log1p(w), np.log1p(100 * w / n)])
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    c = np.array([-3.0, 1.0, 1.0])
    for _ in range(steps):  # Newton steps with a small ridge, slopes kept non-negative
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (share * (p - y)) + 1e-3 * (c - [-3.0, 1.0, 1.0])
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        c = np.concatenate([[c[0] - step[0]], np.maximum(0, c[1:] - step[1:])])
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0]), float(c[1]), float(c[2])


def score(lexicon: Lexicon, text_col: str = "text") -> Column:
    """Column of the toxicity score (0 to 1) of the whole text."""

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = lexicon.automaton()
        for arr in batches:
            yield pa.array([lexicon.probability(*lexicon.matched(t, automaton)) for t in arr.to_pylist()], pa.float64())

    return toxicity(text_of(text_col))
