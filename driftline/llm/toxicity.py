"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, drops invisible characters, maps look-alike letters of other scripts to Latin ones and reads digits
and signs inside words as the letters they stand for. Entries are whole words, word beginnings (weight by smoothed log odds
of the training labels) and exception phrases, which cancel the matches they cover: pairs of words around a suspect word that
clean texts hold and toxic ones hardly do. Suspect words are then weighed by their other occurrences. The weighted hits of a
text, by themselves and normalised by its length, go through a logistic curve fitted on labelled rows that the lexicon has not
seen.

Defined results: null and empty texts score as a text without hits; without any labelled row the lexicon is empty and all
scores are 0; repeated rows score alike; all hits of a text of any length count; entries are chosen by their own counts, so that
ties need no order; an empty table gives an empty result; only doc_id, text and the label are read, other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, workdir, written
from .supervised import labelled, logistic, scored, sigmoid

MODULUS, REST, THRESHOLD = 4, 2, 0.3
#: Labelled rows to learn from, at most about, which bounds the lexicon too: an entry occurs in LEAST of them and is toxic in a
#: share of PURITY; a word that is toxic in a share of SUSPECT is looked at for exceptions.
SAMPLE, LEAST, PURITY, SUSPECT = 30_000, 5, 0.9, 0.2
PREFIXES = (5, 6)

# Letters of other scripts by the Latin letters they look like, and signs by the letters they stand for.
LOOKALIKES = {
    "a": "аαɑａ", "b": "ЬƄｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еҽｅ", "f": "ｆ", "g": "ɡｇ", "h": "һｈ", "i": "іıιｉ", "j": "јｊ", "k": "кκｋ", "l": "ӏⅼｌ", "m": "мｍ",
    "n": "пηｎ", "o": "оοσｏ", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ", "t": "тτｔ", "u": "υսｕ", "v": "νѵｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ｚ",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"

_FOLD = {ord(x): k for k, v in LOOKALIKES.items() for x in v} | {ord(x): None for x in INVISIBLE}
_SIGN = re.compile(r"[013457-9@$](?=[^\W\d_])|(?<=[^\W\d_])[013457-9](?![^\W_])")
_ODD = re.compile(r"[013457-9@$]")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if _ODD.search(text):
        for _ in range(2):  # a sign next to a sign becomes a letter's neighbour in the first round
            text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text


class Lexicon:
    """Entries (term, weight, open end) and exception phrases in one automaton."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float], exceptions: tuple[str, ...] = ()):
        self.words, self.prefixes, self.exceptions = words, prefixes, exceptions
        self._machine = None

    def __reduce__(self):
        return Lexicon, (self.words, self.prefixes, self.exceptions)

    def _automaton(self):
        if self._machine is None:
            entries: dict[str, tuple] = {}
            for group, is_open in ((self.prefixes, True), (self.words, False)):
                for term, weight in group.items():
                    for form in {term, term.replace("l", "i")}:  # 1 may stand for either letter
                        entries.setdefault(form, {})[is_open] = (term, weight)
            for phrase in self.exceptions:
                entries.setdefault(fold(phrase), {})[None] = (phrase, 0.0)
            machine = ahocorasick.Automaton()
            for form, kinds in entries.items():
                machine.add_word(form, (len(form), kinds))
            if entries:
                machine.make_automaton()
            self._machine = machine
        return self._machine

    def hits(self, text: str) -> list[tuple[str, float, int]]:
        """(term, weight, start) of the matches that count: longest per start, on word boundaries, not under an exception."""
        machine = self._automaton()
        if not len(machine) or not text:
            return []
        found: dict[int, tuple[int, str, float]] = {}
        covered: list[tuple[int, int]] = []
        n = len(text)
        for end, (size, kinds) in machine.iter(text):
            start = end - size + 1
            if start and text[start - 1].isalpha():
                continue
            closed = end + 1 == n or not text[end + 1].isalpha()
            if None in kinds and closed:
                covered.append((start, end))
            got = kinds.get(False) if closed and False in kinds else kinds.get(True)
            if got and (start not in found or found[start][0] < size):
                found[start] = (size, *got)
        # In the order of their starts: a match is covered if a phrase that starts no later reaches as far as it does.
        covered.sort()
        out, reach, k = [], -1, 0
        for start in sorted(found):
            while k < len(covered) and covered[k][0] <= start:
                reach = max(reach, covered[k][1])
                k += 1
            size, term, weight = found[start]
            if start + size - 1 > reach:
                out.append((term, weight, start))
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """For each text: weighted hits, hits per square root of the length in words, and distinct entries, all damped."""
        out = np.zeros((len(texts), 3))
        for i, raw in enumerate(texts):
            text = fold(raw)
            got = self.hits(text)
            if got:
                times = Counter(t for t, _, _ in got)
                weight = {t: w for t, w, _ in got}
                total = sum(weight[t] * k for t, k in times.items())
                out[i] = np.log1p(total), np.log1p(10 * total / np.sqrt(1 + len(text) / 6)), np.log1p(len(times))
        return out


def _phrases(folded: str) -> tuple[list[str], list[str | None]]:
    """The words of a folded text, and for each the phrase it makes with the one before it, if a single space parts them."""
    words, pairs, end = [], [], -1
    for m in _WORD.finditer(folded):
        pairs.append(f"{words[-1]} {m[0]}" if words and m.start() == end + 1 and folded[end] == " " else None)
        words.append(m[0])
        end = m.end()
    return words, pairs


def _terms(exceptions: frozenset[str], text: str) -> set[str]:
    """The words outside exception phrases, and their beginnings (^)."""
    words, pairs = _phrases(fold(text))
    if exceptions:
        out = {i for i, p in enumerate(pairs) if p in exceptions}
        words = [w for i, w in enumerate(words) if i not in out and i + 1 not in out]
    words = set(words)
    return words | {f"^{w[:k]}" for w in words for k in PREFIXES if len(w) >= k}


def _around(suspects: frozenset[str], text: str) -> set[str]:
    """The phrases of two words that hold a suspect one."""
    _, pairs = _phrases(fold(text))
    return {p for p in pairs if p and not suspects.isdisjoint(p.split(" "))}


def _counted(part: DataFrame, terms) -> DataFrame:
    """term, bad, good: how many texts with the label and without it have each of their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for term in terms(text or ""):
                    counts.setdefault(term, [0, 0])[int(y == 1)] += 1
        own = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([counts[t][1] for t in own], pa.int64()), pa.array([counts[t][0] for t in own], pa.int64())], names=["term", "bad", "good"])

    return part.select("text", "y").mapInArrow(run, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def exception_phrases(part: DataFrame, least: int = LEAST, purity: float = PURITY) -> frozenset[str]:
    """Pairs of words around suspect words that occur in `least` clean texts and hardly in toxic ones."""
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    rows = _counted(part, partial(_terms, frozenset())).where((F.col("bad") >= least) & (F.col("good") >= least) & (share >= SUSPECT) & ~F.col("term").startswith("^")).select("term").collect()
    suspects = frozenset(r["term"] for r in rows)
    if not suspects:
        return suspects
    clean = (F.col("good") >= least) & (F.col("good") >= purity * (F.col("bad") + F.col("good")))
    return frozenset(r["term"] for r in _counted(part, partial(_around, suspects)).where(clean).select("term").collect())


def learn(train: DataFrame, least: int = LEAST, purity: float = PURITY, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """The lexicon of the sample's first part: terms that occur in at least `least` labelled texts and are pure enough outside the
    exception phrases, which are learned here and added to the given ones."""
    part = train.where("part = 0")
    n = {r["y"]: r["n"] for r in part.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad_n, good_n = n.get(1, 0), n.get(0, 0)
    if not bad_n:
        return Lexicon({}, {}, exceptions)
    exceptions = frozenset(fold(p) for p in exceptions) | exception_phrases(part, least, purity)
    sums = _counted(part, partial(_terms, exceptions))
    weight = F.log((F.col("bad") + 0.5) / (bad_n - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (good_n - F.col("good") + 0.5))
    pure = (F.col("bad") >= least) & (F.col("bad") >= purity * (F.col("bad") + F.col("good") + 0.3))
    kept = {r["term"]: float(r["weight"]) for r in sums.where(pure).select("term", weight.alias("weight")).collect() if r["weight"] > 0}
    return Lexicon({t: w for t, w in kept.items() if t[0] != "^"}, {t[1:]: w for t, w in kept.items() if t[0] == "^"}, tuple(sorted(exceptions)))


def calibrate(train: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Logistic weights from the sample's second part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = lexicon.features([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("y"), *[pa.array(x[:, k]) for k in range(3)]], names=["y", "a", "b", "c"])

    got = train.where("part = 1").select("text", "y").mapInArrow(run, "y int, a double, b double, c double").toPandas()
    y = got["y"].to_numpy(float)
    if len(y) == 0 or y.max() == y.min():
        return np.array([1.0, 1.0, 1.0, -6.0 if len(y) == 0 or y.max() == 0 else 0.0])
    return logistic(got[["a", "b", "c"]].to_numpy(), y)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); labels has doc_id and toxic."""
    # The sample is bounded and read several times, the documents once.
    train = written(labelled(docs, labels, "toxic", MODULUS, REST, sample), f"{workdir(docs.sparkSession, 'toxicity')}/train")
    lexicon = learn(train, exceptions=exceptions)
    curve = calibrate(train, lexicon)

    def score(texts: list[str]) -> np.ndarray:
        x = lexicon.features(texts)
        return sigmoid(x @ curve[:3] + curve[3])

    return scored(docs, MODULUS, REST, score, THRESHOLD)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
