"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's letter n-grams (2 to 4, with word boundaries) are hashed into buckets; each bucket has an embedding, a text is the
mean of its embeddings, and a linear softmax reads the language. Embeddings and softmax are trained by stochastic gradient
descent in numpy on a bounded sample. A temperature fitted on set-aside rows calibrates the probabilities, and the level
below which a prediction is rejected comes from the same rows.

Defined results: texts that are null or hold no letter get `und` and score 0; without any labelled row every text does;
repeated rows get equal results and are learned from once; ties between languages go to the first by name; texts of any length
are read whole, in pieces; an empty table gives an empty result; only doc_id, text and, for training, lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table
from .supervised import held

MODULUS, REST = 4, 2
#: Documents to learn from, at most about, and of each language at least, if it has so many; characters handled at a time.
SAMPLE, LEAST, PIECE = 4_000, 50, 1 << 20
#: Languages, the most frequent ones, whose least number is looked after; the others come by the common share.
STRATA = 1_024
BUCKETS_LOG2, WIDTH, SIZES = 16, 16, (2, 3, 4)
SNIPPETS, SNIPPET_CHARS = 3, 48
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), dtype=np.uint8).astype(bool))
    return _LETTER[0]


def grams(text: str) -> np.ndarray:
    """Bucket ids of all n-grams of one lower-cased text, in order by n."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ok = _letters()[code]
    code = np.concatenate([[np.uint32(1)], np.where(ok, code, np.uint32(1)), [np.uint32(1)]])
    ok = code != 1
    out = []
    for n in SIZES:
        m = len(code) - n + 1
        if m <= 0:
            continue
        valid = np.ones(m, dtype=bool)
        for k in range(1, n - 1):  # only the ends may be boundaries
            valid &= ok[k : k + m]
        if n == 2:
            valid &= ok[:m] | ok[1 : 1 + m]
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            h ^= code[k : k + m]
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        out.append((h >> np.uint32(32 - BUCKETS_LOG2))[valid])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def pieces(text: str) -> Iterator[str]:
    """The whole text in pieces of bounded length, cut where a boundary is near if there is one."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            end = max(text.rfind(" ", at + 1, end), 0) or end
        yield text[at:end]
        at = end


class Model:
    """names, the per-bucket scores of each language (embedding times softmax), bias, temperature and rejection level."""

    def __init__(self, names: list[str], scores: np.ndarray, bias: np.ndarray, heat: float = 1.0, reject: float = 0.0):
        self.names, self.scores, self.bias, self.heat, self.reject = names, scores, bias, heat, reject

    def logits(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.names)), 0
        for piece in pieces(text):
            ids = grams(piece)
            if len(ids):
                counts = np.bincount(ids, minlength=len(self.scores)) if len(ids) > 4 * len(self.scores) else None
                total += counts @ self.scores if counts is not None else self.scores[ids].sum(axis=0)
                n += len(ids)
        return total / n + self.bias if n else None

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        found, score = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            z = self.logits(text) if self.names else None
            if z is None:
                found.append(UNKNOWN)
                continue
            p = softmax(z[None] / self.heat)[0]
            k = int(p.argmax())
            found.append(self.names[k])
            score[i] = p[k]
        return found, score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 4, rate: float = 2.0, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stochastic gradient descent over (class, bucket ids, counts); returns embeddings, softmax weights and bias."""
    draw = np.random.default_rng(seed)
    emb = draw.normal(0, 0.1, (1 << BUCKETS_LOG2, WIDTH))
    w, bias = draw.normal(0, 0.3, (WIDTH, classes)), np.zeros(classes)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            y, ids, counts = rows[i]
            share = counts / counts.sum()
            h = share @ emb[ids]
            g = softmax((h @ w + bias)[None])[0]
            g[y] -= 1.0
            step = rate * (1 - done / steps)
            back = w @ g
            w -= 0.1 * step * np.outer(h, g)
            bias -= 0.02 * step * g
            emb[ids] -= step * share[:, None] * back * min(len(ids), 64)  # shares are small in long texts
            done += 1
    return emb, w, bias


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of the whole text and of a few snippets at positions given by the text's length."""
    for batch in batches:
        lang, part, ids, counts = [], [], [], []
        for text, y, k in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), batch.column("part").to_pylist(), strict=True):
            cuts = [text] + [text[(j * 7919 + len(text) * 31) % max(1, len(text) - SNIPPET_CHARS) :][:SNIPPET_CHARS] for j in range(1, SNIPPETS + 1)]
            for cut in cuts:
                found = [grams(p) for p in pieces(cut)]
                u, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0, int))
                if len(u):
                    lang.append(y), part.append(k), ids.append(u.astype(np.uint32).tobytes()), counts.append(c.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(part, pa.int32()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "part", "ids", "counts"])


def training_rows(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """doc_id, text, lang of about `sample` documents outside the held-out remainder, and of at least about `least` of each language
    (all, if it has fewer). Rows alike in the three count once, so that copies do not break the bound."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", MODULUS) != F.lit(REST)))
    known = known.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("m"))
    total = sizes.agg(F.sum("m")).first()[0] or 1
    strata = sizes.orderBy(F.desc("m"), "lang").limit(STRATA).select("lang", (F.lit(float(least)) / F.col("m")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.greatest(F.lit(sample / total), F.coalesce("share", F.lit(0.0)))
    return known.join(F.broadcast(strata), "lang", "left").where(draw < share).select("doc_id", "text", "lang").dropDuplicates()


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model learned from text and lang of a bounded sample outside the held-out remainder."""
    rows = training_rows(docs, sample)
    part = (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0).cast("int").alias("part")
    got = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), part).mapInArrow(_sample_rows, "lang string, part int, ids binary, counts binary").collect()
    got = sorted(got, key=lambda r: (r["lang"], r["ids"], r["counts"]))
    names = sorted({r["lang"] for r in got})
    if not names:
        return Model([], np.zeros((1 << BUCKETS_LOG2, 0)), np.zeros(0))
    at = {n: i for i, n in enumerate(names)}
    data = [(at[r["lang"]], np.frombuffer(r["ids"], np.uint32), np.frombuffer(r["counts"], np.float32).astype(np.float64), r["part"]) for r in got]
    own = [d[:3] for d in data if d[3] == 0] or [d[:3] for d in data]
    emb, w, bias = train(own, len(names))
    scores = emb @ w
    rest = [d for d in data if d[3] == 1]
    if not rest:
        return Model(names, scores, bias)
    z = np.array([counts @ scores[ids] / counts.sum() + bias for _, ids, counts, _ in rest])
    y = np.array([d[0] for d in rest])
    heats = np.geomspace(0.1, 10, 60)
    heat = float(min(heats, key=lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()))
    p = softmax(z / heat)
    # Predictions below this level were right less often than wrong on the set-aside rows.
    best, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(best)
    share = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    low = np.nonzero(share < 0.5)[0]
    return Model(names, scores, bias, heat, float(best[order][low[-1]]) if len(low) else 0.0)


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected (the score lies below the calibrated level) for each row of docs."""
    model = fit(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = model.predict([t or "" for t in batch.column("text").to_pylist()])
            rejected = pa.array([f == UNKNOWN or s < model.reject for f, s in zip(found, score, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.string()), pa.array(score), rejected], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", held(MODULUS, REST), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
