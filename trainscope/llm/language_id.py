"""Language identification: sparse multinomial regression on TF-IDF character n-grams, trained with FTRL."""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainscope.llm.common import fold, small_batches, table
from trainscope.llm.counting import total_counts
from trainscope.llm.words import pieces

#: Buckets of hashed n-grams, and the lengths of those.
BITS, LENGTHS = 15, (1, 2, 3)
#: Documents of each language that weights are learned from, at most.
SAMPLE = 400
#: Follow-the-regularised-leader: learning rate, its start, lasso and ridge, passes over the sample.
ALPHA, BETA, LASSO, RIDGE, PASSES = 0.1, 1.0, 0.02, 0.02, 3
#: Terms are counted per so many n-grams, so that long and short texts compare.
PER = 100.0


class Letters:
    """Which code points are letters; made once in each worker."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x30000)])
        return cls.table[np.minimum(points, 0x2FFFF)]


def _grams(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Buckets and rows of the n-grams of each length, and whether a text has a letter.

    Texts are lower-cased, and whatever is no letter counts as a blank, as do both ends.
    """
    lower = [f" {(t or '').lower()} " for t in texts.to_pylist()]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t) for t in lower])
    row = np.repeat(np.arange(len(lower)), size)
    letter = Letters.of(points)
    points = np.where(letter, points, np.uint32(32))
    letters = np.bincount(row[letter], minlength=len(lower)) > 0
    buckets, rows = [], []
    for n in LENGTHS:
        h = np.full(max(0, len(points) - n + 1), n, np.uint32)
        for j in range(n):
            h = (h ^ points[j:j + len(h)]) * np.uint32(0x9E3779B1)
            h = h ^ (h >> np.uint32(15))
        whole = row[:len(h)] == row[n - 1:]
        buckets.append((h[whole] * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int32))
        rows.append(row[:len(h)][whole])
    return buckets, rows, letters


def _train(examples: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> np.ndarray:
    """FTRL-proximal with elastic net, one example at a time; weights ``(bucket, class)``, many of them zero."""
    size = 1 << BITS
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * LASSO) / ((BETA + np.sqrt(n[at])) / ALPHA + RIDGE)
        return np.where(np.abs(z[at]) <= LASSO, 0.0, w)

    for _ in range(PASSES):
        for y, at, x in examples:
            at, x = np.append(at, size), np.append(x, 1.0)  # the last is the intercept
            w = weights(at)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size + 1))


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    def loss(t: float) -> float:
        s = logits / math.exp(t)
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(y)), y]).mean())

    low, high, golden = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


class Model:
    """Languages, weights that hold the inverse document frequencies, intercepts and temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, temperature: float):
        self.languages, self.weights, self.temperature = languages, weights, temperature

    def predict(self) -> Column:
        """``lang_pred`` and ``score`` of the column ``text``."""
        languages, temperature = self.languages, self.temperature
        weights = self.weights.astype(np.float32)

        @F.arrow_udf("struct<lang_pred:string,score:double>")
        def predict(texts: pa.Array) -> pa.Array:
            names, scores = [], []
            for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"])):
                logits, letters = _logits(piece.column(0), weights)
                p = np.exp((logits - logits.max(1, keepdims=True)) / temperature) if languages else np.ones((len(logits), 1))
                p = p / p.sum(1, keepdims=True)
                best = p.argmax(1)
                known = letters & bool(languages)
                names += [languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
                scores.append(np.where(known, p.max(1), 0.0))
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]), pa.float64())],
                                              ["lang_pred", "score"])

        return predict.asNondeterministic()(F.col("text").cast("string"))  # so that Spark runs it once a row


def _logits(texts: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buckets, rows, letters = _grams(texts)
    n, classes = len(texts), weights.shape[1]
    total = sum(np.bincount(r, minlength=n) for r in rows)
    logits = np.tile(weights[-1].astype(np.float64), (n, 1))
    for c in range(classes):
        own = np.ascontiguousarray(weights[:-1, c])
        sums = sum(np.bincount(r, own[b], n) for b, r in zip(buckets, rows))
        logits[:, c] += PER * sums / np.maximum(total, 1)
    return logits if classes else np.zeros((n, 1)), letters


def learn_languages(docs: DataFrame, learn: Column) -> Model:
    """A model from text and ``lang`` of the rows that ``learn`` admits; rows where either is null teach nothing.

    Document frequencies of the n-gram buckets come from all those rows.  Weights come from at most
    ``SAMPLE`` documents of each language (those of smallest hash), a fifth of which fit the
    temperature.  Without any such row the model knows no language.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", "doc_id")
    size = 1 << BITS

    def count(total, piece):
        buckets, row, _ = _grams(piece.column("text"))
        present = np.zeros((piece.num_rows, size), bool)
        for b, r in zip(buckets, row):
            present[r, b] = True
        total[:size] += present.sum(0)
        total[size] += piece.num_rows

    counts = total_counts(rows.select("text"), count, size + 1)
    if not counts[size]:
        return Model([], np.zeros((size + 1, 0)), 1.0)
    idf = np.log((1 + counts[size]) / (1 + counts[:size])) + 1

    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = rows.select("doc_id", "lang").withColumn("place", place).where(F.col("place") <= SAMPLE).select("doc_id", "lang").distinct()
    sample = rows.join(ids, ["doc_id", "lang"], "left_semi")

    def gather(batches):
        for batch in batches:
            for piece in pieces(batch):
                buckets, row, letters = _grams(piece.column("text"))
                every, row = np.concatenate(buckets), np.concatenate(row)
                key, times = np.unique(row * size + every, return_counts=True)
                owner, bucket = key // size, (key % size).astype(np.int32)
                value = (PER * times / np.bincount(row, minlength=piece.num_rows)[owner] * idf[bucket]).astype(np.float32)
                cut = np.searchsorted(owner, np.arange(1, piece.num_rows))
                use = np.flatnonzero(letters)
                at, x = np.split(bucket, cut), np.split(value, cut)
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id").cast(pa.int64()).take(pa.array(use)),
                                                  "lang": piece.column("lang").take(pa.array(use)),
                                                  "at": pa.array([at[i].tobytes() for i in use], pa.binary()),
                                                  "x": pa.array([x[i].tobytes() for i in use], pa.binary())})

    got = sample.mapInArrow(gather, "doc_id long, lang string, at binary, x binary")
    got = got.orderBy(F.xxhash64("doc_id", "lang"), "doc_id", "x").collect()
    languages = sorted({r["lang"] for r in got})
    examples = [(languages.index(r["lang"]), np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in got]
    fit, held = [e for i, e in enumerate(examples) if i % 5], examples[::5]
    weights = _train(fit or examples, len(languages))
    logits = np.array([weights[at].T @ x + weights[-1] for _, at, x in held]).reshape(-1, len(languages))
    temperature = _temperature(logits, np.array([y for y, _, _ in held])) if len(held) > 20 else 1.0
    return Model(languages, np.vstack([weights[:-1] * idf[:, None], weights[-1:]]), temperature)


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, and ``lang_pred`` and ``score``; columns of these names are replaced.

    Only the text is read, and texts are not shuffled.  A text that is null or has no letter is
    ``und`` with score 0, as is any text when the model knows no language.
    """
    told = docs.drop("lang_pred", "score").withColumn("__told", model.predict())
    return told.withColumns({"lang_pred": F.col("__told.lang_pred"), "score": F.col("__told.score")}).drop("__told")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    return identify_languages(docs, learn_languages(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
