"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of letters (lower-cased; runs of anything else count as one space). Document frequencies cover all
training documents, and so does the list of languages. The weights are trained by the follow-the-regularised-leader rule with elastic-net penalties on a
bounded sample of each language; a temperature, fitted on a part of the samples that the weights haven't seen, calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelry.llm.shared import small_batches
from parcelry.llm.tokens import chunks

BITS, ORDERS = 15, (2, 3)
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Of code points below 0x3000, which are letters or marks; above, all count as letters.
_LETTER = np.array([chr(i).isalpha() or 0x300 <= i < 0x370 or 0x900 <= i < 0xE00 for i in range(0x3000)])


def grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """row, number of texts, and doc, bucket, count of the distinct n-grams, for runs of texts."""
    for c in chunks(pc.utf8_lower(pc.fill_null(texts, ""))):
        points = np.frombuffer(c.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        starts = np.append(0, np.cumsum((c.data & 0xC0) != 0x80))[c.bounds]
        letters = _LETTER[np.minimum(points, 0x2FFF)] | (points >= 0x3000)
        code = np.where(letters, points, np.uint32(0x20))
        doc = np.repeat(np.arange(len(starts) - 1, dtype=np.uint32), np.diff(starts))
        keys = []
        for n in ORDERS:
            if len(code) < n:
                continue
            h = np.full(len(code) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                h = (h ^ code[j : len(code) - n + 1 + j]) * _MUL[j]
                h ^= h >> np.uint32(15)
            within = doc[n - 1 :] == doc[: len(doc) - n + 1]
            # A gram that begins and ends with spaces says nothing.
            within &= letters[: len(code) - n + 1] | letters[n - 1 :]
            h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
            keys.append(((doc[: len(h)] << np.uint32(BITS)) | h)[within])
        key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint32)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(key)))
        key = key[first]
        yield c.row, len(starts) - 1, (key >> np.uint32(BITS)).astype(np.int64), (key & np.uint32((1 << BITS) - 1)).astype(np.int64), counts


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for _, _, _, bucket, _ in grams(batch.column(0)):
            df += np.bincount(bucket, minlength=len(df))
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["bucket", "df"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, lang, buckets, counts from place, lang, text."""
    for batch in batches:
        buckets, counts = [], []
        for _, n, doc, bucket, count in grams(batch.column(2)):
            at = np.searchsorted(doc, np.arange(n + 1))
            buckets += [bucket[at[i] : at[i + 1]] for i in range(n)]
            counts += [count[at[i] : at[i + 1]] for i in range(n)]
        kinds = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.astype(np.int32) for b in buckets], kinds), pa.array([c.astype(np.int32) for c in counts], kinds)], ["place", "lang", "buckets", "counts"])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages, mostly zero
    bias: np.ndarray
    temperature: float

    def values(self, doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """TF-IDF values, of unit length per document."""
        v = (1 + np.log(count)) * self.idf[bucket]
        length = np.sqrt(np.bincount(doc, v * v, n))
        return v / np.maximum(length, 1e-12)[doc]

    def logits(self, doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        v = self.values(doc, bucket, count, n)
        return np.stack([np.bincount(doc, v * self.weights[bucket, j], n) for j in range(len(self.languages))], axis=1) + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, passes: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial logistic regression, by follow-the-regularised-leader per coordinate."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def solved(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(passes):
        for bucket, v, y in examples:
            w, b = solved(z[bucket], n[bucket], l1), solved(zb, nb, 0.0)
            d = softmax(v @ w + b)
            d[y] -= 1
            g = v[:, None] * d[None, :]
            old = n[bucket]
            z[bucket] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
            n[bucket] = old + g * g
            zb += d - (np.sqrt(nb + d * d) - np.sqrt(nb)) / alpha * b
            nb += d * d
    return solved(z, n, l1), solved(zb, nb, 0.0)


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, on a grid of factors from 1/20 to 20."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(-3, 3, 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def sampled(rows: DataFrame, quotas: dict[str, int], counts: dict[str, int]) -> pd.DataFrame:
    """place, lang, buckets, counts of as many rows of each language as its quota says: those with the smallest hashes."""

    def smallest(wanted: list[str], ahead: bool) -> pd.DataFrame:
        # Twice the expected share mostly holds enough, and needs no sorting of all rows.
        top = lambda x: int(-(2**63) + 2**64 * 2 * quotas[x] / counts[x]) if ahead and counts[x] > 2 * quotas[x] else 2**63 - 1
        limits = rows.sparkSession.createDataFrame([(x, top(x), quotas[x]) for x in wanted], "lang string, top long, quota int")
        some = rows.withColumn("place", F.xxhash64("doc_id", F.length("text"))).join(F.broadcast(limits), "lang").filter("place <= top")
        some = some.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("place"))).filter("nth <= quota")
        return some.select("place", "lang", "text").mapInArrow(_vectors, "place long, lang string, buckets array<int>, counts array<int>").toPandas()

    got = smallest(list(quotas), True)
    found = got["lang"].value_counts()
    few = [x for x in quotas if found.get(x, 0) < min(quotas[x], counts[x])]  # many rows of one hash
    if few:
        got = pd.concat([got[~got["lang"].isin(few)], smallest(few, False)])
    return got.sort_values(["place", "lang"], ignore_index=True)


def train(labelled: DataFrame, sample: int = 4000, passes: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, least: int = 200) -> Model | None:
    """A model from rows (doc_id, text, lang) with non-null lang; None if there are none.

    Languages and document frequencies come from all rows. The weights come from a bounded sample of each language, the rows with
    the smallest hashes of doc_id: its share of `sample` rows, rounded up, or `least` (all, if it has fewer) where that is more.
    Every fifth row of a language is left to the calibration.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    if n == 0:
        return None
    found = rows.select("text").mapInArrow(_frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(1 << BITS)
    df[found["bucket"].to_numpy()] = found["df"].to_numpy()
    idf = np.log((n + 1) / (df + 1)) + 1
    got = sampled(rows, {x: max(-(-sample * c // n), min(c, least)) for x, c in counts.items()}, counts)
    languages = sorted(counts)
    model = Model(languages, idf, np.zeros((1 << BITS, len(languages))), np.zeros(len(languages)), 1.0)
    examples = []
    for b, c, lang in zip(got["buckets"], got["counts"], got["lang"], strict=True):
        b = np.asarray(b, np.int64)
        examples.append((b, model.values(np.zeros(len(b), np.int64), b, np.asarray(c), 1), languages.index(lang)))
    last = (got.groupby("lang").cumcount() % 5 == 4).tolist()
    fit = [e for e, x in zip(examples, last, strict=True) if not x]
    rest = [e for e, x in zip(examples, last, strict=True) if x]
    model.weights, model.bias = ftrl(fit, len(languages), passes, alpha, beta, l1, l2)
    logits = np.array([v @ model.weights[b] + model.bias for b, v, _ in rest]).reshape(len(rest), len(languages))
    model.temperature = calibrated(logits, np.array([y for _, _, y in rest], np.int64))
    return model


def _predict(model: Model | None, keep: int):
    """Adds lang_pred and score after the first `keep` columns, the last of which is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(keep)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
            names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            if model is not None:
                for row, n, doc, bucket, count in grams(texts):
                    p = softmax(model.logits(doc, bucket, count, n) / model.temperature)
                    names[row : row + n], scores[row : row + n] = np.array(model.languages, object)[p.argmax(axis=1)], p.max(axis=1)
            names[~letters], scores[~letters] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(names.tolist(), pa.string()), pa.array(scores)], [*batch.schema.names[:keep], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column, **parameters) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang); held-out rows train nothing.

    A prediction depends on the text only. Null texts and texts without letters are `und` with score 0, as are all
    if no row can train. Repeated rows are predicted each; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(rows.filter(~F.col("held_out")), **parameters)
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(model, 2), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = 0.5, **parameters) -> DataFrame:
    """The rows of docs whose language is told with a score of at least `least`; columns and values stay as they are.

    The model learns from all rows with a non-null lang. Null texts and texts without letters go. Only the texts go
    through Python, and only a flag comes back.
    """
    told = _predict(train(docs.select("doc_id", "text", "lang"), **parameters), 0)

    @F.arrow_udf("boolean")
    def sure(texts: pa.Array) -> pa.Array:
        (out,) = told(iter([pa.RecordBatch.from_arrays([texts], ["text"])]))
        known = (out.column(0).to_numpy(zero_copy_only=False) != "und") & (out.column(1).to_numpy() >= least)
        return pa.array(known, pa.bool_())

    return docs.filter(sure(F.col("text").cast("string")))
