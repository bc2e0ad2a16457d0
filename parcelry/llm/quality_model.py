"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts, with a share p of positives among the latter that is estimated from both, give the non-negative
unbiased risk p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]) (logistic loss l), which is minimised by gradient steps; where
the second part falls below zero, the step goes against it. The scorer adds up weights of binned text statistics: shares
of character classes, words, repeats and lines, none of which depends on the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.llm.shared import small_batches
from parcelry.llm.tokens import Chunk, chunks

#: Classes of bytes: lower, upper, digit, space, newline, then single signs, symbols, other signs, bytes of other alphabets.
_CLASS = np.full(256, 12, np.int64)
for _k, _s in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".", ",", "!", "?", "|", "#*$%&<>@~^_=+\\/", "'\"()-;:[]{}")):
    _CLASS[[ord(c) for c in _s]] = _k
CLASSES = 13


def statistics(c: Chunk) -> np.ndarray:
    """One row of statistics per text of the chunk."""
    docs = len(c.bounds) - 1
    size = np.maximum(np.diff(c.bounds), 1)
    doc_of_byte = np.repeat(np.arange(docs), np.diff(c.bounds))
    kind = _CLASS[c.data]
    share = np.bincount(doc_of_byte * CLASSES + kind, minlength=docs * CLASSES).reshape(docs, CLASSES) / size[:, None]
    starts, ends = c.spans
    doc = c.doc_of_word
    n = np.diff(c.word_bounds)
    some = np.maximum(n, 1)
    length = ends - starts
    mean = np.bincount(doc, length, docs) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, length * length, docs) / some - mean * mean, 0))
    last = np.bincount(doc * CLASSES + kind[ends - 1], minlength=docs * CLASSES).reshape(docs, CLASSES) / some[:, None]
    first = np.bincount(doc * CLASSES + kind[starts], minlength=docs * CLASSES).reshape(docs, CLASSES) / some[:, None]
    same = np.bincount(doc[1:][(c.words[1:] == c.words[:-1]) & (doc[1:] == doc[:-1])], minlength=docs) / some

    def distinct(width: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows, and those found once, as shares of all windows."""
        at = np.arange(max(0, len(c.words) - width + 1))
        at = at[doc[at] == doc[at + width - 1]]
        key = np.sort((doc[at].astype(np.uint64) << np.uint64(52)) | (c.windows(at, width) >> np.uint64(12)))
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        once = new & np.append(new[1:], True) if len(key) else new
        per = (key >> np.uint64(52)).astype(np.int64)
        total = np.maximum(np.bincount(per, minlength=docs), 1)
        return np.bincount(per[new], minlength=docs) / total, np.bincount(per[once], minlength=docs) / total

    one, one_once = distinct(1)
    three, three_once = distinct(3)
    lines = share[:, 4] * size + 1
    return np.column_stack([np.log1p(n), share, first, last, mean, spread, same, one, one_once, three, three_once, np.log(lines), np.log(some / lines), share[:, 1] / (share[:, 0] + share[:, 1] + 1e-9)])


@dataclass
class Model:
    edges: list[np.ndarray]  # per statistic
    weights: list[np.ndarray]  # per statistic and bin
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = np.full(len(x), self.bias)
        for j, (e, w) in enumerate(zip(self.edges, self.weights, strict=True)):
            g += w[np.searchsorted(e, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk(w: np.ndarray, bias: float, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The positives' and the negatives' part of the unbiased logistic risk of an additive function, and the direction of a step.

    p and u name the bin of each statistic of each row. The direction is the gradient of both parts (by bin, then the bias) while the negatives' part isn't
    negative; else it is that of undoing this part alone.
    """

    def gradient(at: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        """Of the mean over rows, by bin and for the bias."""
        g = np.bincount(at.ravel(), np.repeat(per_row, at.shape[1]), len(w)) / len(at)
        return np.append(g, per_row.mean())

    gp, gu = w[p].sum(axis=1) + bias, w[u].sum(axis=1) + bias
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    d_negative = gradient(u, _logistic(gu)) - prior * gradient(p, _logistic(gp))
    return prior * np.logaddexp(0, -gp).mean(), negative, prior * gradient(p, -_logistic(-gp)) + d_negative if negative >= 0 else -d_negative


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = 12, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> Model:
    """Minimises the non-negative risk over additive functions of binned statistics, by Adam on the whole samples."""
    both = np.concatenate([positive, unlabelled])
    edges = [np.unique(np.quantile(both[:, j], np.concatenate([[0.005, 0.02, 0.05], np.linspace(0, 1, bins + 1)[1:-1], [0.95, 0.98, 0.995]]))) for j in range(both.shape[1])]
    offset = np.append(0, np.cumsum([len(e) + 1 for e in edges]))

    def bins_of(x: np.ndarray) -> np.ndarray:
        return np.column_stack([offset[j] + np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)])

    p, u = bins_of(positive), bins_of(unlabelled)
    w, bias = np.zeros(offset[-1]), 0.0
    m, v = np.zeros(offset[-1] + 1), np.zeros(offset[-1] + 1)

    for step in range(1, steps + 1):
        d = risk(w, bias, p, u, prior)[2]
        d[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(edges, [w[offset[j] : offset[j + 1]] for j in range(len(edges))], float(bias))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, positive, x from place, positive, text."""
    for batch in batches:
        x = [row for c in chunks(batch.column(2)) for row in statistics(c)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["place", "positive", "x"])


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if model is not None:
                for c in chunks(batch.column(2)):
                    scores[c.row : c.row + len(c.bounds) - 1] = model.score(statistics(c))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: int = 40, delta: float = 0.1, rounds: int = 3) -> float:
    """The share of positives among the unlabelled, from both samples alone; within 0.05 and 0.95.

    The unlabelled are a mixture that holds the positives with share p, so for any scorer, the share of unlabelled above any score is at
    least p times that of positives, and equal where no negative scores so high. A scorer is fitted on half of the rows, with the estimate so
    far as prior; on the other half, the ratio of the two shares is bounded from above at each score. Each round does so on either half.
    As every ratio bounds p, the one with the smallest bound of all scorers and scores is the estimate. Below `least` rows of a kind
    nothing can be estimated: 0.5.
    """
    prior, tightest = 0.5, np.inf
    for _ in range(rounds if min(len(positive), len(unlabelled)) >= least else 0):
        rankings = [fit(positive[half::2], unlabelled[half::2], prior, steps=150) for half in (0, 1)]
        for half, ranking in enumerate(rankings):
            p, u = np.sort(ranking.score(positive[1 - half :: 2])), np.sort(ranking.score(unlabelled[1 - half :: 2]))
            at = np.unique(p)
            above_p, above_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
            slack = np.sqrt(np.log(4 / delta) / (2 * len(p))) + np.sqrt(np.log(4 / delta) / (2 * len(u)))
            bound = (above_u + slack) / above_p
            best = int(np.argmin(bound))
            if bound[best] < tightest:
                prior, tightest = float(np.clip(above_u[best] / above_p[best], 0.05, 0.95)), bound[best]
    return prior


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Model | None:
    """A model from docs (doc_id, text) and labels (doc_id, quality); None without positives or documents.

    At most `sample` different texts of positives and as many unlabelled ones are used: those with the smallest hashes of doc_id and text.
    Labels other than 1 aren't used; the class prior is estimated from positives and unlabelled rows.
    """
    small_batches(docs.sparkSession)
    trusted = labels.filter("quality = 1").select("doc_id").distinct()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"))

    def smallest(rows: DataFrame, positive: bool) -> DataFrame:
        place = F.xxhash64("doc_id", "text_key", F.lit(positive))
        return rows.distinct().select("doc_id", "text_key", place.alias("place")).orderBy("place").limit(sample).withColumn("positive", F.lit(positive))

    chosen = smallest(keyed.join(trusted, "doc_id", "left_semi"), True).union(smallest(keyed, False))
    # At most 2 * sample keys; rows that are equal in both give one.
    found = docs.withColumn("text_key", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "text_key"]).select("place", "positive", "text")
    found = found.mapInArrow(_stats, "place long, positive boolean, x array<double>").dropDuplicates(["place", "positive"]).toPandas()
    found = found.sort_values(["positive", "place"], ignore_index=True)
    if not len(found):
        return None
    x, positive = np.array(found["x"].tolist()), found["positive"].to_numpy()
    if not positive.any() or positive.all():
        return None
    return fit(x[positive], x[~positive], estimated_prior(x[positive], x[~positive]))


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; labels of held-out rows aren't read.

    held_out is a condition on doc_id. A score depends on the text only; a null text counts as empty and is scored, too. Where
    nothing can be learned all scores are 0.5. Repeated rows are scored each; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality")).filter(~held_out)
    model = train(rows.filter(~F.col("held_out")).select("doc_id", "text"), known, **parameters)
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
