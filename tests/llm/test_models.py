"""Language ID and quality model: held-out accuracy, contracts, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from parcelry.llm import language_id as li
from parcelry.llm.language_id import accepted, calibrated, identify, softmax
from parcelry.llm.quality_model import estimated_prior, fit, risk, score_quality
from parcelry.llm.shared import fold


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = {r.id: r.f for r in spark.range(50).select("id", fold(F.col("id"), 4).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in range(50)}


def test_language_accuracy_on_held_out_rows(spark, documents):
    got = identify(documents, fold(F.col("doc_id"), 4) == 2).join(documents.select("doc_id", "lang"), "doc_id")
    r = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 20 and r.a >= 0.98
    assert got.filter("score < 0 or score > 1").isEmpty()


def test_language_of_odd_rows(spark, nasty, empty):
    assert identify(empty, F.lit(False)).count() == 0
    got = {(r.doc_id, r.lang_pred) for r in identify(nasty, F.lit(False)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (12, "und")} <= got
    assert {r.lang_pred for r in identify(nasty.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()} == {"und"}
    kept = accepted(nasty)
    assert kept.columns == nasty.columns and not {r.doc_id for r in kept.collect()} & {1, 2, 3, 12}


def test_rare_languages_are_learnt(spark):
    """A language with few of the labelled rows, however small the sample, and one whose rows all have one hash."""
    text = lambda words, i: " ".join(words[(i * 7 + j * j) % len(words)] for j in range(12))
    a, b, c = "the and water house tree".split(), "zxq qzx xzzq qqx zqz".split(), "öäü üöä ßäö äüß öüß".split()
    rows = [(i, text(a, i), "aa") for i in range(900)] + [(1000 + i, text(b, i), "bb") for i in range(9)] + [(None, text(c, 1), "cc")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(docs, F.lit(False), sample=20, least=8).join(docs.select("doc_id", "lang").distinct(), "doc_id").collect()
    assert {(r.lang, r.lang_pred) for r in got} == {("aa", "aa"), ("bb", "bb")}
    assert identify(docs, F.lit(False), sample=20, least=8).filter("doc_id is null and lang_pred = 'cc'").count() == 300


def test_temperature_calibrates():
    r = np.random.default_rng(2)
    logits = r.normal(size=(4000, 3)) * 2
    y = np.array([r.choice(3, p=p) for p in softmax(logits)])
    assert abs(calibrated(logits * 4, y) - 4) < 0.6


def test_quality_on_held_out_rows(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs, labels, fold(F.col("doc_id"), 3) == 1).join(labels, "doc_id").filter("held_out").toPandas()
    pos, neg = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert len(neg) > 5 and (pos[:, None] > neg[None]).mean() > 0.97
    assert (got.predicted == got.quality).mean() > 0.95


def test_quality_of_odd_rows(spark, nasty, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert score_quality(empty, none, F.lit(False)).count() == 0
    assert {r.score for r in score_quality(nasty, none, F.lit(False)).collect()} == {0.5}
    labels = spark.createDataFrame([(7, 1), (9, 0), (9, 1), (None, 1), (8, None)], "doc_id long, quality int")
    got = score_quality(nasty, labels, F.lit(False)).collect()
    assert len(got) == nasty.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_positive_unlabelled_learning_splits_a_mixture():
    r = np.random.default_rng(3)
    good, bad = r.normal(0, 1, (3000, 4)), r.normal(3, 1, (600, 4))
    m = fit(good[:1200], np.concatenate([good[1200:2700], bad[:300]]), 1500 / 1800)
    p, n = m.score(good[2700:]), m.score(bad[300:])
    assert (p >= 0.5).mean() > 0.97 and (n >= 0.5).mean() < 0.3 and (p[:, None] > n[None]).mean() > 0.99


def test_prior_comes_from_positives_and_unlabelled_rows():
    r = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        n = int(3000 * share)
        good, bad = r.normal(0, 1, (3000 + n, 4)), r.normal(2.5, 1, (3000 - n, 4))
        assert abs(estimated_prior(good[:3000], r.permutation(np.concatenate([good[3000:], bad]))) - share) < 0.08
    assert estimated_prior(good[:9], bad[:9]) == 0.5


def test_language_step_equals_brute_force():
    """One FTRL step over one example by a plain loop."""
    from parcelry.llm.language_id import ftrl

    bucket, v = np.array([3, 8]), np.array([0.6, 0.8])
    w, b = ftrl([(bucket, v, 1)], 2, 1, alpha=0.5, beta=1.0, l1=0.02, l2=0.01)
    for i, k in enumerate(bucket):
        for c, d in enumerate((0.5, -0.5)):
            z, n = v[i] * d, (v[i] * d) ** 2
            want = 0.0 if abs(z) <= 0.02 else -(z - np.sign(z) * 0.02) / ((1.0 + n**0.5) / 0.5 + 0.01)
            assert abs(w[k, c] - want) < 1e-12
    assert (b > 0).tolist() == [False, True]


@pytest.mark.parametrize("scale", [0.1, 3.0])
def test_risk_and_gradient_equal_brute_force(scale):
    """The risk by plain loops, and its gradient by finite differences, on both sides of the non-negative bound."""
    r = np.random.default_rng(6)
    bins, prior = 9, 0.4
    w, bias = r.normal(0, scale, bins), 0.3
    p, u = (np.column_stack([r.integers(0, 4, n), r.integers(4, bins, n)]) for n in (30, 50))
    if scale > 1:
        w[u] -= 4  # the unlabelled score low, the positives too: the negatives' part falls below zero
        prior = 0.95
        p = u[:30]
        w[p[:, 0]] += 6

    def parts(w, bias):
        log = lambda x: math.log1p(math.exp(-abs(x))) + max(x, 0)
        g = lambda row: sum(w[k] for k in row) + bias
        positive = prior * sum(log(-g(x)) for x in p) / len(p)
        return positive, sum(log(g(x)) for x in u) / len(u) - prior * sum(log(g(x)) for x in p) / len(p)

    positive, negative, d = risk(w, bias, p, u, prior)
    assert np.allclose((positive, negative), parts(w, bias), atol=1e-12)

    def objective(w, bias):
        a, b = parts(w, bias)
        return a + b if negative >= 0 else -b

    for k in range(bins + 1):
        e = np.zeros(bins + 1)
        e[k] = 1e-6
        slope = (objective(w + e[:-1], bias + e[-1]) - objective(w - e[:-1], bias - e[-1])) / 2e-6
        assert abs(slope - d[k]) < 1e-6


def test_grams_frequencies_and_logits_equal_brute_force(spark, documents):
    """n-gram counts, document frequencies, TF-IDF values and logits by plain loops over characters."""
    texts = [r.text for r in documents.limit(25).collect()] + ["", None, "A", "é1b", "  two  words ", "ΣΑΣ ẞ İx", "中文 हिन्दी"]

    def key(gram):
        h = len(gram) * 0x27D4EB2F & 0xFFFFFFFF
        for j, ch in enumerate(gram):
            h = (h ^ ord(ch)) * int(li._MUL[j]) & 0xFFFFFFFF
            h ^= h >> 15
        return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - li.BITS)

    def counts(text):
        low = pc.utf8_lower(pa.array([text or ""])).to_pylist()[0]
        letter = [bool(li._LETTER[ord(c)]) if ord(c) < 0x3000 else True for c in low]
        out = Counter()
        for n in li.ORDERS:
            for i in range(len(low) - n + 1):
                if letter[i] or letter[i + n - 1]:
                    out[key("".join(c if x else " " for c, x in zip(low[i : i + n], letter[i : i + n], strict=True)))] += 1
        return out

    want = [counts(t) for t in texts]
    got = [Counter() for _ in texts]
    for row, _, doc, bucket, count in li.grams(pa.array(texts, pa.string())):
        for d, b, c in zip(doc.tolist(), bucket.tolist(), count.tolist(), strict=True):
            got[row + d][b] = c
    assert got == want

    model = li.train(spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    df = Counter(b for w in want for b in w)
    assert all(abs(model.idf[b] - (math.log((len(texts) + 1) / (n + 1)) + 1)) < 1e-12 for b, n in df.items())
    for row, n, doc, bucket, count in li.grams(pa.array(texts, pa.string())):
        logits = model.logits(doc, bucket, count, n)
        for d in range(n):
            v = {b: (1 + math.log(c)) * model.idf[b] for b, c in want[row + d].items()}
            length = math.sqrt(sum(x * x for x in v.values())) or 1.0
            plain = [sum(x / length * model.weights[b, j] for b, x in v.items()) + model.bias[j] for j in range(2)]
            assert np.allclose(logits[d], plain, atol=1e-9)
