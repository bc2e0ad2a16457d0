"""Near-dedup and substring dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parcelry.llm.near_dedup import deduplicated, near_duplicates, samples, similarity, weighted_shingles, word_weights
from parcelry.llm.substring_dedup import Repeats
from parcelry.llm.tokens import chunks

WORDS = [f"w{i}" for i in range(400)]


def edited(words, r, edits):
    words = words[:]
    for _ in range(edits):
        words[r.randrange(len(words))] = f"z{r.randrange(10**9)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact copies, near copies at many distances, passages that several share, and repeats within a text."""
    r = random.Random(8)
    texts = [[r.choice(WORDS) for _ in range(r.randint(30, 200))] for _ in range(60)]
    out = [" ".join(t) for t in texts]
    out += [" ".join(edited(r.choice(texts), r, r.randint(0, 6))) for _ in range(80)]
    passage = [r.choice(WORDS) for _ in range(60)]
    out += [" ".join(r.sample(WORDS, 40) + passage + r.sample(WORDS, 40)) for _ in range(10)]
    out += [" ".join(["x"] * n) for n in (1, 19, 20, 21, 70)] + ["a b " * n for n in (5, 10, 33)] + ["", None]
    return list(enumerate(out))


def shingles(text):
    w = (text or "").split()
    return Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    """Of multisets."""
    return (a & b).total() / (a | b).total()


def test_recall_at_the_operators_own_threshold(spark, data):
    """Every pair of texts with a weighted similarity of 0.8 or more, found by brute force over shared shingles, is in one class."""
    r = random.Random(3)
    texts = [x.text for x in spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet").orderBy("doc_id").collect()]
    long = [t.split(" ") for t in texts if 60 <= t.count(" ") <= 400][:120]
    texts += [" ".join(edited(t, r, max(1, round(len(t) * share)))) for t in long for share in (0.005, 0.01, 0.015, 0.02, 0.03)]
    texts = sorted(set(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = word_weights(docs)
    sets, holders = [], {}
    for c in chunks(pa.array(texts)):
        doc, shingle, weight = weighted_shingles(c, idf, 5)
        for d in range(len(c.bounds) - 1):
            sets.append((shingle[doc == d], weight[doc == d]))
    for i, (shingle, _) in enumerate(sets):
        for x in shingle.tolist():
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() if len(h) < 200 for k, a in enumerate(h) for b in h[k + 1 :]}
    links = [(a, b) for a, b in pairs if similarity(sets[a], sets[b]) >= 0.8]
    got = {x.doc_id: x.class_id for x in near_duplicates(docs).collect()}
    joined = sum(got[a] == got[b] for a, b in links)
    print(f"{joined} of {len(links)} pairs of at least 0.8 joined")
    assert len(links) > 300 and joined >= 0.99 * len(links)
    linked = {x for pair in links for x in pair}
    assert all(i in linked for i, c in got.items() if sum(v == c for v in got.values()) > 1)  # nothing else is joined


def test_near_duplicates_find_all_clear_pairs_and_join_no_clean_ones(spark, corpus):
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    sets = {d: shingles(t) for d, t in corpus}
    found = missed = 0
    for a, sa in sets.items():
        for b, sb in sets.items():
            if a < b and sa and sb:
                j = jaccard(sa, sb)
                if j >= 0.85:
                    found, missed = found + 1, missed + (got[a] != got[b])
                if got[a] == got[b]:
                    assert any(jaccard(sa, s) >= 0.7 for d, s in sets.items() if d != a and s)
    assert found > 20 and missed == 0
    ids = [d for d, c in got.items() if d == c]
    assert len(ids) == len(set(got.values()))


def test_samples_estimate_weighted_similarity():
    r = random.Random(1)
    base = [r.choice(WORDS) for _ in range(400)]
    idf = np.full(1 << 16, 3 << 16, np.int64)
    (c,) = chunks(pa.array([" ".join(base), " ".join(edited(base, r, 20))]))
    doc, shingle, weight = weighted_shingles(c, idf, 5)
    s = samples(doc, shingle, weight, 2000)
    a, b = ((shingle[doc == i], weight[doc == i]) for i in (0, 1))
    assert abs((s[0] == s[1]).mean() - similarity(a, b)) < 0.04


def test_one_of_each_class_stays(spark, nasty, empty):
    assert near_duplicates(empty).count() == 0
    got = near_duplicates(nasty).collect()
    assert len(got) == nasty.count()
    assert sum(r.kept for r in got) == len({r.text or '' for r in nasty.collect()})
    kept = deduplicated(nasty)
    assert kept.columns == nasty.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text or "" for r in nasty.collect()}


def brute(rows, k=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w, new = (t or "").encode().split(), []
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            x = b" ".join(w[i : i + k])
            if x in seen:
                gone[i : i + k] = [True] * k
            seen.add(x)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_equal_brute_force(spark, corpus):
    rep = Repeats(spark.createDataFrame(corpus, "doc_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rep.cut().collect()}
    want = brute(corpus)
    assert got == want
    spans = rep.compacted().collect()
    words = {d: (t or "").split() for d, t in corpus}
    assert spans and any(s.n_words >= 60 for s in spans)
    for s in spans:
        if (s.doc_id, s.start) != (s.owner_doc_id, s.owner_start):
            assert words[s.doc_id][s.start : s.start + s.n_words] == words[s.owner_doc_id][s.owner_start : s.owner_start + s.n_words]


def test_spans_are_the_windows_that_start_earlier(spark):
    """Passages that begin and end inside runs: spans hold their windows, no others, and are cut where sources change."""
    r = random.Random(4)
    fresh = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    passage, tail = fresh(90), fresh(70)
    texts = [fresh(33) + passage + fresh(31), fresh(17) + passage + fresh(45), fresh(9) + passage[7:71] + fresh(25), fresh(40) + tail, passage + tail + fresh(3), passage[30:] + tail[:50], fresh(50)]
    spans = Repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).compacted().collect()
    first, want = {}, {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 19):
            source = first.setdefault(tuple(t[i : i + 20]), (d, i))
            if source != (d, i):
                want[d, i] = source
    got = [((s.doc_id, s.start + i), (s.owner_doc_id, s.owner_start + i)) for s in spans for i in range(s.n_words - 19)]
    assert len(got) == len(want) and dict(got) == want
    assert max(s.n_words for s in spans) > 45 and len(spans) < len(want) / 4


def test_substrings_are_told_apart_by_their_words(spark, monkeypatch):
    """Words whose sums of powers modulo 2^64 are equal differ, and so do texts that share a doc_id."""
    bits = [0]
    for _ in range(10):
        bits += [1 - b for b in bits]
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, "".join("ab"[b] for b in bits) + " " + tail), (2, "".join("ba"[b] for b in bits) + " " + tail), (None, tail + " end"), (None, "start " + tail + " end"), (None, "start " + tail + " end")]
    got = sorted((r.doc_id or 0, r.n_removed) for r in Repeats(spark.createDataFrame(rows, "doc_id long, text string")).cut().collect())
    assert got[3:] == [(1, 0), (2, 0)] and sorted(n for _, n in got[:3]) in ([0, 0, 20], [0, 20, 20])


def test_spans_whose_words_differ_stay():
    from parcelry.llm.substring_dedup import cut_words, digest

    words = [b"%d" % i for i in range(40)]
    text, good = " ".join(str(i) for i in range(40)), digest(words[5:26])
    assert len(cut_words(text, [{"start": 5, "n": 2, "digest": good}], 20)[1]) == 19
    assert len(cut_words(text, [{"start": 6, "n": 2, "digest": good}], 20)[1]) == 40


def test_substrings_of_nasty_rows(spark, nasty, empty):
    assert Repeats(empty).cut().count() == 0
    got = Repeats(nasty).cut().collect()
    assert len(got) == nasty.count()
    long = next(r for r in got if r.doc_id == 7)
    assert (long.n_words, long.n_removed) == (5000, 4999)
    docs = Repeats(nasty).documents()
    assert docs.columns == nasty.columns and docs.filter("doc_id = 7").first().text == "word"


def test_real_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Repeats(documents).cut().collect()}
    assert got == brute(rows)
