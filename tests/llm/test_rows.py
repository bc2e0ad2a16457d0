"""Packing, fingerprints, HTML, mixing, host rules and URL filters."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelry.llm import fingerprints as fp
from parcelry.llm.host_rules import host_quality
from parcelry.llm.html_text import extract_pages, main_text
from parcelry.llm.mixing import Mix
from parcelry.llm.packing import Encoder, first_fit_decreasing, pack
from parcelry.llm.queries import URL_RULES
from parcelry.llm.tokens import chunks
from parcelry.llm.url_reputation import judge_urls

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def whole_ids(text):
    t = tokenizers.Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_the_tokenizer_on_whole_texts(documents):
    r = random.Random(3)
    odd = ["'s", "'t", "'RE", "é", "É", "ß", "ñ", "Ñ", "İ", "Σ", "σς", "ﬁ", "\u0301", "ü", "×", "÷", "1２三", "½", "_", "—", "\x1c", "\x85", "\xa0", "中文", "हिन्दी", "\t\n", ".,", "$%#", "<|endoftext|>", "<|", "abc", "XYZ", " ", "  ", "\n", "🙂"]
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 30))) for _ in range(1500)] + [x.text for x in documents.limit(60).collect()] + [None, ""]
    e = Encoder(PATH, 1)
    t = tokenizers.Tokenizer.from_file(PATH)
    got = [ids for c in chunks(pa.array(texts), 1 << 14) for ids in e.encode(c)]
    assert [g.tolist() for g in got] == [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def colliding():
    """Two words of 1024 letters that sums of powers modulo 2^64 can't tell apart: the Thue-Morse word and its complement."""
    bits = [0]
    for _ in range(10):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_are_not_linear():
    x, y = colliding()
    (c,) = chunks(pa.array([f"{x} {y}", " ".join(colliding()[0].replace("a", "on ").replace("b", "off ").split()), colliding()[1].replace("a", "on ").replace("b", "off ")]))
    assert c.words[0] != c.words[1]
    a, b = c.windows(c.word_bounds[1:3], 1024)
    assert a != b
    same = next(chunks(pa.array(["q w e r t y z u i o", "x q w e r t y z u i o"])))
    assert same.windows(np.array([0]), 7)[0] == same.windows(np.array([11]), np.array([7]))[0] and len(set(same.words.tolist())) == 11


def test_encoder_tells_parts_of_equal_hash_apart(monkeypatch):
    import parcelry.llm.packing as packing

    x, y = colliding()
    texts = [f"so {x}", f"and {y} then", "a longerword", "a longestwords"]
    want = [whole_ids(t) for t in texts]
    encode = lambda e: [ids.tolist() for t in texts for c in chunks(pa.array([t])) for ids in e.encode(c)]
    assert encode(Encoder(PATH, 1)) == want
    monkeypatch.setattr(packing, "span_hashes", lambda data, starts, ends: (ends - starts > 8).astype(np.uint64) * np.uint64(7) + np.uint64(1) * (ends - starts <= 8) * (data[starts].astype(np.uint64) * np.uint64(512) + (ends - starts).astype(np.uint64)))
    assert encode(Encoder(PATH, 1)) == want


def naive_first_fit(lengths, capacity):
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((k for k, used in enumerate(bins) if used + lengths[i] <= capacity), len(bins))
        if b == len(bins):
            bins.append(0)
        out[i] = (b, bins[b])
        bins[b] += lengths[i]
    return [out[i] for i in range(len(lengths))]


def test_tournament_tree_is_first_fit():
    r = random.Random(5)
    for n in (1, 2, 3, 50, 257):
        lengths = np.array([r.randint(1, 100) for _ in range(n)])
        assert list(map(tuple, np.stack(first_fit_decreasing(lengths, 100), 1).tolist())) == naive_first_fit(lengths.tolist(), 100)


def test_packing_is_whole_and_gapless(spark, documents, nasty, empty):
    assert pack(empty, PATH).count() == 0
    docs = documents.select("doc_id", "text").union(nasty.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10**6))
    rows = pack(docs, PATH, group_rows=64).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    want = Counter()
    for r in docs.collect():
        ids = whole_ids(r.text)
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want[r.doc_id, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    whole = pack(documents, PATH).agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert whole[0] / whole[1] / 2048 > 0.97


def test_merkle_trees():
    text = "One, two. Three four five six seven.\nSecond line here!\n\nA new section, at last.\nIts end."
    t = fp.tree(text)
    assert "".join(x for line in text.split("\n") for x in fp.leaf_spans(line)) == text.replace("\n", "")
    f = fp.printed(t)
    assert t["root"] == fp.tree(text)["root"] and fp.differing(f, f) == (0, 0, 0)
    other = fp.printed(fp.tree(text.replace("Second", "Another")))
    assert other != f and fp.differing(f, other) == (0, 1, 1)
    assert 0 < fp.likeness(f, other) < 1 == fp.likeness(f, f)
    assert fp.parsed(f)[0] == t["root"] and sum(len(p) for s in fp.parsed(f)[1] for p in s) == fp.DIGITS * sum(len(leaves) for _, ps in t["sections"] for _, leaves in ps)
    lines = text.split("\n")
    moved, twice, gone = (fp.printed(fp.tree("\n".join(x))) for x in (lines[:3] + lines[:2:-1], lines + lines[-1:], lines[:-1]))
    assert fp.differing(f, moved) == (2, 0, 2) or fp.differing(f, moved)[2] == 2
    assert fp.differing(twice, f)[2] == 1 and fp.differing(f, gone)[2] == 1 and fp.likeness(f, moved) > 0.9
    assert fp.tree("")["root"] != fp.tree("\n")["root"] != fp.tree(" ")["root"]


def leaf_counts(text):
    return Counter(x for line in text.split("\n") for x in fp.leaf_spans(line))


@pytest.mark.parametrize("rows", [3, 1000])
def test_fingerprints_of_edits(spark, documents, nasty, empty, rows):
    assert fp.fingerprint_edits(empty).count() == 0
    docs = documents.select("doc_id", "text").unionByName(nasty.select("doc_id", "text").filter("doc_id is null or doc_id <> 9").withColumn("doc_id", F.col("doc_id") * 17 + 10**6))
    got = {r.doc_id: r for r in fp.fingerprint_edits(docs, bucket_rows=rows).collect()}
    given = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(given)
    for (d, t), (_, n) in zip(given, [*given[1:], given[0]], strict=True):
        k = len(t) // 4
        e = t[: len(t) - k] + n[:k]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (got[d].fingerprint == got[d].edited_fingerprint) == (t == e) and (got[d].near_edited == 1) == (t == e)
        ft, fe, fn = (leaf_counts(x) for x in (t, e, n))
        for value, other, same in ((got[d].near_edited, fe, t == e), (got[d].near_next, fn, t == n)):
            share = (ft & other).total() / max(1, (ft | other).total())
            assert value == (1 if same else min(share, 1 - 1 / (ft.total() + other.total() + 1))) or abs(value - share) < 1e-9
    real = [r for r in got.values() if r.n_chars > 400 and r.near_edited < 1]
    assert sum(r.near_edited > r.near_next for r in real) > 0.95 * len(real)
    assert fp.fingerprint_edits(docs.filter("doc_id = 5")).first().near_next == 1.0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a><li>About</ul></nav><header>Site</header><div class="cookie-notice">We use cookies</div><aside>Side</aside>
<main><article><h1>Head&amp;line</h1><p><b>First&nbsp;par
 agraph<br>goes <i>o</i>n.<p>No.</p><div class="ad">Buy!</div><form><input><button>Go</button> Name</form>
<p>A longer paragraph that follows, with &lt;signs&gt; &#233; and more words than the others have in them.</p></article>
<section id="comments"><p>Nice article indeed, thank you for writing all of this down for us.</p></section></main><footer>&copy; x</footer></body>"""


def test_html_regions():
    assert main_text(PAGE) == "Head&line First par agraph goes on. No. A longer paragraph that follows, with <signs> é and more words than the others have in them."
    assert main_text(None) == main_text("") == main_text("<html><body><script>x</script>") == ""
    assert main_text("<p>only text, cut in the mid") == "only text, cut in the mid"
    plain = "<body><div class=menu>a</div><div><p>" + "Long content here. " * 20 + "</p><p>Short.</p><p>" + "More content there. " * 20 + "</p></div><div class=footer>f</div></body>"
    assert main_text(plain).split() == ("Long content here. " * 20 + "Short. " + "More content there. " * 20).split()


@pytest.mark.parametrize("before, after", [
    ('<div class="layout with-sidebar"><article>', '</article><div class="sidebar">Side things</div></div>'),
    ('<main class="no-sidebar">', "</main>"),
    ('<article class="post has-comments">', '<section id="comments"><article class="comment">Nice indeed.</article></section></article>'),
    ('<div id="page-header-content"><div>', '</div><div class="related">Others</div></div>'),
    ('<div class="promo-page"><div class="modal-open"><article>', "</article></div></div>"),
])
@pytest.mark.parametrize("rest", ["", "<div><p>Imprint and links</p></div>"])
def test_html_wrappers_with_marks(before, after, rest):
    body = "<h1>Head</h1><p>" + "Long content here. " * 20 + "</p><p>Short.</p><p class=share>Tell all</p><p>" + "More of it <i class=ad>buy</i>there. " + "More of it there. " * 19 + "</p>"
    if "<article" not in before and "<main" not in before:  # without regions, marked lines end the text
        body = body.replace("<p class=share>Tell all</p>", "")
    got = main_text(f"<body><nav>Menu</nav>{before}{body}{after}{rest}<footer>f</footer></body>")
    want = "Head " + "Long content here. " * 20 + "Short. " + "More of it there. " * 20
    assert got.split() == want.split()


def test_html_marks_beside_an_article_exclude():
    body = "<article><h1>Head</h1><p>" + "Long content here. " * 9 + "</p></article>"
    comments = '<div id="comments">' + ('<div class="comment"><article class="comment-body"><p>' + "Nice content indeed. " * 5 + "</p></article></div>") * 9 + "</div>"
    flat = '<div class="comments"><p>' + "Nice content indeed. " * 50 + "</p></div>"
    related = '<div class="related-posts"><article>A teaser of another one</article></div>'
    for rest in (comments, flat, related):
        for page in (body + rest, f"<main>{body}{rest}</main>"):
            assert main_text(f"<body>{page}</body>").split() == ("Head " + "Long content here. " * 9).split()


def test_html_inside_the_article_and_broken_pages():
    page = '<article><header class="entry-header"><h1>T</h1></header><section id="search-methods"><p>S is one.</p></section><p>x <math><mi>y</mi></math> a < b</p><p class="notice">N</p></article>'
    assert main_text(page) == "T S is one. x y a < b"
    import time

    began = time.time()
    for broken in ("<a " * 100_000, "<p>x</p><!--" + "- " * 100_000, "<b></i>" * 50_000, "<b>" * 50_000 + "<div></div>" * 50_000, "<a href='x" * 50_000, "<script>x" * 50_000, "<p>" + "word " * 200_000):
        main_text(broken)
    assert time.time() - began < 60
    assert main_text('<p title="a > b" x=\'<p>\'>kept <!-- <p>gone</p> --> too<? pi ?></p>') == "kept too"


def test_html_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.text for r in extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        import html

        assert "".join(got[r.page_id].split()) == "".join(html.unescape(article).split())
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", None), (1, "u", "<p>a", "y")], "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in extract_pages(odd).collect()] == [("", 0), ("", 0), ("a", 1)]


def water_targets(sizes, weights):
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        t = {s: 3.0 * sizes[s] if s in full else left * weights[s] / sum(weights[o] for o in open_) for s in sizes}
        more = {s for s in open_ if t[s] > 3 * sizes[s]}
        if not more:
            return t
        full |= more


def test_mixing(spark, documents, nasty, empty):
    assert Mix(empty).taken().count() == 0
    small = spark.createDataFrame([(10**6 + i, "only a few words", None if i % 2 else "tiny") for i in range(6)], "doc_id long, text string, source string")
    docs = documents.select("doc_id", "text", "source").union(small).union(nasty.select("doc_id", "text", "source").filter("doc_id is not null"))
    rows = Mix(docs).taken().collect()
    assert len(rows) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = water_targets(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 128, (s, taken[s], want[s])
    again = Mix(docs.repartition(7)).taken().collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in rows) == Counter((r.doc_id, r["size"], r.taken) for r in again)


def test_slots_are_permutations_and_documents_follow_the_plan(spark, documents):
    m = Mix(documents, whole=True)
    for r in m.slots.join(m.plan.select("rank", "blocks"), "rank").groupBy("rank", "pass", "blocks").agg(F.count("*").alias("n"), F.count_distinct("block").alias("d"), F.max("block").alias("top")).collect():
        assert r.n == r.d <= r.blocks and r.top < r.blocks
    drawn = Mix(documents, shard_slots=64)
    counts = drawn.slots.groupBy("rank", "shard").count().join(drawn.draws, ["rank", "shard"]).collect()
    assert len({r.shard for r in counts}) > 5 and all(r["count"] == r.n for r in counts)
    assert drawn.draws.agg(F.sum("n")).first()[0] == drawn.plan.agg(F.sum("slots")).first()[0]
    words = {r.doc_id: r.taken for r in m.taken().collect()}
    mixed = defaultdict(int)
    docs = m.documents()
    assert docs.columns == documents.columns
    original = {r.doc_id: WORD.findall(r.text) for r in documents.collect()}
    for r in docs.collect():
        w = WORD.findall(r.text)
        mixed[r.doc_id] += len(w)
        assert r.n_chars == len(r.text) and not Counter(w) - Counter(original[r.doc_id])
    assert {d: n for d, n in words.items() if n} == dict(mixed)


def test_shards_hold_what_the_draw_gives_them(spark, documents):
    m = Mix(documents, shard_slots=64, whole=True)
    sources = {r.rank: r.source for r in m.plan.collect()}
    drawn = {(r.shard, sources[r["rank"]]): r.n for r in m.draws.collect()}
    held, every = Counter(), Counter()
    for r in m.documents(by_shard=True).collect():
        n = len(WORD.findall(r.text))
        held[r.output_shard, r.source] += n
        every[r.doc_id] += n
    assert every == Counter({r.doc_id: r.taken for r in m.taken().collect() if r.taken})
    for key, n in drawn.items():
        assert 64 * (n - 1) <= held[key] <= 64 * n or abs(held[key] - 64 * n) <= 64, key  # a source's last block is shorter
    per = Counter()
    for (shard, _), n in drawn.items():
        per[shard] += n
    assert len(per) > 5 and len(set(per.values())) > 1
    other = {(r.shard, sources[r["rank"]]): r.n for r in Mix(documents, shard_slots=64, seed=18).draws.collect()}
    assert other != drawn and {s: sum(n for (_, x), n in drawn.items() if x == s) for s in sources.values()} == {s: sum(n for (_, x), n in other.items() if x == s) for s in sources.values()}
    assert all((r.first_shard is None) == (r.taken == 0) for r in m.taken().collect())


def facts(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {x for x, n in Counter(windows).items() if n > 1}
    cover = {j for i, x in enumerate(windows) if x in twice for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_host_rules(spark, documents, nasty, empty):
    assert host_quality(empty).count() == 0
    docs = documents.select("doc_id", "text", "source").union(nasty.select("doc_id", "text", "source"))
    bad = spark.createDataFrame([(2 * 10**6 + i, "spam", "bad-host") for i in range(30)] + [(3 * 10**6, "fine words " + " ".join(f"w{i}" for i in range(40)), "bad-host")], "doc_id long, text string, source string")
    got = host_quality(docs.union(bad)).collect()
    want = Counter((r.doc_id, *facts(r.text)) for r in docs.union(bad).collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert not next(r for r in got if r.doc_id == 3 * 10**6).kept  # the host's verdict
    assert all(r.kept or r.base_failed for r in got if r.doc_id is not None and r.doc_id < 10**6)


def test_url_rules(spark, data):
    urls = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12", "x://a.b.org", "http://x.com/fr/", "http://x.com/de/2#a/b", "http://example.net/en/1", None, "nothing", "http://badorg/es/", "http://h?://z/y", "a\nb://c.org/\nd"]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, URL_RULES).collect()}
    assert got == {
        0: ("a.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("a.b.org", "", None, "allow"), 3: ("x.com", "/fr/", "com/fr/", "allow"),
        4: ("x.com", "/de/2", "com/de/", "block"), 5: ("example.net", "/en/1", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("badorg", "/es/", None, "allow"), 9: ("h", "", None, "allow"), 10: ("c.org", "/\nd", "org/", "allow"),
    }
    assert judge_urls(df.filter("page_id < 0"), URL_RULES).count() == 0
    hosts = [(i, f"http://spam.com/de/{i}") for i in range(60)] + [(100 + i, f"http://good{i}.com/fr/1") for i in range(60)] + [(200, "http://spam.com/en/"), (201, "http://good1.com/en/")]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(hosts, "page_id long, url string"), URL_RULES).collect()}
    assert (got[200], got[201]) == ("block", "allow")
