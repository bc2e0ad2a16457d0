"""Vector codes, the Merkle manifest and token files against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelry.llm import vector_codes as vc
from parcelry.llm.addressable import SPAN, Codes, encoded
from parcelry.llm.manifest import manifest
from parcelry.llm.shared import fold
from parcelry.llm.token_files import ByteEncoder, write_tokens
from parcelry.llm.tokens import chunks

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int"


def plain_lloyd(z: np.ndarray, parts: int, entries: int, rounds: int):
    """Every distance in every round."""
    x = z.reshape(len(z), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]

    def nearest(p):
        d = ((x[:, p, None, :] - books[p][None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(parts):
            code = nearest(p)[0]
            for e in set(code.tolist()):
                books[p][e] = x[code == e, p].sum(0) // (code == e).sum()
    found = [nearest(p) for p in range(parts)]
    return ["".join(f"{f[0][i]:02x}" for f in found) for i in range(len(z))], sum(f[1] for f in found), np.stack(books)


def check_codes(rows, got, parts=8, entries=16, rounds=6):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, np.floor(np.array(r[1], np.float64) * 4096).tolist()))
    z = np.floor(np.array([r[1] for r in rows], np.float32).astype(np.float64) * 4096).astype(np.int64)
    codes, errors, books = plain_lloyd(z, parts, entries, rounds)
    assert np.array_equal(got.books, books)
    have = sorted((r.vec_id if r.vec_id is not None else -1, r.code, r.error) for r in got.rows.collect() if r.code is not None)
    assert have == sorted((r[0] if r[0] is not None else -1, c, e) for r, c, e in zip(rows, codes, errors.tolist(), strict=True))


@pytest.mark.parametrize("kind", ["spread", "lattice"])
def test_codes_are_those_of_plain_rounds(spark, kind):
    r = np.random.default_rng(4)
    z = r.normal(0, 0.2, (300, 16)) if kind == "spread" else r.integers(-1, 2, (300, 16)) / 4096  # a lattice: ties everywhere
    rows = [(int(i), [float(np.float32(v)) for v in row], int(i) % 3) for i, row in zip(r.permutation(3000)[:300], z, strict=True)]
    check_codes(rows, vc.compress(spark.createDataFrame(rows, VECTORS)))


def test_codes_of_odd_rows(spark):
    assert vc.with_label_errors(vc.compress(spark.createDataFrame([], VECTORS))).count() == 0
    good = [(5, [0.5, -0.25, 1e-5, -1e-5], 1), (5, [0.5, -0.25, 1e-5, -1e-5], 1), (5, [0.0] * 4, None), (None, [9.0, 9.0, -9.0, -9.0], None), (2, [1.0] * 4, 7)]
    bad = [(1, None, 1), (1, [0.0, None, 0.0, 0.0], 1), (1, [float("nan")] * 4, 1), (1, [float("inf"), 0.0, 0.0, 0.0], 1), (1, [float("-inf"), 0.0, 0.0, 0.0], 1)]
    other = [(8, [], 1), (9, [1.0, 2.0], 1), (10, [1.0, 2.0, 3.0], 7)]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(good + bad + other)], VECTORS + ", z int, code string")
    got = vc.compress(df, parts=2, entries=3, rounds=2)
    check_codes(good, got, 2, 3, 2)
    rows = vc.with_label_errors(got).collect()
    assert sorted(r.vec_id for r in rows if r.code is None) == [8, 9, 10] and len(rows) == 8
    of = {(r.vec_id, r.code): r for r in rows}
    assert len({r.label_error for r in rows if r.vec_id in (2, 10)}) == 1 and sum(r.error for r in of.values() if r.vec_id in (None,)) >= 0
    only = vc.compress(spark.createDataFrame([(1, [1.0], 1)], VECTORS))
    assert [tuple(r)[:3] for r in vc.with_label_errors(only).collect()] == [(1, None, None)]
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([(1, [1e12] * 8, 1)], VECTORS))


def test_bounds_save_scans_and_hold(spark):
    r = np.random.default_rng(9)
    centres = r.integers(-4000, 4000, (16, 8))
    x = (centres[r.integers(0, 16, 4000)] + r.integers(-300, 300, (4000, 8))).astype(np.int64)
    books = x[:16].copy()
    code, upper, lower = vc.scanned(x, books)
    scans = []
    for _ in range(6):
        after = np.stack([x[code == e].sum(0) // (code == e).sum() if (code == e).any() else books[e] for e in range(16)])
        code, upper, lower, n = vc.reassigned(x, code, upper, lower, vc.Move.of(books, after))
        books = after
        d = vc.distances(x, books)
        assert np.array_equal(code, d.argmin(1))
        own = d[np.arange(len(x)), code]
        d[np.arange(len(x)), code] = np.iinfo(np.int64).max
        assert (upper.astype(float) ** 2 >= own).all() and (np.maximum(lower, 0).astype(float) ** 2 <= d.min(1)).all()
        scans.append(n)
    assert scans[-1] < len(x) // 4


def test_decoded_vectors_are_near(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    codes = vc.compress(df)
    pairs = codes.decoded().alias("d").join(df.alias("v"), "vec_id").select(F.aggregate(F.zip_with("d.embedding", "v.embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("e"))
    errors = {r.vec_id: r.error for r in codes.rows.collect()}
    assert abs(pairs.agg(F.sum("e")).first()[0] * 4096**2 / sum(errors.values()) - 1) < 0.05


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, tampered):
    """rows: (doc_id, source, lang, n_chars, text)."""
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: h(*[cell(v) for v in (*r[:4], t)])
    groups = {}
    for r in rows:
        groups.setdefault((r[1] is not None, (r[1] or "").encode()), []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, tampered(r)), r[0]))

    def grow(nodes):
        """The root, and of each node what stands beside its way up."""
        at, sides = list(range(len(nodes))), [[] for _ in nodes]
        while len(nodes) > 1:
            for i, a in enumerate(at):
                run = nodes[a // 3 * 3 : a // 3 * 3 + 3]
                sides[i].append(("".join(run[: a % 3]), "".join(run[a % 3 + 1 :])))
            at = [a // 3 for a in at]
            nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        return nodes[0], sides

    names = sorted(groups)
    trees = {g: grow([x[2] for x in sorted(groups[g])]) for g in names}
    root, upper = grow([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, upper, strict=True):
        for x, own in zip(sorted(groups[g]), trees[g][1], strict=True):
            node, steps = x[3], own + up
            for a, b in steps:
                node = h(a, node, b)
            out.append((x[4], x[2], trees[g][0], root, h(*[a + b for a, b in steps]), node, node == root))
    return sorted(out, key=str)


def run_manifest(df, **more):
    now = F.when(fold(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted((tuple(r) for r in manifest(df, now, **more).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def tampered(r):
    return r[4].replace("\n", "") if r[4] is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0 else r[4]


@pytest.mark.parametrize("more", [{}, {"depth": 1, "top": 4}, {"depth": 1, "top": 1}, {"depth": 2, "top": 9}])
def test_manifest_is_the_plain_tree(spark, more):
    r = random.Random(2)
    names = [None, "", "a", "=b", "ü", "\U0001f642", "z", *[f"s{i}" for i in range(12)]]
    rows = [(r.choice([None, r.randrange(40)]), r.choice(names if i % 3 else names[:3]), r.choice([None, "en"]), r.choice([None, i]), r.choice([None, "", "a\nb\n", "é\n", "x" * 3000])) for i in range(150)]
    rows += [rows[0]] * 5
    df = spark.createDataFrame([(*x, i, "n") for i, x in enumerate(rows)], "doc_id long, source string, lang string, n_chars long, text string, idx int, node string")
    assert run_manifest(df.repartition(7), **more) == plain_manifest(rows, tampered)


def test_manifest_of_few_rows(spark, nasty, empty):
    rows = [(7, None, None, None, "one\n")]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    (got,) = run_manifest(spark.createDataFrame(rows, schema))
    assert got[1] == got[2] == got[3] and got[4] == h()
    assert run_manifest(empty.withColumn("n_chars", F.lit(1).cast("long"))) == []
    odd = nasty.withColumn("n_chars", F.lit(3).cast("long"))
    assert run_manifest(odd) == plain_manifest([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()], tampered)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1500), st.integers(0, 2**32 - 1)), max_size=1300), st.sampled_from([(10, 2, 4), (8, 8), (16,), (1, 1, 1), (3, 5, 8, 7)]))
def test_codes_give_any_number(numbers, widths):
    codes = Codes(encoded(np.array(numbers, np.uint32), widths))
    n = len(numbers)
    assert len(codes) == n and codes.slice(0, n).tolist() == numbers
    for i in {0, 1, n // 2, n - 1, SPAN - 1, SPAN, SPAN + 1} & set(range(n)):
        assert codes[i] == numbers[i]
        assert codes.slice(i, i + 37).tolist() == numbers[i : i + 37]
    with pytest.raises(IndexError):
        codes[n]


def test_a_number_needs_no_others():
    """All chunks before and behind a number are spoilt: it reads the same."""
    numbers = np.random.default_rng(1).integers(0, 50257, 4000).astype(np.uint32)
    codes = Codes(encoded(numbers))
    level = codes.levels[0]
    level.chunks = level.chunks.copy()
    level.chunks[: 1234 * 10 // 8 - 4] = 0
    level.chunks[1234 * 10 // 8 + 4 :] = 0
    assert codes[1234] == numbers[1234]
    assert len(encoded(numbers % 1000)) < 2 * len(numbers)
    with pytest.raises(ValueError):
        Codes(b"something else")


ODD = ["'s", "'t", "'RE", "é", "ß", "İ", "ﬁ", "́", "×", "½", "_", "\x1c", "\x85", "\xa0", " ", "　", "中文", "हिन्दी", "\t\n", "\n\n", ".,", "$%#", "<|endoftext|>", "<|", "abc", "XYZ", "12", " ", "  ", "\n", "\r", "🙂", " the", "’"]


def test_byte_encoder_equals_the_tokenizer_on_whole_texts(documents):
    r = random.Random(3)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["".join(r.choice(["a", " ", "\n", "1", "."]) for _ in range(12)) for _ in range(1500)]
    texts += [x.text for x in documents.limit(60).collect()] + [None, "", " ", "\n", "  \n a", "x" * 100_000, " \n" * 5000]
    e, t = ByteEncoder(PATH, 0), tokenizers.Tokenizer.from_file(PATH)
    got = [ids.tolist() for c in chunks(pa.array(texts), 1 << 14) for ids in e.encode(c)]
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []


@pytest.mark.parametrize("least", [1, 500, 1 << 18])
def test_token_files_hold_all_ids_in_order(spark, documents, nasty, empty, least):
    assert write_tokens(empty, PATH).documents().count() == 0
    docs = documents.limit(50).withColumn("doc_id", F.col("doc_id") + 100).select("doc_id", "text").union(nasty.select("doc_id", "text"))
    files = write_tokens(docs.withColumn("segment", F.lit(1)).withColumn("range", F.lit("x")), PATH, least=least)
    rows = sorted(files.documents().collect(), key=lambda r: r.start)
    assert [r.doc_id is not None and r.doc_id for r in rows] == sorted((r.doc_id is not None and r.doc_id for r in docs.collect()), key=lambda x: x or 0)
    t = tokenizers.Tokenizer.from_file(PATH)
    want, at, every = {}, 0, []
    for x in docs.collect():
        ids = [*t.encode(x.text or "", add_special_tokens=False).ids, 0]
        want.setdefault((x.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), []).append(ids)
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        every += want[r.doc_id, r.n_tokens, r.ids_crc32].pop()
    assert not any(want.values())
    places = [0, 1, 17, at // 2, at - 1, at, 17]
    got = files.ids_at(spark.createDataFrame([(p, "k") for p in places], "place long, code string")).collect()
    assert sorted((r.place, r.id if r.id is not None else -1) for r in got) == sorted((p, every[p] if p < at else -1) for p in places)
