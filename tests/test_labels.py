"""Label search by its index against every label compared with every fragment."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parcelry.functions.fuzzy import ratio_of
from parcelry.operators import extraction as ex
from parcelry.operators.labels import TERMS, cleaned, label_matches, label_values, most_edits, pieces


def plain_match(fragment):
    text = fragment.strip(" ").lower().strip(".:()")
    if len(text) < 2 or not any("ऀ" <= ch <= "ॿ" for ch in text) and (sum(ch.isalpha() for ch in text) < 4 or not set(text) & set("aeiou")):
        return None, 0.0
    best = (None, 0.0)
    for label, field in TERMS:
        s = ratio_of(text, label)
        if s >= 85 and s > best[1]:
            best = (field, s)
    return best


def plain_values(parts):
    """Pairs of one line's segments, word by word."""

    def at_end(words, per_word, order):
        best = (None, 0.0, 0)
        for n in order(range(1, min(4, len(words)) + 1)):
            field, s = plain_match(" ".join(words[-n:]))
            if field and s + per_word * n > best[1] + per_word * best[2]:
                best = (field, s, n)
        return best

    if len(parts) < 2:
        return []
    out, (field, s, _) = [], at_end(parts[0].split(), 4.0, list)
    for part in parts[1:-1]:
        words = part.split()
        nxt, ns, n = at_end(words, 0.5, lambda r: list(r)[::-1])
        if field:
            out.append((field, s, " ".join(words[: len(words) - n])))
        field, s = nxt, ns
    return [*out, (field, s, parts[-1])] if field else out


def misread(r, text, edits):
    letters = list(text)
    for _ in range(edits):
        kind, i = r.randrange(3), r.randrange(len(letters) + 1)
        if kind == 0 and len(letters) > 1:
            letters.pop(i % len(letters))
        elif kind == 1:
            letters.insert(i, r.choice("aeiomtाक्🙂"))
        else:
            letters[i % len(letters)] = r.choice("aeiomtाक्")
    return "".join(letters)


def test_index_finds_what_comparing_all_finds(spark):
    r = random.Random(8)
    texts = [misread(r, label, e) for label, _ in TERMS for e in (0, 1, 2, 3, 5, 7)] + [misread(r, f"{r.choice(TERMS)[0]} {r.choice(TERMS)[0]}", 1) for _ in range(200)]
    texts += ["", "a", "नाम", "TA Te", "ab", "(Village:).", "x" * 500, "owner name"]
    df = spark.createDataFrame([(t,) for t in texts], "raw string").withColumn("fragment", cleaned(F.col("raw")))
    got = {x.fragment: (x.field_name, x.key_score) for x in label_matches(df.select("fragment").distinct()).collect()}
    matched = 0
    for x in df.collect():
        field, s = plain_match(x.raw)
        have = got.get(x.fragment, (None, 0.0))
        assert have[0] == field and abs(have[1] - s) < 1e-9, x.raw
        matched += field is not None
    assert matched > 400
    assert label_matches(df.select("fragment"), []).count() == 0


@pytest.mark.parametrize("n", range(1, 24))
def test_pieces_are_more_than_edits(n):
    edits, longest = most_edits(n)
    assert all(ratio_of("a" * n, "a" * n + "b" * k) < 85 for k in range(longest - n + 1, longest - n + 4))
    cut = pieces("abcdefghijklmnopqrstuvwx"[:n])
    assert "".join(p for _, p in cut) == "abcdefghijklmnopqrstuvwx"[:n] and (len(cut) == edits + 1 or n < 2)


def test_label_values_are_those_of_the_plain_search(spark):
    r = random.Random(5)
    lines = []
    for i in range(300):
        parts = []
        for _ in range(r.randint(1, 5)):
            words = [r.choice(["Rampur", "12/4", "राम", "of", "the", "0.5 ha"]) for _ in range(r.randint(0, 3))]
            parts.append(" ".join([*words, misread(r, r.choice(TERMS)[0], r.randint(0, 2))]).strip())
        parts.append(r.choice(["12", "Ram Lal", "खेत"]))
        lines.append((i // 7, i, 50.0, [p for p in parts if p]))
    df = spark.createDataFrame(lines, "document_id int, line_no int, conf double, segments array<string>")
    got = sorted((x.document_id, x.line_no, x.field_name, round(x.key_score, 6), x.raw) for x in label_values(df).collect())
    want = sorted((d, n, f, round(s, 6), v) for d, n, _, parts in lines for f, s, v in plain_values(parts))
    assert got == want and len(got) > 300


def test_equal_lines_count_once_and_odd_lines_give_nothing(spark):
    df = spark.createDataFrame([(1, 1, "Village : Rampur", 90.0), (1, 1, "Village : Rampur", 90.0), (None, None, "Village : Kolar", None), (2, 1, None, 1.0), (2, 2, "", 1.0), (2, 3, " : ", 1.0), (2, 4, ": x :", 1.0)], "document_id int, line_no int, line string, conf double")
    assert sorted((r.document_id is not None, r.value) for r in ex.candidates(df).collect()) == [(False, "Kolar"), (True, "Rampur")]
    assert ex.candidates(df.limit(0)).count() == 0


def test_values_by_kind(spark):
    cases = [
        ("plot_area", "०.62 (शून्य) हे", "0.62"), ("total_area", " 1,5 Acre. etc", "1.5 Acre"), ("irrigated_area", "none", "none"), ("record_date", "l2 - o3", "l2 - o3"), ("mutation_date", "०l - l२ - 19८7 ता", "01.12.1987"),
        ("registration_date", "12/3/99", "12/3/99"), ("record_year", "सन l987-88 का", "1987-88"), ("record_year", "abc", "abc"), ("village", "OM रामपुर xx", "रामपुर"), ("village", "TAX", "TAX"), ("owner_name", "Ram ___ Lal", "Ram Lal"),
        ("village", "रामपुर   उत्तर प्रदेश शासन", "रामपुर"), ("village", "राम, तहसील सदर", "राम"), ("remarks", "fine ★ seal", "fine"), ("remarks", None, None), ("remarks", "", ""),
    ]
    df = spark.createDataFrame([(i, f, r) for i, (f, r, _) in enumerate(cases)], "i int, f string, r string")
    got = {x.i: x.v for x in df.select("i", ex.value_of(F.col("f"), F.col("r")).alias("v")).collect()}
    assert [(cases[i], v) for i, v in got.items() if v != cases[i][2]] == []


def test_lines_are_never_broadcast(spark, monkeypatch):
    """A plan takes exploded lines for as small as the table they come from; Spark 4 then sent all of them to the driver."""
    from parcelry.operators import labels

    rows = [(i, 1, 90.0, ["Khasra No", f"{i}  Village", f"Ram{i}pur   Owner Name", "Person"]) for i in range(40)]
    lines = spark.createDataFrame(rows, "document_id int, line_no int, conf double, segments array<string>")
    got = {}
    for few in (50_000, 0):
        monkeypatch.setattr(labels, "FEW", few, raising=False)
        found = label_values(lines)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and ("BroadcastHashJoin" in plan) == (few > 0)
        got[few] = sorted(map(str, found.collect()))
    assert got[0] == got[50_000] and len(got[0]) == 120


def test_values_keep_their_digits_at_any_place(spark):
    """Segments lost what letters at their edges their place in the line had: "10" as the second one came out as "0"."""
    lines = [(i, 1, f"Khasra No : {k}  Village: Rampur   Owner Name : Person {c}", 90.0) for i, (k, c) in enumerate([("10", "474"), ("1", "4"), ("21", "104"), ("11", "44")])]
    got = sorted((r.document_id, r.field_name, r.value) for r in ex.candidates(spark.createDataFrame(lines, "document_id int, line_no int, line string, conf double")).collect())
    want = [(i, f, v) for i, (k, c) in enumerate([("10", "474"), ("1", "4"), ("21", "104"), ("11", "44")]) for f, v in (("khasra_number", k), ("owner_name", f"Person {c}"), ("village", "Rampur"))]
    assert got == want


def test_segments_are_the_parts_between_separators(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "1", "4", " ", " ", "   ", "\t", ":", ";", "|", "：", "ः", "-", "–", "=", "राम"]) for _ in range(r.randint(0, 24))) for _ in range(400)]
    sep = re.compile(r"[ \t]*[:;|：ः][ \t]*|[ \t]+[-–—=]+[ \t]*|[ \t]{3,}")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for x in df.select("i", ex.segments(F.col("t")).alias("s")).collect():
        want = [p.strip(" ") for p in sep.split(texts[x.i].strip(" ")) if p.strip(" ")]
        assert x.s == want or len(want) < 2 and len(x.s) == 2, texts[x.i]


@pytest.mark.parametrize("few", (50_000, 0))
def test_lines_that_differ_in_digits_are_looked_up_once(spark, monkeypatch, few):
    from parcelry.operators import labels

    asked, search = [], labels.label_matches
    monkeypatch.setattr(labels, "FEW", few)
    monkeypatch.setattr(labels, "label_matches", lambda fragments, *more: asked.append(fragments.count()) or search(fragments, *more))
    lines = [(i, 1, 90.0, ["8-अ" if i % 2 else "खाता नं", f"{i} {i * 7}/8  (Village)", f"४{i} \u00a0 ग्राम ", "\u00a0", f"x{i}"]) for i in range(100, 200)]
    df = spark.createDataFrame([*lines, lines[0], (None, None, None, lines[0][3])], "document_id int, line_no int, conf double, segments array<string>")
    got = sorted((x.document_id, x.line_no, x.field_name, round(x.key_score, 6), x.raw) for x in label_values(df).collect() if x.document_id)
    assert got == sorted((d, n, f, round(s, 6), v) for d, n, _, parts in lines for f, s, v in plain_values(parts))
    assert len(got) == 300 and asked[0] < 200


def test_a_title_ends_values_after_wide_letters(spark):
    df = spark.createDataFrame([(t,) for t in ("🙂🙂 राम खसरा 5", "🙂 Ram Record of Rights 5", "Ram form no 5", "खसरा", "Ram Lal\n", "Ram\n\nform no")], "t string")
    assert [x.v for x in df.select(ex.trimmed(F.col("t")).alias("v")).collect()] == ["🙂🙂 राम", "🙂 Ram", "Ram", "खसरा", "Ram Lal\n", "Ram form no"]
