"""The registered queries of this subpackage: one opN_<name> for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.llm.shared import fold, read

URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.near_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), width=5, least=0.8)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.substring_dedup import Repeats

    return Repeats(read(spark, sf_dir, "documents"), k=20).cut()


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from parcelry.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.language_id import identify

    return identify(read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2)


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.quality_model import score_quality

    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) == 1)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(read(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.html_text import extract_pages

    return extract_pages(read(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.mixing import Mix

    return Mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).taken().select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.host_rules import host_quality

    return host_quality(read(spark, sf_dir, "documents"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.url_reputation import judge_urls

    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.vector_codes import compress, with_label_errors

    return with_label_errors(compress(read(spark, sf_dir, "embeddings")))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.manifest import manifest

    tampered = F.when(fold(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(read(spark, sf_dir, "documents"), tampered)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from parcelry.llm.token_files import write_tokens

    return write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).documents()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_near_dedup, op2_substring_dedup, op3_packing, op4_language_id, op5_fingerprints, op6_quality_model, op7_html_text, op8_mixing, op9_host_rules, op10_url_reputation)
    return {f.__name__: f for f in (*found, op11_vector_codes, op12_manifest, op13_token_files)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), w AS (SELECT doc_id, len(ws) AS n, ws, unnest(range(1, len(ws) + 1)) AS p FROM d),
x AS (SELECT doc_id, n, p, ws[p] AS word, CASE WHEN p + 19 <= n THEN array_to_string(ws[p:p + 19], ' ') END AS win FROM w),
f AS (SELECT win, min((doc_id, p)) AS first FROM x WHERE win IS NOT NULL GROUP BY win),
r AS (SELECT x.doc_id, p, word, CASE WHEN x.win IS NOT NULL AND first < (x.doc_id, p) THEN 1 ELSE 0 END AS late FROM x LEFT JOIN f ON x.win = f.win),
c AS (SELECT doc_id, p, word, max(late) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

_HOST_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('h' || source, '') AS host, {_WORDS} AS ws FROM documents),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY r),
w AS (SELECT r, p, array_to_string(ws[p:p + 7], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS p FROM d)),
t AS (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS next FROM (SELECT r, p, count(*) OVER (PARTITION BY r, win) AS c FROM w) WHERE c > 1),
c AS (SELECT r, sum(least(8, coalesce(next - p, 8)))::BIGINT AS covered FROM t GROUP BY r),
m AS (SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(covered, 0) AS n_repeat_words FROM d LEFT JOIN l USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT host, sum((base_failed OR 10 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines)::BIGINT)::DOUBLE AS bad, count(*)::DOUBLE AS n FROM b GROUP BY host),
p AS (SELECT sum(bad) / sum(n) AS m, (sum(bad * bad / n) - sum(n) * (sum(bad) / sum(n)) * (sum(bad) / sum(n))) / sum(n) AS v FROM h),
q AS (SELECT m, least(greatest(CASE WHEN v > 0 AND m > 0 AND m < 1 THEN m * (1 - m) / v - 1 ELSE 1 END, 1), 10000) AS s FROM p),
e AS (SELECT host, (bad + m * s) / (n + s) > 0.5 AS rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept FROM b LEFT JOIN e USING (host)"""


def _url_sql() -> str:
    ordered = sorted(URL_RULES, key=lambda r: (-len(r[1]), -r[1].find("/"), r[0] == "allow"))
    fits = [(f"(host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '{r[r.find('/'):]}')", v, r) for v, r in ordered]
    rule, verdict = ("CASE " + " ".join(f"WHEN {c} THEN '{x[i]}'" for c, *x in fits) + " END" for i in (1, 0))
    strength = "least(greatest(CASE WHEN v > 0 AND m > 0 AND m < 1 THEN m * (1 - m) / v - 1 ELSE 1 END, 1), 1000)"
    level = "SELECT coalesce(sum(bad) / sum(n), 0.5) AS m, coalesce((sum(bad * bad / n) - sum(n) * (sum(bad) / sum(n)) * (sum(bad) / sum(n))) / sum(n), 0) AS v FROM {} WHERE n > 0"
    parts = r"'^(?s:.*?)://([^/?#]*)([^?#]*)'"
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, {parts}, 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, {parts}, 2), '') AS path FROM pages),
j AS (SELECT *, {rule} AS rule, {verdict} AS by_rule FROM u),
h AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix, count(*) FILTER (by_rule = 'block')::DOUBLE AS bad, count(by_rule)::DOUBLE AS n FROM j GROUP BY host),
d AS (SELECT suffix, domain, sum(bad) AS bad, sum(n) AS n FROM h GROUP BY ALL), s AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM d GROUP BY suffix),
t1 AS ({level.format("s")}), t2 AS ({level.format("d")}), t3 AS ({level.format("h")}),
sr AS (SELECT suffix, (bad + m * {strength}) / (n + {strength}) AS sm FROM s, t1), dr AS (SELECT domain, (bad + sm * {strength}) / (n + {strength}) AS dm FROM d JOIN sr USING (suffix), t2),
hr AS (SELECT host, (bad + dm * {strength}) / (n + {strength}) AS rate, n + {strength} AS total FROM h JOIN dr USING (domain), t3)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN hr USING (host)"""


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round written out: distances to all entries, the first of the nearest, floors of means."""
    near = "SELECT r, p.part, p.x, arg_min(c.entry, (d, c.entry)) AS entry, min(d) AS d FROM (SELECT p.*, c.entry, list_sum([(a[1] - a[2]) * (a[1] - a[2]) for a in list_zip(p.x, c.x)])::BIGINT AS d FROM p JOIN c{k} c ON p.part = c.part) p GROUP BY ALL"
    near = near.replace("p.part, p.x", "part, x").replace("c.entry, (d, c.entry)", "entry, (d, entry)")
    mean = "SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS x FROM (SELECT part, entry, i, CAST(floor(sum(v)::DOUBLE / count(*)) AS BIGINT) AS m FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL) m ON c.part = m.part AND c.entry = m.entry"
    steps = "".join(f", a{k} AS MATERIALIZED ({near.format(k=k)}), c{k + 1} AS MATERIALIZED ({mean.format(k=k)})" for k in range(rounds))
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, [CAST(floor(x::DOUBLE * 4096) AS BIGINT) for x in embedding] AS z FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT r, part, z[part * (len(z) // {parts}) + 1:(part + 1) * (len(z) // {parts})] AS x FROM v, range({parts}) t(part)),
c0 AS (SELECT part, r AS entry, x FROM p WHERE r < {entries}){steps}, a{rounds} AS MATERIALIZED ({near.format(k=rounds)}),
s AS (SELECT r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN s USING (r), b"""


_MANIFEST_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{t}")) + ")"
_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, [ascii(x)::UBIGINT for x in string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::UBIGINT for i in range(8)]), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::UBIGINT) ELSE y // 2 END))"

_MANIFEST = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, coalesce('=' || source, '') AS g, doc_id, {_MANIFEST_LEAF.format(t="text")} AS leaf,
  CASE WHEN xor({_CRC}, 4294967295::UBIGINT) % 2 = 0 THEN {_MANIFEST_LEAF.format(t="replace(text, chr(10), '')")} ELSE {_MANIFEST_LEAF.format(t="text")} END AS now FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT g, 0 AS level, idx, n, leaf AS h FROM o UNION ALL SELECT g, level + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY g, level, idx // 3),
s AS (SELECT g, h AS subroot, level, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, place AS idx, n, subroot AS h FROM s UNION ALL SELECT level + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 3),
w AS (SELECT g, level, idx, h FROM t WHERE n > 1 UNION ALL SELECT s.g, s.level + u.level, u.idx, u.h FROM s, u WHERE u.n > 1),
f AS (SELECT r, o.g, o.idx AS at, o.now AS h, 0 AS level, '' AS proof FROM o UNION ALL
  SELECT r, g, up, sha256(coalesce(b, '') || h || coalesce(a, '')), level + 1, proof || coalesce(b, '') || coalesce(a, '') FROM (
    SELECT f.r, any_value(f.g) AS g, any_value(CASE WHEN f.level + 1 = s.level THEN s.place ELSE f.at // 3 END) AS up, any_value(f.h) AS h, any_value(f.level) AS level, any_value(f.proof) AS proof,
      string_agg(w.h, '' ORDER BY w.idx) FILTER (w.idx < f.at) AS b, string_agg(w.h, '' ORDER BY w.idx) FILTER (w.idx > f.at) AS a
    FROM (SELECT f.r, f.g, CASE WHEN f.level = 0 AND s.level = 0 THEN s.place ELSE f.at END AS at, f.h, f.level, f.proof FROM f JOIN s ON f.g = s.g) f JOIN s ON f.g = s.g JOIN w ON w.g = f.g AND w.level = f.level AND w.idx // 3 = f.at // 3 GROUP BY f.r)),
e AS (SELECT r, h AS folded_root, proof FROM f QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = u.h AS verified FROM o JOIN s ON o.g = s.g JOIN e ON o.r = e.r, u WHERE u.n = 1"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the result; tests/llm holds the others against brute force, round trips and held-out rows."""
    return {"op2_substring_dedup": _SUBSTRINGS, "op9_host_rules": _HOST_RULES, "op10_url_reputation": _url_sql(), "op11_vector_codes": _vector_codes_sql(), "op12_manifest": _MANIFEST}
