"""Quality rules with host-level verdicts, in DataFrame functions only.

Per document: counts of words, symbols, repeated lines and repeated 8-word windows, all inside one row, so nothing
is shuffled for them. Per host (the documents' source): the rate of documents that fail a rule, shrunk with an empirical
beta prior, decides whether the host's remaining documents stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.llm.shared import WORD, saved, words

SYMBOLS = r"[#*$%&|<>]"


def _window_hashes(w: Column, k: int) -> Column:
    """A hash of each k consecutive words, by position."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame, k: int = 8) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    one = docs.withColumns({"_words": words(F.col("text")), "_lines": lines})
    two = one.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS + "+", ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": _window_hashes(F.col("_words"), k),
        }
    ).drop("_words", "_lines")
    # Most texts repeat no window: only the others are sorted.
    three = two.withColumn("_at", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_hashes")
    four = three.withColumn(
        "_twice",
        F.sort_array(
            F.transform(
                F.filter(
                    F.transform("_at", lambda x, j: F.struct(x["i"].alias("i"), (F.coalesce(F.get("_at", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_at", j + 1)["h"] == x["h"], F.lit(False))).alias("t"))),
                    lambda y: y["t"],
                ),
                lambda y: y["i"],
            )
        ),
    ).drop("_at")
    cover = F.aggregate(
        F.transform("_twice", lambda i, j: F.least(F.lit(k), F.coalesce(F.get("_twice", j + 1) - i, F.lit(k)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return four.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long"))).drop("_twice")


def base_failed(min_words: int = 20, repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def rule_failed() -> Column:
    """A document fails some rule: the base rules, one symbol in ten word characters, or half its lines repeated."""
    return base_failed() | (10 * F.col("n_symbols") > F.col("word_chars")) | (2 * F.col("n_dup_lines") > F.col("n_lines"))


def host_rates(failures: DataFrame, limit: float) -> DataFrame:
    """host, rejected from one row per host with bad and n.

    The empirical beta prior has the mean m of all documents and the strength s that the spread of the hosts' rates
    gives by moments (between 1 and 10000); the shrunken rate is (bad + m s) / (n + s).
    """
    m = F.sum("bad") / F.sum("n")
    v = (F.sum(F.col("bad") * F.col("bad") / F.col("n")) - F.sum("n") * m * m) / F.sum("n")
    prior = failures.agg(m.alias("m"), v.alias("v"))
    s = F.when((F.col("v") > 0) & (F.col("m") > 0) & (F.col("m") < 1), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(1.0))
    prior = prior.select("m", F.least(F.greatest(s, F.lit(1.0)), F.lit(10000.0)).alias("s"))
    rate = (F.col("bad") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))
    return failures.join(F.broadcast(prior)).select("host", rate.alias("host_rate"), (rate > limit).alias("rejected"))  # prior: one row


def host_quality(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; one row per row of docs.

    A null text has no words and so fails; a null host is a host of its own. An empty table gives no rows. Repeated rows
    are judged each. The measured counts are written once, since both the host rates and the result need them.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    facts = saved(
        measured(docs.select("doc_id", "text", F.col(host).alias("host")))
        .select("doc_id", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")).alias("host"), *counts, base_failed().alias("base_failed"), rule_failed().alias("_failed")),
        "host-rule-facts",
    )
    failures = facts.groupBy("host").agg(F.sum(F.col("_failed").cast("long")).alias("bad"), F.count("*").alias("n"))
    verdicts = saved(host_rates(failures, limit).select("host", "rejected"), "host-verdicts")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("rejected"), F.lit(False))
    return facts.join(verdicts, "host", "left").select("doc_id", *counts, "base_failed", kept.alias("kept"))
