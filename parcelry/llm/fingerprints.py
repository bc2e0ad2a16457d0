"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

Phrases (a few words, cut at punctuation) are the leaves; lines are paragraphs; a section ends at a blank line, or after
a paragraph whose digest says so, so an edit moves no boundary but its own. A node's digest is that of its
children's digests. Equal roots mean equal texts; from unequal roots, unequal branches lead to the edit. The printed
fingerprint is the root and the whole tree with shortened leaves, so two fingerprints alone tell where texts differ and how
much they share, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b64encode
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.llm.shared import small_batches

_LEAF = re.compile(r"[^\s.,;:!?|]+(?:[^\S\n]+[^\s.,;:!?|]+){0,3}[^\S\n]*[.,;:!?|]*[^\S\n]*|[^\S\n]*[.,;:!?|]+[^\S\n]*|[^\S\n]+")
#: Characters of a leaf in a printed fingerprint, six bits each.
DIGITS = 6
FEWEST, SECTION = 3, 8
LOWEST = -(1 << 63)


def leaf_spans(paragraph: str) -> list[str]:
    """The phrases of a paragraph; joined, they are the paragraph."""
    return _LEAF.findall(paragraph)


def tree(text: str) -> dict:
    """root (hex), sections: list of (digest, [(paragraph digest, [leaf digest, ...]), ...])."""
    sections: list[tuple[bytes, list[tuple[bytes, list[bytes]]]]] = []
    current: list[tuple[bytes, list[bytes]]] = []

    def close() -> None:
        if current:
            sections.append((hashlib.blake2b(b"s" + b"".join(d for d, _ in current), digest_size=16).digest(), current[:]))
            current.clear()

    digest = xxhash.xxh3_128_digest
    for line in text.split("\n"):
        leaves = [digest(x.encode("utf-8", "surrogatepass")) for x in _LEAF.findall(line)]
        d = hashlib.blake2b(b"p" + b"".join(leaves), digest_size=16).digest()
        current.append((d, leaves))
        if not line or len(current) >= FEWEST and d[0] % SECTION == 0:
            close()
    close()
    return {"root": hashlib.sha256(b"r" + b"".join(d for d, _ in sections)).hexdigest(), "sections": sections}


def printed(t: dict) -> str:
    """root:section;section..., a section being paragraph,paragraph..., a paragraph its leaves in a row."""
    short = lambda leaf: b64encode(leaf[:6], b"-_")[:DIGITS].decode()
    return t["root"] + ":" + ";".join(",".join("".join(map(short, leaves)) for _, leaves in ps) for _, ps in t["sections"])


def parsed(fingerprint: str) -> tuple[str, list[tuple[str, ...]]]:
    """The root and the sections, each with its paragraphs as strings of leaves."""
    root, _, rest = fingerprint.partition(":")
    return root, [tuple(section.split(",")) for section in rest.split(";")]


def likeness(a: str, b: str) -> float:
    """The share of common leaves of two fingerprints, 1 if the roots are equal and else below.

    Equal branches are taken as a whole, from sections to paragraphs; only leaves under unequal ones are compared. Leaves and
    branches count as often as they occur.
    """
    (root_a, sections_a), (root_b, sections_b) = parsed(a), parsed(b)
    if root_a == root_b:
        return 1.0
    size = lambda paragraphs: sum(map(len, paragraphs)) // DIGITS
    total = sum(map(size, sections_a)) + sum(map(size, sections_b))
    common = 0

    def matched(left: Counter, right: Counter, worth) -> tuple[Counter, Counter]:
        nonlocal common
        both = left & right
        common += sum(worth(x) * n for x, n in both.items())
        return left - both, right - both

    flat = lambda groups: Counter(x for group in groups.elements() for x in group)
    left, right = matched(Counter(sections_a), Counter(sections_b), size)
    left, right = matched(flat(left), flat(right), lambda p: len(p) // DIGITS)
    leaves = lambda groups: Counter(p[i : i + DIGITS] for p in groups.elements() for i in range(0, len(p), DIGITS))
    matched(leaves(left), leaves(right), lambda leaf: 1)
    return min(common / (total - common), 1 - 1 / (total + 1)) if total else 0.0


def differing(a: str, b: str) -> tuple[int, int, int]:
    """Where fingerprint a departs from b: the first unequal section and paragraph of a, and how many of its paragraphs lie up to the
    last unequal one; (0, 0, 0) if the roots are equal.

    Branches are compared by place from both ends, so a repeated, moved or removed paragraph shows, too.
    """
    (root_a, sections_a), (root_b, sections_b) = parsed(a), parsed(b)
    if root_a == root_b:
        return 0, 0, 0

    def between(x: list, y: list) -> tuple[int, int]:
        """How many at the start are equal, and how many more at the end."""
        n = min(len(x), len(y))
        start = next((i for i in range(n) if x[i] != y[i]), n)
        return start, next((i for i in range(n - start) if x[-1 - i] != y[-1 - i]), n - start)

    start, end = between(sections_a, sections_b)
    inner_a, inner_b = ([p for s in x[start : len(x) - end] for p in s] for x in (sections_a, sections_b))
    first, last = between(inner_a, inner_b)
    section, paragraph = start, first
    while section < len(sections_a) - 1 and paragraph >= len(sections_a[section]):
        paragraph -= len(sections_a[section])
        section += 1
    return section, paragraph, len(inner_a) - first - last


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_section long, edit_paragraph long, edit_paragraphs long"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and document; each is emitted when its successor in the bucket is there."""
    before = None  # bucket, doc_id, text, root, sketch, and whether it is emitted here
    names = [x.split()[0] for x in OUT.split(", ")]
    for batch in batches:
        rows = []
        for bucket, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            text = text.as_py()
            t = tree(text)
            now = (bucket, extra, doc_id, text, printed(t))
            if before is not None and before[0] == bucket and not before[1]:
                _, _, was_id, was, fingerprint = before
                k = len(was) // 4
                edited = was[: len(was) - k] + text[:k]
                other = printed(tree(edited))
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((None if was_id == LOWEST else was_id, len(was), sha, fingerprint, other, likeness(fingerprint, other), likeness(fingerprint, now[4]), *differing(fingerprint, other)))
            before = now
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def fingerprint_edits(docs: DataFrame, bucket_rows: int = 1024, buckets_max: int = 8192) -> DataFrame:
    """Fingerprints of each text and of its edited text (the last quarter replaced from the next document), and likenesses.

    The documents are dealt by ranges of doc_id: the range edges are ids that exist (a bounded list), and the document at an edge goes
    to the range before it, too, as the successor of its last document; the first document also ends the last range.
    Texts are shuffled once and streamed through sorted, so a range needn't fit in memory.

    A null text is empty; a null doc_id comes first. Rows with equal doc_id follow each other by text. One row is its own
    successor. An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    n = rows.count()
    if n == 0:
        return docs.sparkSession.createDataFrame([], OUT)
    parts = max(1, min(buckets_max, -(-n // bucket_rows)))
    wanted = [i / parts for i in range(1, parts)]
    first, found = rows.agg(F.min("doc_id"), F.percentile_approx("doc_id", wanted, 10 * parts) if wanted else F.lit(None)).first()
    edges = np.array(sorted({e for e in found or [] if e > first}), np.int64)

    @F.pandas_udf("long")
    def bucket_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, doc_id.to_numpy(), side="right"))

    at = rows.withColumn("b", bucket_of("doc_id"))
    on_edge = F.lit(False) if not len(edges) else F.col("doc_id").isin([int(e) for e in edges])
    last = len(edges)
    places = F.array_compact(
        F.array(
            F.struct(F.col("b").alias("bucket"), F.lit(0).alias("extra")),
            F.when(on_edge, F.struct((F.col("b") - 1).alias("bucket"), F.lit(1).alias("extra"))),
            F.when(F.col("doc_id") == F.lit(first), F.struct(F.lit(last).cast("long").alias("bucket"), F.lit(2).alias("extra"))),
        )
    )
    dealt = at.withColumn("p", F.explode(places)).select("p.bucket", "p.extra", "doc_id", "text").repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "extra", "doc_id", "text").mapInArrow(_compared, OUT)
