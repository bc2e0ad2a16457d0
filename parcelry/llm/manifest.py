"""Merkle dataset manifest: one root over all rows, and for each row a proof that leads from it to the root.

Rows are ranked within their group by one range shuffle of small rows (ids and digests; texts are read once and not moved). Large blocks
of 3^depth leaves in a row each become one node, in tasks. Blocks of blocks follow until few nodes are left: the top tree. The
driver builds that and broadcasts what is missing to each of its nodes' proofs, the suffix paths; executors finish the proofs, and fold each
row, as it is now, along its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelry.llm.shared import discard, large_rows, saved

FAN = 3
#: Groups are named so that null comes first and the rest in order of bytes.
ITEM = "struct<idx:long,doc_id:long,child:string,node:string,now:string>"
BLOCK = f"g string, block long, n long, node string, items array<{ITEM}>"
OPEN = "g string, block long, subroot string, root string, path array<string>"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n nodes."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from the given ones on."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(*below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return out


def path(levels: list[list[str]], i: int) -> list[str]:
    """What stands before and after a node in its run, level by level."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[i - i % FAN : i - i % FAN + FAN]
        out += ["".join(run[: i % FAN]), "".join(run[i % FAN + 1 :])]
        i //= FAN
    return out


def folded(node: str, steps: list[str]) -> str:
    """The root that a node and the nodes beside its way up give."""
    for before, after in zip(steps[::2], steps[1::2], strict=True):
        node = digest(before, node, after)
    return node


def leaf(columns: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of the values, each with its length in bytes; null is a dash."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in columns]).cast("binary"), 256)


def ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """rows with idx, their place within g (from 0), and n, the rows of g; and the saved tables that they come from.

    Rows are sorted by ranges, so a group may span many tasks. Where a range begins within its group is a sum over the ranges before; of those counts there is one row per
    range and group.
    """
    at = F.col("_at")
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order, "_row")]
    held = saved(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id()), "manifest-ranked")
    t = held.withColumn("_range", F.shiftright(at, 33))
    w = W.partitionBy("g")
    runs = t.groupBy("g", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_many"))
    before = F.coalesce(F.sum("_many").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = saved(runs.select("g", "_range", (before - F.col("_first")).alias("_shift"), F.sum("_many").over(w).alias("n")), "manifest-runs")
    return t.join(runs, ["g", "_range"]).withColumn("idx", at + F.col("_shift")).drop("_at", "_range", "_shift"), [held, runs]


def _reduced(depth: int):
    """The node of each block, after as many levels as its group has, at most depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column(3)
            nodes, ends = items.flatten().field("node").to_pylist(), items.value_lengths().to_pylist()
            made, at = [], 0
            for many, n in zip(ends, b.column(2).to_pylist(), strict=True):
                made.append(climb(nodes[at : at + many], min(depth, height(n)))[-1][0])
                at += many
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.string()), items], ["g", "block", "n", "node", "items"])

    return run


def blocks(rows: DataFrame, depth: int, held: list[DataFrame] | None = None) -> DataFrame:
    """Rows (g, idx, n, doc_id, child, node, now) in blocks of 3^depth, with each block's node; held goes thereafter."""
    block = F.floor(F.col("idx") / F.lit(FAN**depth)).cast("long")
    item = F.struct("idx", "doc_id", "child", "node", "now")
    per = rows.groupBy("g", block.alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))  # 3^depth items at most
    made = saved(per.select("g", "block", "n", F.col("items").cast(f"array<{ITEM}>")).mapInArrow(_reduced(depth), BLOCK), "manifest-blocks")
    discard(*held or [])
    return made


@dataclass
class Level:
    """A table of blocks; whether its items are whole groups of the level below, rather than blocks of one."""

    table: DataFrame
    of_groups: bool


def _top(nodes: list, depth: int, of_groups: bool) -> dict[tuple[str, int], tuple[str | None, str, list[str]]]:
    """Of the top nodes (g, block, n, node): subroot, root and path from each on. of_groups: g is the one group of all subroots."""
    groups: dict[str, list] = {}
    for r in sorted(nodes, key=lambda r: (r.g.encode(), r.block)):
        groups.setdefault(r.g, []).append(r)
    trees = {g: climb([r.node for r in rs], height(rs[0].n) - min(depth, height(rs[0].n))) for g, rs in groups.items()}
    sub = [t[-1][0] for t in trees.values()]
    upper = climb(sub, 0 if of_groups else height(len(sub)))
    root = upper[-1][0]
    return {(r.g, r.block): (None if of_groups else sub[k], root, path(trees[g], i) + path(upper, k)) for k, (g, rs) in enumerate(groups.items()) for i, r in enumerate(rs)}


def _opened(depth: int, level_of_groups: bool, leaves: bool, known):
    """Finishes proofs within blocks: for each item its subroot, the root and the path from it on; for leaves the proof and the fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                sub, root, rest = known.value[row["g"], row["block"]] if known is not None else (row["subroot"], row["root"], row["path"])
                items = row["items"]
                levels = climb([x["node"] for x in items], min(depth, height(row["n"])))
                steps = [path(levels, i) + rest for i in range(len(items))]
                subs = [x["node"] if level_of_groups else sub for x in items]
                if leaves:
                    cells = [[x["doc_id"] for x in items], [x["node"] for x in items], subs, [root] * len(items), [digest(*s) for s in steps], [folded(x["now"] or x["node"], s) for x, s in zip(items, steps, strict=True)]]
                    kinds = [pa.int64(), *[pa.string()] * 5]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])
                else:
                    cells = [[x["child"] if level_of_groups else row["g"] for x in items], [0 if level_of_groups else x["idx"] for x in items], subs, [root] * len(items), steps]
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["g", "block", "subroot", "root", "path"])

    return run


def manifest(docs: DataFrame, now: Column, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", depth: int = 6, top: int = 3**8) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    A leaf is the digest of a row's columns. In each group leaves stand by doc_id; groups stand in order of bytes. folded_root comes from the row with `now` as its text and the
    untouched nodes beside its way up; verified tells whether that is the root. The last of columns is the text.

    A null group is a group of its own, before all others; a null doc_id stands before all others of its group, and rows that share one stand in order of
    their leaves. Rows that repeat are leaves each for itself. An empty table gives no rows. Extra columns are ignored. top bounds what the driver holds and broadcasts (13 MB of paths at 3^8
    nodes): beyond it, blocks of blocks are reduced in tasks, and where groups alone are more, their subroots, too.
    """
    *head, text = columns
    large_rows(docs.sparkSession)
    own = [F.col(c) for c in head]
    changed = ~now.eqNullSafe(F.col(text))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("child"),
        leaf([*own, F.col(text)]).alias("node"), F.when(changed, leaf([*own, now])).alias("now"),
    )
    leaves = saved(rows, "manifest-leaves")
    order, held = ranked(leaves, ["doc_id", "node"])
    levels = [Level(blocks(order, depth, [leaves, *held]), False)]
    while (last := levels[-1]).table.count() > top:
        t = last.table
        step = FAN**depth
        more = F.when(F.col("n") > step, F.ceil(F.col("n") / step)).otherwise(F.lit(1)).cast("long")
        up = t.select("g", F.col("block").alias("idx"), more.alias("n"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("child"), "node", F.lit(None).cast("string").alias("now"))
        if t.filter(F.col("n") > step).isEmpty():
            each = up.withColumns({"child": F.col("g"), "g": F.lit("")}).drop("idx", "n")
            order, held = ranked(each, ["child"])
            levels.append(Level(blocks(order, depth, held), True))
        else:
            levels.append(Level(blocks(up, depth), False))
    of_groups = any(x.of_groups for x in levels)
    nodes = levels[-1].table.select("g", "block", "n", "node").collect()  # top rows at most
    known = docs.sparkSession.sparkContext.broadcast(_top(nodes, depth, of_groups) if nodes else {})
    found = None
    for k in range(len(levels) - 1, -1, -1):
        t = levels[k].table
        schema = PROOF if k == 0 else OPEN
        t = t if found is None else t.join(found, ["g", "block"]).select("g", "block", "n", "node", "items", "subroot", "root", "path")
        found = t.mapInArrow(_opened(depth, levels[k].of_groups, k == 0, known if found is None else None), schema)
        found = found if k == 0 else saved(found, "manifest-paths")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
