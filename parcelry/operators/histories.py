"""Histories of status changes: the status after a list of attempts, in order, where each is allowed or refused.

What a run of attempts does is a map from each of the eight states to the state after it, with how many attempts each would see refused. Two such maps
make one, and in whatever way a history is cut the result is the same: so histories are cut where ranges of sorted rows end, each piece is folded in its task, and a document's few maps are put together last. No task holds
a history, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from parcelry.functions.constants import STATUSES
from parcelry.operators.verify import TRANSITIONS

START = STATUSES[0]


def _steps() -> np.ndarray:
    """By attempt (the last one: any other value) and state before: the state after."""
    after = np.tile(np.arange(len(STATUSES)), (len(STATUSES) + 1, 1))
    for before, wanted in TRANSITIONS:
        after[STATUSES.index(wanted), STATUSES.index(before)] = STATUSES.index(wanted)
    return after


def _refusals() -> np.ndarray:
    """By attempt and state before: 1 where the attempt is refused."""
    allowed = np.zeros((len(STATUSES) + 1, len(STATUSES)), np.int64)
    for before, wanted in TRANSITIONS:
        allowed[STATUSES.index(wanted), STATUSES.index(before)] = 1
    return 1 - allowed


def attempt_number(wanted: Column) -> Column:
    """The place of a status among all; one more for anything else."""
    return F.coalesce(*[F.when(wanted == s, F.lit(i)) for i, s in enumerate(STATUSES)], F.lit(len(STATUSES)))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of rows with one key its map; a run may go on in the next batch."""
    steps, refusals, part = _steps(), _refusals(), TaskContext.get().partitionId()
    key, after, refused, n = None, None, None, 0

    def row() -> pa.RecordBatch:
        cells = [key, pa.array([part], pa.int32()), pa.array([after.tolist()], pa.list_(pa.int32())), pa.array([refused.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64())]
        return pa.RecordBatch.from_arrays(cells, ["key", "part", "after", "refused", "n"])

    for b in batches:
        keys, attempts = b.column("key"), b.column("attempt").to_numpy(zero_copy_only=False)
        codes = pd.factorize(keys.to_pandas(), use_na_sentinel=False)[0]
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else []
        for s, e in zip(starts, [*starts[1:], len(codes)], strict=True):
            this = keys.slice(s, 1)
            if key is None or not this.equals(key):
                if key is not None:
                    yield row()
                key, after, refused, n = this, np.arange(len(STATUSES)), np.zeros(len(STATUSES), np.int64), 0
            for a in attempts[s:e].tolist():
                refused += refusals[a][after]
                after = steps[a][after]
            n += int(e - s)
    if key is not None:
        yield row()


def composed(maps: Column) -> Column:
    """Maps (after, refused) in order as one."""
    some = F.array(*[F.lit(i) for i in range(len(STATUSES))])
    zero = F.struct(some.alias("after"), F.array(*[F.lit(0).cast("long")] * len(STATUSES)).alias("refused"))
    both = lambda f, g: F.struct(F.transform(f["after"], lambda s: F.get(g["after"], s)).alias("after"), F.zip_with(f["refused"], f["after"], lambda r, s: r + F.get(g["refused"], s)).alias("refused"))
    return F.aggregate(maps, zero, both)


def histories(attempts: DataFrame, key: str, order: list[str], wanted: str) -> DataFrame:
    """key, status, attempts, refused: the status of each document after its attempts in order, from uploaded on.

    An attempt that isn't allowed, or names no status (or null), is refused and changes nothing. Null keys are one document; order should be unique within a document, as equal places are
    taken in any order.
    """
    rows = attempts.select(F.col(key).alias("key"), *order, attempt_number(F.col(wanted)).alias("attempt"))
    keys = ["key", *order]
    kind = T._parse_datatype_string(f"key {dict(rows.dtypes)['key']}, part int, after array<int>, refused array<long>, n long")
    runs = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("key", "attempt").mapInArrow(_folded, kind)
    per = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "after", "refused"))).alias("maps"), F.sum("n").alias("attempts"))  # one map per range at most
    done = per.withColumn("m", composed(F.col("maps")))
    names = F.array(*map(F.lit, STATUSES))
    return done.select(F.col("key").alias(key), F.get(names, F.get("m.after", F.lit(0))).alias("status"), "attempts", F.get("m.refused", F.lit(0)).alias("refused"))


class Histories(StatefulProcessor):
    """The same over a stream: a document's status, attempts and refusals are its state; rows of a batch count in order of `at`."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("history", "status string, attempts long, refused long")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        status, attempts, refused = self.state.get() if self.state.exists() else (START, 0, 0)
        batch = pd.concat(list(rows)).sort_values("at", kind="stable")
        for wanted in batch["wanted"]:
            ok = (status, wanted) in TRANSITIONS
            status, attempts, refused = wanted if ok else status, attempts + 1, refused + (not ok)
        self.state.update((status, attempts, refused))
        yield pd.DataFrame({"document_id": [key[0]], "status": [status], "attempts": [attempts], "refused": [refused]})

    def close(self) -> None:
        pass


def stream_histories(attempts: DataFrame) -> DataFrame:
    """document_id, status, attempts, refused, whenever one changes, from a stream (document_id, at, wanted)."""
    return attempts.groupBy("document_id").transformWithStateInPandas(Histories(), f"document_id {dict(attempts.dtypes)['document_id']}, status string, attempts long, refused long", "Update", "None")
