"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry, in whole numbers.

Codebooks come from Lloyd's rounds with Hamerly's bounds. Each part of each vector keeps two numbers from round to round: an upper bound of the
distance to its own entry, and a lower bound of the distance to the second nearest one. After the entries have moved, both are
widened by how far. Only where the upper one isn't strictly below the lower one (or half the way to the nearest other entry) is
the own distance computed anew, and only where that doesn't help either are all entries scanned, in integers, ties to the lower
index. Bounds are rounded outwards, so they never decide a tie.

A round is one pass over a saved table, and what leaves it are sums per entry: the driver holds the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.llm.shared import discard, saved

STATE = "vec_id long, label {label}, z array<int>, code binary, upper array<float>, lower array<float>"
SUMS = "part int, entry int, at int, total long, n long"
FINAL = "vec_id long, label {label}, code string, error long"


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows whose vector isn't null and holds no null or non-finite component."""
    good = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").filter(F.col("embedding").isNotNull() & good)


def outward(x: np.ndarray, up: bool) -> np.ndarray:
    """Single precision, rounded up or down by more than the rounding error of x."""
    return np.nextafter((x * (1 + 1e-12 if up else 1 - 1e-12)).astype(np.float32), np.float32(np.inf if up else -np.inf))


def distances(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared integer distances of the rows of x to the entries."""
    return np.stack([((x - entry) ** 2).sum(1) for entry in books], 1)


@dataclass
class Move:
    """One part's entries after a round: where they are, how far each has moved (rounded up), half the way to the next one (rounded down)."""

    books: np.ndarray
    moved: np.ndarray
    half: np.ndarray

    @staticmethod
    def of(before: np.ndarray, after: np.ndarray) -> Move:
        between = distances(after, after).astype(np.float64)
        np.fill_diagonal(between, np.inf)
        moved = np.sqrt(((after - before) ** 2).sum(1).astype(np.float64))
        return Move(after, outward(moved, True), outward(np.sqrt(between.min(1)) / 2, False))

    def others(self) -> np.ndarray:
        """For each entry, how far any other one has moved at most."""
        if len(self.moved) == 1:
            return np.zeros(1, np.float32)
        order = np.argsort(self.moved)
        most = np.full(len(self.moved), self.moved[order[-1]])
        most[order[-1]] = self.moved[order[-2]]
        return most


def scanned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row (the lowest of equals), the bounds of its distance and of the second nearest one's."""
    d = distances(x, books)
    code = d.argmin(1)
    rows = np.arange(len(x))
    upper = outward(np.sqrt(d[rows, code].astype(np.float64)), True)
    if len(books) == 1:
        return code, upper, np.full(len(x), np.inf, np.float32)
    d[rows, code] = np.iinfo(np.int64).max
    return code, upper, outward(np.sqrt(d.min(1).astype(np.float64)), False)


def reassigned(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """code, upper and lower after a move, and how many rows were scanned in full."""
    code, upper = code.astype(np.int64), outward(upper.astype(np.float64) + move.moved[code], True)
    lower = outward(lower.astype(np.float64) - move.others()[code], False)
    bound = np.maximum(lower, move.half[code])
    unsure = np.flatnonzero(~(upper < bound))
    exact = ((x[unsure] - move.books[code[unsure]]) ** 2).sum(1)
    upper[unsure] = outward(np.sqrt(exact.astype(np.float64)), True)
    left = unsure[~(upper[unsure] < bound[unsure])]
    code[left], upper[left], lower[left] = scanned(x[left], move.books)
    return code, upper, lower, len(left)


def _cube(z: pa.Array, parts: int) -> np.ndarray:
    """The vectors of a column as rows x parts x width."""
    return z.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(z), parts, -1)  # never of rows without components


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def _codes(code: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in code.astype(np.uint8)], pa.binary())


def _first(books: np.ndarray):
    """Assigns every part for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _cube(b.column("z"), len(books))
            found = [scanned(x[:, p], books[p]) for p in range(len(books))]
            code, upper, lower = (np.stack(f, 1) for f in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _codes(code), _lists(upper), _lists(lower)], ["vec_id", "label", "z", "code", "upper", "lower"])

    return run


def _held(b: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and codes of a batch of the state."""
    return _cube(b.column("z"), parts), np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, parts)


def _next(moves: list[Move], last: bool):
    """Assigns again after a move; at last, gives codes and exact errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(moves)
        for b in batches:
            x, code = _held(b, parts)
            upper, lower = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts) for c in ("upper", "lower"))
            found = [reassigned(x[:, p], code[:, p], upper[:, p], lower[:, p], moves[p])[:3] for p in range(parts)]
            code, upper, lower = (np.stack(f, 1) for f in zip(*found, strict=True))
            if not last:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], _codes(code), _lists(upper), _lists(lower)], ["vec_id", "label", "z", "code", "upper", "lower"])
                continue
            error = sum(((x[:, p] - moves[p].books[code[:, p]]) ** 2).sum(1) for p in range(parts))
            shown = pa.array([row.tobytes().hex() for row in code.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], shown, pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def _sums(parts: int, entries: int):
    """Per task, the sum of each entry's parts at each place, and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = None, np.zeros((parts, entries), np.int64)
        for b in batches:
            x, code = _held(b, parts)
            if total is None:
                total = np.zeros((parts, entries, x.shape[2]), np.int64)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                there, at = np.unique(code[order, p], return_index=True)
                if len(there):
                    total[p, there] += np.add.reduceat(x[order, p], at, axis=0)
                    many[p] += np.bincount(code[:, p], minlength=entries)
        if total is not None:
            p, e, i = np.nonzero(np.broadcast_to(many[:, :, None] > 0, total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(i, pa.int32()), pa.array(total[p, e, i]), pa.array(many[p, e])], ["part", "entry", "at", "total", "n"])

    return run


def means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries replaced by the floors of their parts' means; unused ones stay. One row per component comes back, whatever the table's size."""
    parts, entries, width = books.shape
    wide = lambda c: F.sum(F.col(c).cast("decimal(19,0)")).alias(c)
    per = state.select("z", "code").mapInArrow(_sums(parts, entries), SUMS).groupBy("part", "entry", "at").agg(wide("total"), wide("n"))
    after = books.copy()
    for r in per.collect():  # parts x entries x width at most
        after[r.part, r.entry, r["at"]] = int(r.total) // int(r.n)
    return after


@dataclass
class Codes:
    """vec_id, label, code (two hex digits per part) and error (squared distance) of each vector; the codebooks by part, entry and place."""

    rows: DataFrame
    books: np.ndarray

    @property
    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def decoded(self, scale: int = 4096) -> DataFrame:
        """vec_id, embedding: each vector as its entries say, in the middle of each step; null where there is no code."""
        parts, _, width = self.books.shape
        flat = F.array(*[F.array(*map(F.lit, b)) for b in self.books.reshape(parts, -1).tolist()]).cast("array<array<int>>")
        entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
        whole = F.flatten(F.array(*[F.slice(flat[p], entry(p) * width + 1, width) for p in range(parts)]))
        return self.rows.select("vec_id", F.when(F.col("code").isNotNull(), F.transform(whole, lambda v: (v + 0.5) / scale)).alias("embedding"))


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codes:
    """Codes of vectors (vec_id, embedding, label; other columns are ignored).

    A component x counts as floor(scale * x). A vector is cut into equal parts; each part's codebook starts as that part of the smallest vec_ids
    (null last, equal ones by their components) and is fitted in so many rounds over all vectors.

    Vectors that are null or hold null or non-finite components aren't in the result. The others must have as many components as most have (of
    lengths that can be cut; ties to the shorter); one of another length takes part in nothing and has a null code and error. Rows that repeat, or share a vec_id, count each
    for itself. With fewer vectors than entries, codebooks are shorter; an empty table gives no rows. Components must be so small that
    squared distances fit 64 bits (beyond 20,000 at 64 components); larger ones raise ValueError.
    """
    label = dict(vectors.dtypes)["label"]
    rows, size = kept(vectors), F.size("embedding")
    fits = F.when((size > 0) & (size % parts == 0), size)
    most = F.max(F.when(fits.isNotNull(), F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))))
    length, largest = rows.agg(F.mode(fits, deterministic=True), most).first()
    fitting = F.lit(False) if length is None else size == length
    if length is not None and 4.0 * length * (largest * scale + 1) ** 2 >= 2.0**63:
        raise ValueError(f"components up to {largest} have squared distances beyond 64 bits")
    shape = (parts, 0, (length or 0) // parts)
    nothing: Column = F.lit(None)
    odd = rows.filter(~fitting).select("vec_id", "label", nothing.cast("string").alias("code"), nothing.cast("long").alias("error"))
    if length is None:
        return Codes(odd, np.zeros(shape, np.int64))
    whole = rows.filter(fitting).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("z"))
    state = saved(whole, "vectors")
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "z").limit(entries).collect()
    books = np.array([r.z for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    schema, moves = STATE.format(label=label), None
    for _ in range(rounds):
        step = state.mapInArrow(_first(books) if moves is None else _next(moves, False), schema)
        after = saved(step, "vector-codes")
        discard(state)
        state, moved = after, means(after, books)
        moves = [Move.of(a, b) for a, b in zip(books, moved, strict=True)]
        books = moved
    if moves is None:
        state, moves = saved(state.mapInArrow(_first(books), schema), "vector-codes"), [Move.of(b, b) for b in books]
    done = saved(state.mapInArrow(_next(moves, True), FINAL.format(label=label)), "vector-codes")
    discard(state)
    return Codes(done.unionByName(odd), books)


def with_label_errors(codes: Codes) -> DataFrame:
    """vec_id, code, error, label_error (the error of all vectors with the label, nulls together), codebooks_sha256."""
    per = saved(codes.rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    rows = codes.rows.alias("a").join(per.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")), "left")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(codes.digest).alias("codebooks_sha256"))
