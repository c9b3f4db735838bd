"""Exact top-k inner products over norm-sorted, SVD-rotated vectors (operator 4).

Vectors become integers, floor(scale * x), and are stored sorted by descending
length. A rotation (the eigenvectors of the summed outer products, largest
first) moves most of every product into the first coordinates.

Queries go in blocks of bounded size, each broadcast; candidates are never
shuffled for a query. First a block meets the SHARD longest vectors, which gives
each query a floor: its k-th score so far. Lengths that cannot reach any floor
are then not read at all. Each task walks its part of the sorted candidates: the
bound |q| |c| ends the walk of queries it cannot help; the partial sum over the
first coordinates plus the Cauchy-Schwarz bound of the rest prunes candidates;
only survivors' exact integer products are taken, and at most k a query leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

SHARD, BLOCK, HEAD = 16_384, 1024, 24
#: Bytes of a broadcast block of queries, and of the longest vectors.
BLOCK_BYTES = 32 << 20
#: Products below this are exact in double precision.
EXACT = 2.0**52


def _integers(scale: float, vectors: list, dim: int | None) -> tuple[list[int], np.ndarray]:
    """Rows that take part, and their integer vectors."""
    rows, out = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v):
            continue
        x = np.array([np.nan if e is None else e for e in v], float)
        if np.isfinite(x).all() and (dim is None or len(x) == dim):
            rows.append(i)
            out.append(np.floor(scale * x))
    return rows, (np.stack(out) if out else np.zeros((0, dim or 0)))


def _length(v: np.ndarray) -> float:
    with np.errstate(over="ignore"):
        return float(np.sqrt(v @ v))


def _blobs(scale: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            column = batch.column(1)
            values = column.values if hasattr(column, "values") else column.flatten()
            lengths = np.diff(column.offsets.to_numpy())
            dim = int(lengths[0]) if len(lengths) else 0
            if len(lengths) and dim and (lengths == dim).all() and not column.null_count and not values.null_count:
                at = column.offsets[0].as_py()
                x = values.to_numpy(zero_copy_only=False)[at : at + dim * len(lengths)].reshape(-1, dim).astype(float)
                rows = np.flatnonzero(np.isfinite(x).all(axis=1))
                x = np.floor(scale * x[rows])
                vectors = list(x)
            else:
                rows, vectors = [], []
                for i, v in enumerate(column.to_pylist()):
                    r, x = _integers(scale, [v], None)
                    if r:
                        rows.append(i)
                        vectors.append(x[0])
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows], pa.int64()), pa.array([len(v) for v in vectors], pa.int32()), pa.array([_length(v) for v in vectors], pa.float64()), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["vec_id", "dim", "length", "vector"])

    return work


def _rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the sum of outer products; each task sends one dim x dim matrix, and those are summed in a tree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), float).reshape(-1, dim)
                total += x.T @ x
        i = np.arange(dim * dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    cells = vectors.where(F.col("dim") == dim).select("vector").mapInArrow(work, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(dim * dim)
    for r in cells:
        total[r.cell] = r.value
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1]


def _lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(axis=1))


class Search:
    """The k best of candidates that come in any number of batches, longest first, for a block of queries; ties to the smaller id; a query's own id is left out. `floor` is a score that a query's k-th is known to reach."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.queries, self.ids, self.turn, self.k = queries, ids, turn, k
        self.head = min(HEAD, queries.shape[1])
        self.length = _lengths(queries)
        with np.errstate(over="ignore", invalid="ignore"):
            self.asked = queries @ turn
            self.tail = _lengths(self.asked[:, self.head :])
        self.best = np.full((len(queries), k), -np.inf)
        if floor is not None:
            self.best[:] = floor[:, None]
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # row of queries, id, score
        self.size = 0

    def feed(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        length = _lengths(vectors)
        if not len(ids) or not len(self.ids):
            return
        if not self.length.max() * length.max() < EXACT:
            return self._wide(vectors, ids)
        order = np.lexsort((ids, -length))
        vectors, ids, length = vectors[order], ids[order], length[order]
        spun = vectors @ self.turn
        rest = _lengths(spun[:, self.head :])
        for at in range(0, len(ids), BLOCK):
            end = min(at + BLOCK, len(ids))
            # Bounds take a relative slack for rounding, far above what double precision loses.
            floor = self.best[:, 0]
            live = np.flatnonzero(~(self.length * length[at] * (1 + 1e-9) + 1e-6 < floor))
            if not len(live):
                return
            for mine in np.array_split(live, -(-len(live) // 2048)):
                bound = self.asked[mine, : self.head] @ spun[at:end, : self.head].T + self.tail[mine][:, None] * rest[at:end][None, :]
                slack = 1e-9 * self.length[mine][:, None] * length[at:end][None, :] + 1e-6
                q, c = np.nonzero((bound + slack >= floor[mine][:, None]) & (self.ids[mine][:, None] != ids[at:end][None, :]))
                if not len(q):
                    continue
                if len(q) > 0.25 * len(mine) * (end - at):
                    score = (self.queries[mine] @ vectors[at:end].T)[q, c]
                else:
                    score = np.einsum("ij,ij->i", self.queries[mine[q]], vectors[at + c])
                keep = score >= floor[mine[q]]
                q, c, score = mine[q[keep]], at + c[keep], score[keep]
                for r, values in zip(*_grouped(q, score), strict=True):
                    self.best[r] = np.sort(np.concatenate([self.best[r], values]))[-self.k :]
                self._add(q, ids[c], score.astype(np.int64))

    def _wide(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Components so large that doubles aren't exact: whole numbers without bounds, and without pruning. Scores beyond 64 bits become the nearest that fit."""
        low, high = -(1 << 63), (1 << 63) - 1
        asked = [[int(v) for v in q] for q in self.queries]
        for x, name in zip(vectors, ids.tolist(), strict=True):
            c = [int(v) for v in x]
            rows = np.flatnonzero(self.ids != name)
            score = [min(max(sum(a * b for a, b in zip(asked[r], c, strict=True)), low), high) for r in rows]
            self._add(rows, np.full(len(rows), name), np.array(score, np.int64))

    def _add(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.found.append((rows, ids, score))
        self.size += len(rows)
        if self.size > 4 * self.k * len(self.ids) + 100_000:
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of queries, id, score) of the k best of each query so far, best first."""
        if not self.found:
            return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, ids, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, ~score, rows))  # ~x goes down as x goes up, without overflow
        rows, ids, score = rows[order], ids[order], score[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(self.ids)))[rows] < self.k
        self.found = [(rows[keep], ids[keep], score[keep])]
        self.size = int(keep.sum())
        return self.found[0]


def _grouped(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    cut = np.flatnonzero(np.diff(key)) + 1
    return key[np.concatenate([[0], cut])] if len(key) else key, np.split(value, cut) if len(key) else []


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, dim)


def _searched(sent, dim: int, k: int):
    """Candidates (vec_id, vector) of a task, in their stored order, against the broadcast block of queries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ids, turn, floor = sent.value
        search = Search(queries, ids, turn, k, floor)
        for batch in batches:
            search.feed(_matrix(batch.column(1), dim), batch.column(0).to_numpy())
        r, names, score = search.result()
        yield pa.RecordBatch.from_arrays([pa.array(ids[r], pa.int64()), pa.array(names, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    return work


def _floored(sent, dim: int, k: int):
    """Queries (vec_id, vector) against the broadcast longest vectors: each with the score that its k-th best reaches at least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest, names, turn = sent.value
        for batch in batches:
            queries = _matrix(batch.column(1), dim)
            search = Search(queries, batch.column(0).to_numpy(), turn, k)
            search.feed(longest, names)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(search.best[:, 0] if batch.num_rows else [], pa.float64())], names=["vec_id", "vector", "floor"])

    return work


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest integer inner products of each query, ties to the smaller vec_id.

    `vectors` has vec_id and embedding; queries are the rows whose vec_id is
    divisible by `every`, candidates all rows with another vec_id. Vectors that are null,
    empty or hold null or non-finite components take no part, nor do rows
    without vec_id. Vectors of different dimensions are never compared. Of
    rows that repeat a vec_id and vector one counts; a query_id with different
    vectors is answered for the greatest of their scores. Scores beyond 64 bits
    count as the nearest that fit. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    held = rows.mapInArrow(_blobs(scale), "vec_id long, dim int, length double, vector binary").distinct()
    # Sorted by length over all files: bounds on the length skip files and row groups.
    held = stored(held.orderBy("dim", F.desc("length"), "vec_id"), "vectors")
    dims = sorted(r.dim for r in held.select("dim").distinct().collect())
    answer = None
    for dim in dims:
        mine = held.where(F.col("dim") == dim)
        turn = _rotation(held, dim)
        most = max(k + 1, BLOCK_BYTES // (8 * dim))
        top = mine.orderBy(F.desc("length")).limit(min(SHARD, most)).select("vec_id", "vector").toArrow()
        seed = spark.sparkContext.broadcast((_matrix(top.column("vector"), dim), top.column("vec_id").to_numpy(), turn))
        asked = mine.where(F.col("vec_id") % every == 0).select("vec_id", "vector")
        blocks = max(1, -(-asked.count() // most))
        asked = stored(asked.mapInArrow(_floored(seed, dim, k), "vec_id long, vector binary, floor double"), "queries")
        for block in range(blocks):
            # The stated query set against all rows, in blocks of bounded size.
            part = asked.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)) == block).toArrow()
            if not part.num_rows:
                continue
            queries, floor = _matrix(part.column("vector"), dim), part.column("floor").to_numpy()
            reach = _lengths(queries)
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(floor > 0, floor / np.where(reach > 0, reach, np.inf) * (1 - 1e-9), 0.0).min()
            sent = spark.sparkContext.broadcast((queries, part.column("vec_id").to_numpy(), turn, floor))
            near = mine.where(F.col("length") >= float(least)).select("vec_id", "vector")
            found = near.mapInArrow(_searched(sent, dim, k), "query_id long, vec_id long, score long")
            answer = found if answer is None else answer.unionByName(found)
    if answer is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    one = answer.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
