"""Best-fit packing with linear grouping (operator 10).

Documents become token ids; what is longer than a sequence is cut into full
sequences and one shorter first piece. How many pieces have each length is all
the planner needs: at most `capacity` numbers, whatever the corpus.

Planner: lengths over a third of the capacity are sorted and cut into groups of
equal cardinality, each rounded up to its longest. A linear program over
configurations of these few sizes (column generation; a knapsack prices) gives
counts, rounded down. Configurations may leave a gap (several are tried), so that
what rounding wastes adds to one that a small piece can fill. Actual lengths,
shorter or equal, take the places, longest first. Pieces left over and small
ones then go, longest first, where they fit best; only sequences that are still
loose are packed anew.

Pieces get ranks within their length: hashed groups are ranked alone and offset
by the groups before them, so a common length never meets in one task. Rank and
length give sequence and offset from the plan, whose size is bounded by `capacity`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .storage import lean, stored

#: Lengths over capacity / LARGE are large. Number of groups and share of the capacity that configurations leave as a gap, each tried.
LARGE, GROUPINGS, ROUNDS = 3, ((32, 1 / 8), (32, 5 / 32), (64, 1 / 8), (64, 5 / 32), (64, 0), (128, 0)), 400
#: Shares of the capacity: sequences with more free places than that are loose.
SLACKS = (1 / 8, 1 / 32)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        close = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                tokens = encode(text.as_py() or "") + close
                n = len(tokens) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part = tokens[4 * i : 4 * j]
                    out.append((doc_id, k, i, j - i, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return work


def _knapsack(sizes: list[int], worth: np.ndarray, capacity: int) -> list[int]:
    best, came = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (s, w) in enumerate(zip(sizes, worth, strict=True)):
        if w <= 1e-12:
            continue
        for lo in range(s, capacity + 1, s):  # blocks of s places only read what lies before them
            hi = min(lo + s, capacity + 1)
            new = best[lo - s : hi - s] + w
            up = new > best[lo:hi] + 1e-15
            best[lo:hi] = np.where(up, new, best[lo:hi])
            came[lo:hi] = np.where(up, i, came[lo:hi])
    take, at = [0] * len(sizes), capacity
    while at > 0:
        if came[at] < 0 or best[at] == best[at - 1]:
            at -= 1
            continue
        take[came[at]] += 1
        at -= sizes[came[at]]
    return take


def _configurations(sizes: list[int], demand: list[int], capacity: int, gap: int) -> list[tuple[list[int], int]]:
    """Gilmore and Gomory's column generation on the fractional problem over sequences that leave `gap` places; counts are rounded down. Sizes (longest first) that leave less stand alone."""
    alone = sum(s > capacity - gap for s in sizes)
    if alone:
        rest = _configurations(sizes[alone:], demand[alone:], capacity, gap) if alone < len(sizes) else []
        return [([int(i == j) for j in range(len(sizes))], demand[i]) for i in range(alone)] + [([0] * alone + p, n) for p, n in rest]
    capacity -= gap
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    patterns = [[capacity // s if i == j else 0 for j in range(m)] for i, s in enumerate(sizes)]
    x = np.linalg.solve(basis, np.array(demand, float))
    for _ in range(ROUNDS):
        price = np.linalg.solve(basis.T, np.ones(m))
        take = _knapsack(sizes, price, capacity)
        if float(np.dot(price, take)) <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, np.array(take, float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = take
        patterns[out] = take
        x = np.maximum(np.linalg.solve(basis, np.array(demand, float)), 0)
    return [(p, int(n + 1e-9)) for p, n in zip(patterns, x, strict=True) if n >= 1]


Classes = list[tuple[tuple[tuple[int, int], ...], int]]


def _grouped(counts: dict[int, int], capacity: int, groups: int, gap: int) -> tuple[Classes, dict[int, int]]:
    """Sequences from the configurations of large lengths in `groups` groups, filled with actual lengths; and what is left over."""
    left = {s: n for s, n in counts.items() if n > 0}
    large = sorted((s for s in left if s * LARGE > capacity), reverse=True)
    total = sum(left[s] for s in large)
    runs: list[list[list[int]]] = []  # of each group: [length, how many], longest first
    sizes: list[int] = []
    if large:
        share, room = -(-total // groups), 0
        for s in large:
            n = left.pop(s)
            while n:
                if not room:
                    sizes.append(s)
                    runs.append([])
                    room = share
                take = min(n, room)
                runs[-1].append([s, take])
                n, room = n - take, room - take
        merged: dict[int, list[list[int]]] = {}  # groups of one size count as one
        for s, r in zip(sizes, runs, strict=True):
            merged.setdefault(s, []).extend(r)
        sizes, runs = list(merged), list(merged.values())
    classes: Classes = []
    for pattern, n in _configurations(sizes, [sum(k for _, k in r) for r in runs], capacity, gap) if sizes else []:
        slots = [g for g, k in enumerate(pattern) for _ in range(k)]
        supply = [sum(k for _, k in runs[g]) // pattern[g] for g in set(slots)]
        n = min([n, *supply])
        # Each slot takes the next n actual lengths of its group; sequences with equal lengths stay one class.
        cut: list[list[list[int]]] = []
        for g in slots:
            mine, need = [], n
            while need:
                s, k = runs[g][0]
                take = min(k, need)
                mine.append([s, take])
                need -= take
                if take == k:
                    runs[g].pop(0)
                else:
                    runs[g][0][1] -= take
            cut.append(mine)
        while n:
            take = min(c[0][1] for c in cut)
            held: dict[int, int] = {}
            for c in cut:
                held[c[0][0]] = held.get(c[0][0], 0) + 1
                c[0][1] -= take
                if not c[0][1]:
                    c.pop(0)
            classes.append((tuple(held.items()), take))
            n -= take
    for r in runs:
        for s, k in r:
            left[s] = left.get(s, 0) + k
    return classes, left


def _best_fit(classes: Classes, left: dict[int, int], capacity: int) -> Classes:
    """Puts what is left, longest first, where it fits best."""
    rooms: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    for held, n in classes:
        rooms.setdefault(capacity - sum(s * k for s, k in held), []).append((held, n))
    order = sorted(rooms)
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            at = int(np.searchsorted(order, s)) if order else 0
            if at < len(order):
                room = order[at]
                held, bins = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            else:
                room, held, bins = capacity, (), n
            each = room // s
            if n >= each:
                used = min(bins, n // each)
            else:
                each, used = n, 1
            n -= each * used
            for new, many in (((*held, (s, each)), used), (held, bins - used)):
                if many and new:
                    free = capacity - sum(a * k for a, k in new)
                    if free not in rooms:
                        rooms[free] = []
                        order.insert(int(np.searchsorted(order, free)) if order else 0, free)
                    rooms[free].append((new, many))
    return [(held, n) for group in rooms.values() for held, n in group]


def _repacked(classes: Classes, capacity: int, slack: int) -> Classes:
    """Takes sequences with more than `slack` free places apart and fits their pieces anew."""
    kept, left = [], {}
    for held, n in classes:
        if capacity - sum(s * k for s, k in held) <= slack:
            kept.append((held, n))
            continue
        for s, k in held:
            left[s] = left.get(s, 0) + k * n
    return _best_fit(kept, left, capacity)


def plan(counts: dict[int, int], capacity: int) -> Classes:
    """Classes of equal sequences: ((length, how many in each), ...) and the number of sequences. Every piece is placed.

    Several groupings are tried; of each result, sequences that stayed loose are
    packed anew as long as that saves some; no others are. The fewest sequences win.
    """
    size = lambda classes: sum(n for _, n in classes)
    best: Classes | None = None
    for groups, gap in GROUPINGS:
        now = _best_fit(*_grouped(counts, capacity, groups, int(gap * capacity)), capacity)
        for slack in SLACKS:
            now = min(now, _repacked(now, capacity, int(slack * capacity)), key=size)
        best = now if best is None else min(best, now, key=size)
    return best or []


def _places(classes: Classes) -> dict[int, np.ndarray]:
    """length -> rows (first rank, how many in each sequence, first sequence, offset), by first rank."""
    ranks: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for held, n in classes:
        at = 0
        for s, k in held:
            rows.setdefault(s, []).append((ranks.get(s, 0), k, base, at))
            ranks[s] = ranks.get(s, 0) + k * n
            at += s * k
        base += n
    return {s: np.array(r, np.int64) for s, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (little-endian uint32) if asked for.

    Every row's ids, then end_id, in sequences of at most `capacity` tokens;
    only longer documents are cut, the first piece being the shorter one.

    A null or empty text is one piece of end_id alone. Null and repeated
    doc_ids are rows like others. Very long texts give many full pieces. No
    rows in, none out. Other columns are not looked at.
    """
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    pieces = docs.select("doc_id", "text").mapInArrow(lean(_pieces(tokenizer, capacity, end_id, with_ids), vocabularies=True), kinds)
    pieces = stored(pieces if with_ids else pieces.drop("ids"), "pieces")
    names = pieces.columns
    short = pieces.where(F.col("length") < capacity)
    counts = {r.length: r["count"] for r in short.groupBy("length").count().collect()}  # at most capacity - 1 rows
    classes = plan(counts, capacity)
    where = docs.sparkSession.sparkContext.broadcast(_places(classes))
    spread = max(16, -(-sum(counts.values()) // 100_000))
    dealt = short.withColumn("g", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(spread)).cast("int"))
    sizes = dealt.groupBy("length", "g").agg(F.count("*").alias("n"))
    before = sizes.select("length", "g", (F.sum("n").over(Window.partitionBy("length").orderBy("g")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("length", "g").orderBy("doc_id", "ids_crc32", "start")) - 1)
    ranked = ranked.join(before, ["length", "g"]).select(*names, (F.col("r") + F.col("before")).alias("rank"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                s = int(length[mine[0]])
                rows = where.value[s]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                at = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 2] + at // row[:, 1]
                offset[mine] = row[:, 3] + at % row[:, 1] * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    full = pieces.where(F.col("length") == capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(lean(work, vocabularies=True), schema).unionByName(full)
