"""MinHash near-dedup with SetSketch registers (operator 1).

Per document: the set of k-word shingles, a digest of that set, and 127
registers. A register is floor(1 - log_b x), x the least of exponential variates
that the set's elements draw for it. Each element draws one variate from each
of 127 consecutive slices of the exponential law and gives them to the
registers in an order of its own, so that drawing stops once a slice starts
above the registers' largest minimum. Registers of unions are maxima of registers.

Steps: equal sets collapse to classes (partial aggregate on the digest); 31
bands of 4 registers propose pairs; the joint maximum-likelihood estimate of
the Jaccard similarity drops pairs far below the threshold; what is left is
confirmed on the full sets. A bucket never emits all its pairs: first each
member meets two leaders of its bucket; buckets that still hold several
components, taken together where they share members, are then cut into blocks,
and each pair of blocks is worked in a task that returns only a spanning forest
of confirmed links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import lean, lean_group, parts, stored
from .words import MIX, Words, flat_text, mix, row_chunks, shingle_sets

REGISTERS, BASE, RATE, TOP = 127, 1.001, 20.0, 65535
BANDS, BAND_ROWS = 31, 4
BLOCK = 1024
#: Neighbourhoods of at most so many members are worked whole; a larger one bucket by bucket.
NEIGHBOURHOOD = 8192
#: Ids that a scan is filtered by through a broadcast (some 50 MB); more of them are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Standard deviations by which an estimate may miss the threshold before its pair is dropped.
SLACK = 6.0


def sketch(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """uint16 registers (rows x 127) of the sets given as rows and 64-bit elements; an empty set has zeros."""
    least = np.full(rows * REGISTERS, np.inf)
    start = (mix(value ^ np.uint64(0xA5A5A5A5)) % np.uint64(REGISTERS)).astype(np.int64)
    step = (mix(value ^ np.uint64(0x5A5A5A5A00)) % np.uint64(REGISTERS - 1)).astype(np.int64) + 1
    for j in range(REGISTERS):
        if not len(row):
            break
        left = REGISTERS - j
        u = (mix(value + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        x = (np.log(REGISTERS / left) - np.log1p(-u / left)) / RATE
        np.minimum.at(least, row * REGISTERS + (start + j * step) % REGISTERS, np.maximum(x, 1e-300))
        if left > 1:
            most = least.reshape(rows, REGISTERS).max(axis=1)
            go = most[row] > np.log(REGISTERS / (left - 1)) / RATE
            row, value, start, step = row[go], value[go], start[go], step[go]
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(np.where(np.isfinite(least), level, 0), 0, TOP).astype(np.uint16).reshape(rows, REGISTERS)


def estimate(above: np.ndarray, below: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from how many registers of A lie above and below B's, given both sizes."""
    if len(na) > 4096:  # bounded memory
        cut = range(4096, len(na), 4096)
        return np.concatenate([estimate(*part) for part in zip(*(np.split(x, cut) for x in (above, below, na, nb)), strict=True)])
    grid = np.linspace(0, 1, 101)[None, :]
    u = (na / (na + nb))[:, None].astype(float)
    v = 1 - u
    j = grid * np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    up, down = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    same = np.clip(1 - up - down, 1e-12, 1)
    even = REGISTERS - above - below
    like = above[:, None] * np.log(up) + below[:, None] * np.log(down) + even[:, None] * np.log(same)
    return j[np.arange(len(j)), like.argmax(axis=1)]


def _rows_of_sets(k: int, lower: bool):
    """Yields (record batch slice, Words, element rows, elements) for each chunk of an Arrow batch."""

    def chunks(batch: pa.RecordBatch):
        data, offsets = flat_text(batch.column(batch.schema.get_field_index("text")))
        for a, b in row_chunks(offsets):
            row, value = shingle_sets(Words(data, offsets[a : b + 1], lower), k)
            yield batch.slice(a, b - a), row, value, np.bincount(row, minlength=b - a)

    return chunks


def _sketched(docs: DataFrame, k: int, lower: bool) -> DataFrame:
    chunks = _rows_of_sets(k, lower)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, value, size in chunks(batch):
                regs = sketch(row, value, part.num_rows)
                ends = np.concatenate([[0], np.cumsum(size)])
                digests = [hashlib.blake2b(value[i:j].tobytes(), digest_size=16).digest() if j > i else None for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], names=["doc_id", "n_shingles", "digest", "regs"])

    return docs.select("doc_id", "text").mapInArrow(lean(work), "doc_id long, n_shingles long, digest binary, regs binary")


def _banded(classes: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.stack([np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()]).astype(np.uint64)
            used = regs[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS)
            key = mix((used * MIX[:BAND_ROWS]).sum(axis=2, dtype=np.uint64) + MIX[100 : 100 + BANDS]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS))], names=["bucket", "rep"])

    return classes.select("rep", "regs").mapInArrow(lean(work), "bucket long, rep long")


def _far(num: int, den: int) -> float:
    t = num / den
    return t - SLACK * (t * (1 - t) / REGISTERS) ** 0.5


def _likely(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b, na, nb, ra, rb) whose estimate is not far below num/den."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            ra, rb = (np.stack([np.frombuffer(x, np.uint16) for x in batch.column(i).to_pylist()]) for i in (4, 5))
            ok = estimate((ra > rb).sum(axis=1), (ra < rb).sum(axis=1), na, nb) >= _far(num, den)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1)], names=["a", "b"]).filter(pa.array(ok))

    fits = (den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    return pairs.where(fits).select("a", "b", "na", "nb", "ra", "rb").mapInArrow(lean(work), "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * |x and y| >= num * |x or y| for sorted distinct elements."""
    if len(x) > len(y):
        x, y = y, x
    if den * len(x) < num * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), num, den) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    mine = sets.select("rep", "elements")
    both = pairs.join(mine.toDF("a", "xs"), "a").join(mine.toDF("b", "ys"), "b")
    return both.select("a", "b", "xs", "ys").mapInArrow(lean(work), "u long, v long")


def _sets(docs: DataFrame, wanted: DataFrame, k: int, lower: bool) -> DataFrame:
    """(rep, elements): full sets of the wanted representatives' texts."""
    chunks = _rows_of_sets(k, lower)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, value, size in chunks(batch):
                ends = np.concatenate([[0], np.cumsum(size)])
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array([value[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["rep", "elements"])

    ids = wanted.select(F.col("rep").alias("doc_id"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(lean(work), "rep long, elements binary")


def _forest(num: int, den: int):
    def work(table: pa.Table) -> pa.Table:
        rep, label = (table.column(c).to_numpy() for c in ("rep", "label"))
        block = table.column("block").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        regs = np.stack([np.frombuffer(x, np.uint16) for x in table.column("regs").to_pylist()])
        sets = [np.frombuffer(x, np.uint64) for x in table.column("elements").to_pylist()]
        size = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        above, below = (np.zeros((len(left), len(right)), np.int16) for _ in range(2))
        for j in range(REGISTERS):
            x, y = regs[left, j][:, None], regs[right, j][None, :]
            above += x > y
            below += x < y
        ok = (label[left][:, None] != label[right][None, :]) & (REGISTERS - above - below >= REGISTERS * max(0.0, _far(num, den) - 0.05))
        if low == high:
            ok &= left[:, None] < right[None, :]
        i, j = np.nonzero(ok)
        guess = estimate(above[i, j], below[i, j], size[left[i]], size[right[j]]) if len(i) else np.zeros(0)
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for at in np.argsort(-guess):
            if guess[at] < _far(num, den):
                break
            a, b = left[i[at]], right[j[at]]
            if (p := find(int(label[a]))) != (q := find(int(label[b]))) and linked(sets[a], sets[b], num, den):
                root[p] = q
                links.append((int(rep[a]), int(rep[b])))
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([x for _, x in links], pa.int64())})

    return work


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, lower: bool = True) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Links rows whose sets of `shingle`-word shingles have Jaccard similarity
    >= num/den; component_id is the smallest doc_id reachable, kept says that
    it is the row's own. Words are runs without ASCII white space, A-Z lowered.

    A null or wordless text has n_shingles 0, is linked with nothing and kept.
    A text of fewer words than a shingle has one element. A null doc_id takes
    part in no link: component_id null, kept true. Rows that share a doc_id are
    one document for linking: what is linked with one of its texts is in its
    component. Repeated rows are returned as often as they
    come; columns other than doc_id and text are not looked at. No rows in, none out.
    """
    spark = docs.sparkSession
    rows = stored(_sketched(docs, shingle, lower), "sketches")
    classes = stored(
        rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("regs").alias("regs")),
        "classes",
    )
    members = _banded(classes)
    buckets = stored(members.groupBy("bucket").agg(F.count("*").alias("many"), F.min("rep").alias("first"), F.max_by("rep", F.xxhash64("rep", "bucket")).alias("other")).where("first <> other or many > 1"), "buckets")
    inside = stored(members.join(buckets, "bucket"), "members")
    met = inside.select("rep", F.explode(F.array_distinct(F.array("first", "other"))).alias("lead")).where("rep <> lead")
    met = met.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
    side = classes.select("rep", "n", "regs")
    pairs = met.join(side.toDF("a", "na", "ra"), "a").join(side.toDF("b", "nb", "rb"), "b")
    pairs = stored(_likely(pairs, num, den), "pairs")
    wanted = stored(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct(), "wanted")
    sets = stored(_sets(docs, wanted, shingle, lower), "sets")
    links = _confirmed(pairs, sets, num, den)
    # Different texts of one doc_id are one document: their classes are linked through it.
    texts = rows.where("digest is not null and doc_id is not null").select("doc_id", "digest")
    several = texts.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    same = texts.join(several, "doc_id", "left_semi").join(classes.select("digest", "rep"), "digest")
    links = stored(links.unionByName(same.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))), "links")
    labels = components(links)

    # Buckets in which two members that have not met may still be linked.
    unmet = inside.where("many > 3 or (many = 3 and first = other)")
    named = unmet.join(labels.toDF("rep", "label"), "rep", "left").select("bucket", "many", "first", "rep", F.coalesce("label", "rep").alias("label"))
    open_ = named.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.max("many").alias("many"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).where("l <> h")
    open_ = open_.groupBy("who", "many").agg(F.min("bucket").alias("bucket")).select("bucket")
    rest = stored(named.join(open_, "bucket"), "open")
    if not rest.isEmpty():
        # Buckets that share members make a neighbourhood: worked as one, each member travels once instead of once a bucket.
        around = components(rest.select(F.col("rep").alias("u"), F.col("first").alias("v")))
        sizes = around.groupBy("component").agg(F.count("*").alias("size"))
        placed = rest.join(around.toDF("rep", "component"), "rep").join(sizes, "component")
        small = F.col("size") <= NEIGHBOURHOOD
        placed = placed.select(small.alias("whole"), F.when(small, F.col("component")).otherwise(F.col("bucket")).alias("key"), F.when(small, F.col("size")).otherwise(F.col("many")).alias("many"), "rep", "label").distinct()
        placed = stored(placed, "placed")
        more = stored(_sets(docs, placed.select("rep").distinct(), shingle, lower).join(side, "rep"), "sets")
        dealt = placed.withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int"))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        dealt = dealt.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("whole", "key", "rep", "label", "block", F.least("block", "against").alias("low"), F.greatest("block", "against").alias("high"))
        dealt = dealt.join(more, "rep").select("whole", "key", "low", "high", "block", "rep", "label", "regs", "elements")
        found = dealt.groupBy("whole", "key", "low", "high").applyInArrow(lean_group(_forest(num, den)), "u long, v long")
        labels = components(links.unionByName(stored(found, "links")))
    named = classes.select("digest", "rep").join(labels.toDF("rep", "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    rows = rows.select("doc_id", "n_shingles", "digest")
    empty = rows.where("digest is null").withColumn("component_id", F.lit(None).cast("long"))  # no key to join on
    out = rows.where("digest is not null").join(named, "digest", "left").unionByName(empty)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
