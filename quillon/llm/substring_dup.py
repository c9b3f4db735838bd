"""Substring dedup by repeated-phrase automata (operator 6).

A window is `size` consecutive words. Within a window the least hash of its
ANCHOR-word runs is its anchor: equal windows have equal anchors, and about a
quarter of all words start one. Steps:

1. Anchors of all documents, grouped: smallest and largest document of each
   (partial aggregates). Anchors of two or more documents recur. One with over
   HOT places is too common to be worked as one: its windows are keyed by their
   own hash instead, which equal windows share as well.
2. Second scan: runs of windows with a recurring anchor become segments
   (anchor, document, place, words). Equal segments are merged within COMBINE
   bytes, then within their shard, with their smallest and largest document.
3. Confirmation, in shards of anchors: windows that stand in two documents, by
   real words, become phrases with the first document of each window; windows
   that always occur side by side are one phrase. What doesn't recur ends here.
4. Location: a shard's phrases are compiled, as sequences of word numbers, to an
   Aho-Corasick automaton, and the segments of all documents stream through it,
   but for those no document stands before: the first one of all phrases of an
   anchor loses nothing there.
   Each occurrence behind its window's first document is one to remove. A shard
   with many segments is dealt over several tasks, each with the automaton.
5. Documents lose the covered words. Only texts that lose some are shuffled.

Recurring anchors reach the second scan by broadcast if there are at most
BROADCAST_ANCHORS of them (9 bytes each), else by a shuffled join, and so do
confirmed ones to step 4 (16 bytes) and the keys of texts to step 5; both ways
give the same rows. Comparing real words in steps 3 and 4 makes hashes mere hints.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean, lean_cogroup, lean_group, stored
from .words import Words, flat_text, mix, row_chunks

ANCHOR = 6
#: At most 64 MB; beyond it anchors and keys travel by a join.
BROADCAST_ANCHORS = 4_000_000
RUN = 32
#: Places from which an anchor's windows are keyed by their own hashes.
HOT = 100_000
#: Segments of a shard, by which shards are counted, and segments that stream through one task.
SHARD_SEGMENTS, STREAM = 10_000, 40_000
#: Bytes of segments within which equal ones are merged before they are shuffled.
COMBINE = 32 << 20


def _anchored(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of each row and their anchors."""
    at, _ = words.windows(size)
    k = min(ANCHOR, size)
    inner, value = words.windows(k)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    full = np.full(len(words.hash), np.iinfo(np.uint64).max, np.uint64)
    full[inner] = value
    least = full[at].copy()
    for j in range(1, size - k + 1):
        np.minimum(least, full[at + j], out=least)
    return at, least


def _runs(at: np.ndarray, anchor: np.ndarray, row: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of runs of neighbouring windows with one anchor; runs longer than `most` are cut."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(new | (within % most == 0))
    return first, np.diff(np.append(first, len(at)))


def _anchor_rows(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = flat_text(batch.column(1))
            for a, b in row_chunks(offsets):
                words = Words(data, offsets[a : b + 1], False)
                at, anchor = _anchored(words, size)
                row = words.row[at]
                first, _ = _runs(at, anchor, row, 1 << 30)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(ids[a + row[first]], pa.int64())], names=["anchor", "doc_id"])

    return work


def _found(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is in the sorted array, and where."""
    if not len(known):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x, at


def _segment_rows(size: int, known):
    """Segments of windows whose anchor is in `known` (a broadcast sorted array, and which of it are hot), or in the row's own `anchors` and `hots` if that is None."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            stamps = batch.column(2).to_numpy(zero_copy_only=False)
            data, offsets = flat_text(batch.column(1))
            for a, b in row_chunks(offsets):
                words = Words(data, offsets[a : b + 1], False)
                at, anchor = _anchored(words, size)
                if not len(at):
                    continue
                row = words.row[at]
                first, many = _runs(at, anchor, row, RUN)
                key = anchor[first].view(np.int64)
                if known is not None:
                    hit, spot = _found(key, known.value[0])
                    hot = hit & known.value[1][spot] if hit.any() else hit
                else:
                    hit, hot = np.zeros(len(first), bool), np.zeros(len(first), bool)
                    bounds = np.searchsorted(row[first], np.arange(b - a + 1))
                    for mark, column in ((hit, 3), (hot, 4)):
                        for r, mine in enumerate(batch.column(column).slice(a, b - a).to_pylist()):
                            i, j = bounds[r], bounds[r + 1]
                            mark[i:j] = _found(key[i:j], np.sort(np.array(mine or [], np.int64)))[0]
                cold = hit & ~hot
                if hot.any():
                    each = np.repeat(first[hot], many[hot])
                    each = each + np.arange(len(each)) - np.repeat(np.cumsum(many[hot]) - many[hot], many[hot])
                    key = np.concatenate([key[cold], words.windows(size)[1][each].view(np.int64)])
                    first, many = np.concatenate([first[cold], each]), np.concatenate([many[cold], np.ones(len(each), np.int64)])
                else:
                    first, many, key = first[cold], many[cold], key[cold]
                start = at[first]
                raw = words.seg.tobytes()
                texts = [b" ".join(raw[i:j].split()) for i, j in zip(words.starts[start].tolist(), words.ends[start + many + size - 2].tolist(), strict=True)]
                place = start - words.bounds[row[first]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(ids[a + row[first]], pa.int64()), pa.array(stamps[a + row[first]], pa.int64()), pa.array(place, pa.int32()), pa.array(texts, pa.binary())],
                    names=["anchor", "doc_id", "stamp", "place", "words"],
                )

    return work


def _equal_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each group of equal rows, and each row's group. Grouped by hash; if a hash should join rows that differ, by the rows themselves."""
    value = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        value = mix(value + rows[:, j].astype(np.uint64) + np.uint64(1))
    _, one, group = np.unique(value, return_index=True, return_inverse=True)
    if not (rows == rows[one[group]]).all():
        _, one, group = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return one, group.ravel()


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, words, doc_id) -> (anchor, words, low, high): equal segments within COMBINE bytes as one."""

    def merged() -> list[pa.RecordBatch]:
        found = pa.Table.from_batches(held).group_by(["anchor", "words"]).aggregate([("doc_id", "min"), ("doc_id", "max")])
        return found.select(["anchor", "words", "doc_id_min", "doc_id_max"]).rename_columns(["anchor", "words", "low", "high"]).to_batches(10_000)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= COMBINE:
            yield from merged()
            held, size = [], 0
    if held:
        yield from merged()


def _matching(known):
    """Segments whose anchor is in the broadcast sorted array and whose document is behind the anchor's first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, first = known.value
            hit, spot = _found(batch.column(0).to_numpy(), anchors)
            if len(anchors):
                hit &= batch.column(1).to_numpy() > first[spot]
            yield batch.filter(pa.array(hit))

    return work


def _confirmed(size: int):
    """One shard: distinct segments (anchor, words, low, high) -> phrases (shard, anchor, words, firsts): every window that stands in two documents, once, with its first document."""

    def work(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        texts = table.column("words").to_pylist()
        numbers: dict[bytes, int] = {}
        streams = [[numbers.setdefault(w, len(numbers)) for w in t.split()] for t in texts]
        flat = np.array([n for s in streams for n in s], np.int32)
        many = np.array([len(s) - size + 1 for s in streams])
        begin = np.cumsum([0, *[len(s) for s in streams]])[:-1]
        owner = np.repeat(np.arange(len(streams)), many)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        at = begin[owner] + step
        one, group = _equal_rows(np.lib.stride_tricks.sliding_window_view(flat, size)[at])
        low, high = table.column("low").to_numpy()[owner], table.column("high").to_numpy()[owner]
        least, most = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
        np.minimum.at(least, group, low)
        np.maximum.at(most, group, high)
        chosen = np.sort(one[least < most])  # where each recurring window is taken from
        # Neighbours that occur together wherever one of them does are one phrase.
        count, after = np.bincount(group), np.full(len(group), -1)
        after[:-1] = np.where(owner[1:] == owner[:-1], group[1:], -1)
        follower = after[one]
        whole = (np.bincount(group, after != follower[group]) == 0) & (follower >= 0) & (count == count[follower])
        new = np.ones(len(chosen), bool)
        new[1:] = (np.diff(chosen) != 1) | (np.diff(owner[chosen]) != 0) | ~whole[group[chosen[:-1]]]
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(chosen)))
        firsts = least[group[chosen]]
        words, mine = list(numbers), owner[chosen[head]]
        phrases = [b" ".join([words[n] for n in streams[o][i : i + k + size - 1]]) for o, i, k in zip(mine.tolist(), step[chosen[head]].tolist(), length.tolist(), strict=True)]
        offsets = np.append(head, len(chosen)).astype(np.int32)
        return pa.table({
            "shard": pa.array([shard] * len(head), pa.int64()), "anchor": pa.array(table.column("anchor").to_numpy()[mine], pa.int64()), "words": pa.array(phrases, pa.binary()),
            "firsts": pa.ListArray.from_arrays(pa.array(offsets), pa.array(firsts, pa.int64())),
        })

    return work


def _located(size: int):
    """Streams segments of one shard through the automaton of its phrases: (doc_id, stamp, places) of each segment with occurrences to remove."""

    def work(segments: pa.Table, phrases: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for text, firsts in zip(phrases.column("words").to_pylist(), phrases.column("firsts").to_pylist(), strict=True):
            s = tuple([numbers.setdefault(w, len(numbers) + 1) for w in text.split()])
            automaton.add_word(s, firsts)
        kept: list[int] = []
        places: list[list[int]] = []
        if len(automaton):
            automaton.make_automaton()
            number = numbers.get
            met: dict[bytes, list[tuple[int, list[int]]]] = {}  # equal segments meet the same phrases
            docs, starts = segments.column("doc_id").to_pylist(), segments.column("place").to_pylist()
            for r, text in enumerate(segments.column("words").to_pylist()):
                if (hits := met.get(text)) is None:
                    hits = met[text] = [(end - size - len(firsts) + 2, firsts) for end, firsts in automaton.iter(tuple([number(w, 0) for w in text.split()]))]
                if mine := [starts[r] + at + i for at, firsts in hits for i, first in enumerate(firsts) if first < docs[r]]:
                    kept.append(r)
                    places.append(mine)
        rows = pa.array(kept, pa.int64())
        return pa.table({"doc_id": segments.column("doc_id").take(rows), "stamp": segments.column("stamp").take(rows), "places": pa.array(places, pa.list_(pa.int32()))})

    return work


def repeated_places(docs: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, stamp, places): per row of docs with any, the starts of its windows whose words also start in a document with a smaller doc_id. stamp is xxhash64(text)."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("stamp"))
    anchors = rows.select("doc_id", "text").mapInArrow(lean(_anchor_rows(size)), "anchor long, doc_id long")
    groups = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    recurring = stored(groups.where("low < high").select("anchor", (F.col("n") > HOT).alias("hot")), "anchors")
    schema = "anchor long, doc_id long, stamp long, place int, words binary"
    if recurring.count() <= BROADCAST_ANCHORS:
        table = recurring.toArrow()
        value, hot = table.column("anchor").to_numpy(), table.column("hot").to_numpy()
        order = np.argsort(value)
        segments = rows.mapInArrow(lean(_segment_rows(size, spark.sparkContext.broadcast((value[order], hot[order].astype(bool))))), schema)
    else:
        held = anchors.join(recurring, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hots"))
        segments = rows.join(held, "doc_id").select("doc_id", "text", "stamp", "anchors", "hots").mapInArrow(lean(_segment_rows(size, None)), schema)
    segments = stored(segments, "segments")
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-segments.count() // SHARD_SEGMENTS))))
    # One exchange, by shard, serves both groupings.
    merged = segments.select("anchor", "words", "doc_id").mapInArrow(lean(_combined), "anchor long, words binary, low long, high long")
    distinct = merged.withColumn("shard", shard).repartition("shard").groupBy("shard", "anchor", "words").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    confirmed = distinct.groupBy("shard").applyInArrow(lean_group(_confirmed(size)), "shard long, anchor long, words binary, firsts array<bigint>")
    phrases = stored(confirmed, "phrases")
    matter = stored(phrases.groupBy("anchor").agg(F.min(F.array_min("firsts")).alias("first")), "confirmed")
    if matter.count() <= BROADCAST_ANCHORS:
        table = matter.toArrow()
        value, first = table.column("anchor").to_numpy(), table.column("first").to_numpy()
        order = np.argsort(value)
        streams = segments.mapInArrow(lean(_matching(spark.sparkContext.broadcast((value[order], first[order])))), schema)
    else:
        streams = segments.join(matter, "anchor").where("doc_id > first").drop("first")
    streams = streams.withColumn("shard", shard).drop("anchor")
    crowded = stored(segments.select(shard.alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("salts")).where("salts > 1"), "crowded")
    salts = F.coalesce("salts", F.lit(1))
    streams = streams.join(crowded, "shard", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), salts).cast("int")).select("shard", "salt", "doc_id", "stamp", "place", "words")
    keys = phrases.join(crowded, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("shard", "salt", "words", "firsts")
    hits = streams.groupBy("shard", "salt").cogroup(keys.groupBy("shard", "salt")).applyInArrow(lean_cogroup(_located(size)), "doc_id long, stamp long, places array<int>")
    return hits.groupBy("doc_id", "stamp").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"))


def _covered(n: int, places: list[int], size: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    at = np.array(places, np.int64)
    steps[at] += 1
    np.subtract.at(steps, np.minimum(at + size, n), 1)
    return np.cumsum(steps[:n]) > 0


def without_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """Every row of `docs` (doc_id, text, ...) with its columns, n_words, n_removed and kept_text.

    A word goes if it is in a window of `size` words that also starts in a
    document with a smaller doc_id, judged on the input. Words are runs
    without ASCII white space, unchanged; kept_text joins what stays by one space.

    A null text has no words (kept_text empty); a text of fewer words than a
    window loses none. A null doc_id neither loses words nor is a source.
    Rows that share a doc_id are one document: none is a source for the other.
    The row's own columns named n_words, n_removed or kept_text are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    names, kinds = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    key, stamp, hits = "__key", "__stamp", "__places"
    places = stored(repeated_places(docs, size).toDF(key, stamp, hits), "places")
    marked, columns = docs.withColumns({key: F.col("doc_id"), stamp: F.xxhash64("text")}), [F.col(f"`{n}`") for n in names]
    both = marked.join(places, [key, stamp], "left").select(*columns, hits)
    if places.count() <= BROADCAST_ANCHORS:
        losing = F.broadcast(places.select(key, stamp))
        some = marked.join(losing, [key, stamp], "left_semi").join(places, [key, stamp]).select(*columns, hits)
        both = some.unionByName(marked.join(losing, [key, stamp], "left_anti").select(*columns, F.lit(None).cast("array<int>").alias(hits)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, kept = [], [], []
            for text, hit in zip(batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()), batch.column(batch.num_columns - 1), strict=True):
                words = (text.as_py() or b"").split()
                counts.append(len(words))
                if hit.is_valid:
                    stay = np.flatnonzero(~_covered(len(words), hit.as_py(), size)).tolist()
                    gone.append(len(words) - len(stay))
                    words = [words[i] for i in stay]
                else:
                    gone.append(0)
                kept.append(b" ".join(words))
            text = pa.array(kept, pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), text.cast(pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])

    return both.mapInArrow(lean(work), f"{kinds}, n_words long, n_removed long, kept_text string")
