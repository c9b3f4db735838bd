"""Language ID by nearest centroid (operator 3).

A text is a TF-IDF vector of hashed byte n-grams (2 to 4 bytes of the UTF-8
text; A-Z lowered, what is no letter is a space), of unit length. Each
language has CENTROIDS spherical k-means centroids. A text takes the language of
the centroid of greatest cosine; it is rejected if it lies farther from it, by a
margin, than all but a hundredth of that language's training texts of its size.
Short texts have low cosines by nature, so sizes (numbers of distinct n-grams)
have bounds of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import give_back, lean, small_batches
from .words import flat_text, mix, row_chunks

DIM, GRAMS, CENTROIDS, STEPS = 4096, (2, 3, 4), 4, 12
#: Bound of the sample that is fitted on, per language; which rows is decided by a hash of doc_id.
SAMPLE = 1000
#: A text is rejected below the share MARGIN of the quantile QUANTILE of training texts' cosines. A quantile is taken of ROWS rows at least.
MARGIN, QUANTILE, ROWS = 0.75, 0.01, 100
#: Classes of size (half powers of two) and steps of cosine that training texts are counted by.
SIZES, FINE = 2 * DIM.bit_length(), 1000
#: Rows and bytes of text that are counted at once: DIM numbers a row, some ten numbers a byte.
CHUNK_ROWS, CHUNK_BYTES = 128, 1 << 18
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[:128] = 32
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # n x DIM, unit rows
    idf: np.ndarray
    least: np.ndarray  # rejection bound of each centroid and class of size


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n-gram counts (rows x DIM); grams do not cross rows, runs of spaces count once."""
    seg = _CLASS[data[int(offsets[0]) : int(offsets[-1])]]
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    if len(seg):
        keep = np.ones(len(seg), bool)
        keep[1:] = (seg[1:] != 32) | (seg[:-1] != 32) | (row[1:] != row[:-1])
        seg, row = seg[keep], row[keep]
    total = np.zeros(rows * DIM)
    for n in GRAMS:
        if len(seg) < n:
            break
        m = len(seg) - n + 1
        code = np.full(m, n, np.uint64)
        for j in range(n):
            code = code * np.uint64(257) + seg[j : m + j]
        ok = row[:m] == row[n - 1 :]
        total += np.bincount(row[:m][ok] * DIM + (mix(code[ok]) % np.uint64(DIM)).astype(np.int64), minlength=rows * DIM)
    return total.reshape(rows, DIM)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def _clusters(x: np.ndarray) -> np.ndarray:
    """Spherical k-means from a farthest-first start; clusters left empty are dropped."""
    picks = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[picks[0]]
    while len(picks) < min(CENTROIDS, len(x)):
        picks.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picks[-1]])
    centre = x[picks]
    for _ in range(STEPS):
        mine = (x @ centre.T).argmax(axis=1)
        centre = _unit(np.stack([x[mine == k].sum(axis=0) for k in range(len(centre)) if (mine == k).any()]))
    return centre


def _cosines(found: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Cosines with all centroids, and the class of size, of rows of n-gram counts."""
    size = np.maximum((found > 0).sum(axis=1), 1)
    return _unit(np.sqrt(found) * m.idf) @ m.centroids.T, (2 * np.log2(size)).astype(int)


def _views(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """Each row's bytes as numbers, without a copy."""
    out = []
    for chunk in column.chunks:
        data, offsets = flat_text(chunk)
        out += [data[a:b].view(kind) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return out


def _lettered(texts: pa.Array) -> np.ndarray:
    return np.array([t.is_valid and _LETTER.search(t.as_py()) is not None for t in texts], bool)


def _bounds(seen: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Per language the bound of each class of size, of counts of training texts by class and step of cosine.

    A class with fewer than ROWS texts of the language takes those of all
    languages, and if these are too few, shorter ones too.
    """
    every = sum(seen.values())

    def bound(own: np.ndarray, k: int) -> float:
        rows = own[k] if own[k].sum() >= ROWS else every[k]
        while rows.sum() < ROWS and k > 0:
            k -= 1
            rows = rows + every[k]
        n = int(rows.sum())
        if not n:
            return 0.0
        # The least row of all never sets a bound, unless it is alone.
        return MARGIN * int((np.cumsum(rows) > min(max(1, QUANTILE * n), n - 1)).argmax()) / FINE

    return {name: np.array([bound(own, k) for k in range(SIZES)]) for name, own in seen.items()}


def _seen(rows: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """Per language its rows with letters, counted by class of size and cosine with the language's nearest centroid.

    Texts that are themselves a centroid are left out: they tell no distance.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        columns = {name: [k for k, n in enumerate(m.languages) if n == name] for name in m.languages}
        total = {name: np.zeros(SIZES * FINE, np.int64) for name in columns}
        for batch in batches:
            data, offsets = flat_text(batch.column(0))
            for a, b in row_chunks(offsets, CHUNK_BYTES, CHUNK_ROWS):
                cosine, size = _cosines(counts(data, offsets[a : b + 1]), m)
                lang, ok = np.array(batch.column(1).slice(a, b - a).to_pylist(), object), _lettered(batch.column(0).slice(a, b - a))
                for name, mine in columns.items():
                    r = np.flatnonzero(ok & (lang == name))
                    near = cosine[np.ix_(r, mine)].max(axis=1)
                    r, near = r[near < 0.9999], near[near < 0.9999]
                    total[name] += np.bincount(size[r] * FINE + (near * FINE).astype(int), minlength=SIZES * FINE)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "at", "n"])

    out = {name: np.zeros((SIZES, FINE), np.int64) for name in model.languages}
    parts = rows.select("text", "lang").mapInArrow(lean(work), "lang string, at int, n long")
    with small_batches(rows.sparkSession):
        found = parts.groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()  # at most languages x SIZES x FINE rows
    for r in found:
        out[r.lang][r.at // FINE, r.at % FINE] = r.n
    return out


def fit(docs: DataFrame) -> Model | None:
    """A model of rows (doc_id, text, lang), all of them labelled; None if there is none with a letter in it.

    Centroids are fitted on at most about SAMPLE rows of a language, chosen by a
    hash of doc_id; rejection bounds on all rows. Languages are assumed to be few enough for the driver (as labels are).
    """
    rows = docs.where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    grain = 1_000_000
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(grain, SAMPLE * grain // n))])
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(grain)) < share[F.col("lang")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(1))
            for a, b in row_chunks(offsets, CHUNK_BYTES, CHUNK_ROWS):
                found = counts(data, offsets[a : b + 1])
                spots = [np.flatnonzero(r) for r in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([s.astype(np.uint16).tobytes() for s in spots], pa.binary()), pa.array([r[s].astype(np.float32).tobytes() for r, s in zip(found, spots, strict=True)], pa.binary())], names=["doc_id", "lang", "spots", "grams"])

    with small_batches(docs.sparkSession):
        table = picked.select("doc_id", "text", "lang").mapInArrow(lean(work), "doc_id long, lang string, spots binary, grams binary").orderBy("doc_id", "lang", "grams").toArrow()
    lang = np.array(table.column("lang").to_pylist(), object)
    spots, grams = _views(table.column("spots"), np.uint16), _views(table.column("grams"), np.float32)
    if not any(len(s) for s in spots):
        return None
    idf = np.log((1 + len(spots)) / (1 + np.bincount(np.concatenate(spots), minlength=DIM))) + 1
    names, centres = [], []
    for name in sorted(sizes):
        mine = [i for i in np.flatnonzero(lang == name) if len(spots[i])]
        if not mine:
            continue
        x = np.zeros((len(mine), DIM), np.float32)
        for r, i in enumerate(mine):
            x[r, spots[i]] = grams[i]
        x = _unit(np.sqrt(x) * idf)
        c = _clusters(x)
        names += [name] * len(c)
        centres.append(c)
    if not names:
        return None
    model = Model(names, np.concatenate(centres), idf, np.zeros((len(names), SIZES)))
    del table, spots, grams, x
    give_back()
    bounds = _bounds(_seen(rows, model))
    model.least = np.stack([bounds[name] for name in names])
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, lang_pred, score (the cosine, 0 to 1), accepted.

    A text that is null or has no letter, or any text if there is no model, is
    `und` with score 0 and not accepted. Texts are read whole. doc_id may be
    null or repeated; other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # centroids: languages x CENTROIDS x DIM numbers, none per document

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            data, offsets = flat_text(batch.column(1))
            for a, b in row_chunks(offsets, CHUNK_BYTES, CHUNK_ROWS):
                lettered = _lettered(batch.column(1).slice(a, b - a))
                if m is None:
                    lettered[:] = False
                    best, score, ok = np.zeros(b - a, int), np.zeros(b - a), lettered
                else:
                    cosine, size = _cosines(counts(data, offsets[a : b + 1]), m)
                    best = cosine.argmax(axis=1)
                    score = np.where(lettered, np.clip(cosine[np.arange(b - a), best], 0, 1), 0)
                    ok = lettered & (score >= m.least[best, size])
                names = [m.languages[k] if t else "und" for k, t in zip(best, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(lean(work), "doc_id long, lang_pred string, score double, accepted boolean")


def held_out(doc_id: str = "doc_id"):
    """Rows that a model is never fitted on: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
