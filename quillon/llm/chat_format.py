"""Chat formatting with offset-aligned masks (operator 8).

A conversation becomes one string of marked turns. It is encoded once, with the
byte offsets of its tokens; the sorted spans of assistant texts are intersected
with the token spans by binary search, which gives the loss mask. What is to be
learned is read back from mask and offsets. Control strings inside texts are
escaped by a backslash, reversibly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_lengths, encoder

# The template.
OPEN, CLOSE, COLON = "### ", "</turn>", ": "
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{OPEN}{escape(role).replace(':', chr(92) + ':')}{COLON}{escape(text)}{CLOSE}\n" for role, text in turns)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """role, text, and where the (escaped) text starts and ends in the formatted string."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        found.append((unescape(m[1]), unescape(m[2]), *m.span(2)))
        at = m.end()
    return found


def token_ends(ids: np.ndarray, path: str) -> np.ndarray:
    """Byte offset at which each token of a text ends; it starts where the one before ends."""
    return np.cumsum(byte_lengths(path)[ids])


def mask(ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Loss mask (0 or 1) of tokens that end at these bytes: those that share a byte with one of the sorted spans, by binary search."""
    marks = np.zeros(len(ends), np.int8)
    for lo, hi in spans:
        if lo < hi:
            # From the first token that ends behind lo to the one that holds byte hi - 1.
            marks[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, hi, "left") + 1] = 1
    return marks


def byte_spans(formatted: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted character spans as byte spans of the UTF-8 text."""
    out, at, size = [], 0, 0
    for lo, hi in spans:
        size += len(formatted[at:lo].encode())
        start, size = size, size + len(formatted[lo:hi].encode())
        out.append((start, size))
        at = hi
    return out


def under_mask(raw: bytes, ends: np.ndarray, marks: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """The unescaped text that the masked tokens cover, without what they hold of the template beside a learned span. A token masked outside every span shows in full."""
    on = np.flatnonzero(marks)
    if not len(on):
        return ""
    starts = ends - np.diff(ends, prepend=0)
    first = on[np.concatenate([[True], np.diff(on) > 1])]
    last = on[np.concatenate([np.diff(on) > 1, [True]])]
    out = []
    begin, close = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    for lo, hi in zip(starts[first].tolist(), ends[last].tolist(), strict=True):
        near = spans[int(np.searchsorted(close, lo, "right")) : int(np.searchsorted(begin, hi, "left"))]
        inside = [(max(lo, a), min(hi, b)) for a, b in near]
        out.append("".join(unescape(raw[a:b].decode(errors="replace")) for a, b in inside or [(lo, hi)]))
    return "".join(out)


def format_conversations(rows: DataFrame, tokenizer: str, learn: str = "assistant") -> DataFrame:
    """One row per conv_id of `rows` (conv_id, turn, role, text): conv_id, formatted, ids, loss_mask (by token), turns (read back: role, text), loss_text (read back under the mask).

    Turns go by turn, then role and text. A null text or role is empty, a null
    turn comes first. Rows without conv_id are conversations of one turn each.
    Repeated rows are turns of their own. Other columns are not looked at.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = known.unionByName(rows.where("conv_id is null").select("conv_id", F.array(turn).alias("turns")))
    talk = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, special=False)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [render([(t["role"], t["text"]) for t in turns]) for turns in part.column(1).to_pylist()]
                ids, masks, back, loss = [], [], [], []
                for text in texts:
                    found = np.frombuffer(encode(text), "<u4").astype(np.int32)
                    turns, ends = parse(text), token_ends(found, tokenizer)
                    spans = byte_spans(text, [(a, b) for role, _, a, b in turns if role == learn])
                    marks = mask(ends, spans)
                    ids.append(found)
                    masks.append(marks)
                    back.append([{"role": role, "text": own} for role, own, _, _ in turns])
                    loss.append(under_mask(text.encode(), ends, marks, spans))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8())), pa.array(back, talk), pa.array(loss, pa.string())], names=["conv_id", "formatted", "ids", "loss_mask", "turns", "loss_text"])

    return grouped.mapInArrow(work, "conv_id long, formatted string, ids array<int>, loss_mask array<tinyint>, turns array<struct<role:string,text:string>>, loss_text string")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of format_conversations' rows."""
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
