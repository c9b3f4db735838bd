"""Text queries by scan: only what a query names is counted, so no index and no shuffle of words."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
_PART = re.compile(r'([+-]?)(?:"([^"]*)"|(\S+))')


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _count(tokens: Column, part: str, phrase: bool) -> Column:
    if phrase:
        wanted = re.findall(r"[^\W_]+", part.lower())
        if not wanted:
            return F.lit(0)
        here = lambda w, i: reduce(lambda a, b: a & b, [F.get(tokens, i + k).eqNullSafe(x) for k, x in enumerate(wanted)])
        return F.size(F.filter(tokens, here))
    part = part.lower()
    if part.endswith("*"):
        return F.size(F.filter(tokens, lambda w: F.startswith(w, F.lit(part[:-1]))))
    if (fuzzy := re.fullmatch(r"(.+)~(\d?)", part)) is not None:
        return F.size(F.filter(tokens, lambda w: F.levenshtein(w, F.lit(fuzzy[1]), int(fuzzy[2] or 2)) >= 0))
    return F.size(F.filter(tokens, lambda w: w == part))


def text_query(docs: DataFrame, key: str, text: str, query: str, limit: int | None = None) -> DataFrame:
    """key and score (BM25) of matching rows; the best `limit`, if given, ties to the smaller key.

    Parts of a query: word, prefix*, word~ or word~1 (edit distance), "a phrase";
    +part must and -part must not occur; without + one part at least occurs.
    Null texts match nothing. Statistics are of all rows: one row of counts is
    read first, one number a part.
    """
    parts = [(m[1], m[2] if m[2] is not None else m[3], m[2] is not None) for m in _PART.finditer(query)]
    if not any(sign != "-" for sign, _, _ in parts):
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    tokens = words(F.col(text))
    counted = docs.select(key, F.size(tokens).alias("__n"), *[_count(tokens, p, phrase).alias(f"__c{i}") for i, (_, p, phrase) in enumerate(parts)])
    seen = counted.agg(F.count_if(F.col("__n") >= 0).alias("n"), F.avg(F.when(F.col("__n") >= 0, F.col("__n"))).alias("size"), *[F.count_if(F.col(f"__c{i}") > 0).alias(f"d{i}") for i in range(len(parts))]).first()
    size = seen["size"] or 1.0
    score, any_, cond = F.lit(0.0), F.lit(False), F.lit(True)
    for i, (sign, _, _) in enumerate(parts):
        tf = F.greatest(F.col(f"__c{i}"), F.lit(0))
        if sign == "-":
            cond = cond & (tf == 0)
            continue
        idf = math.log(1 + (seen["n"] - seen[f"d{i}"] + 0.5) / (seen[f"d{i}"] + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__n") / size))
        any_ = any_ | (tf > 0)
        if sign == "+":
            cond = cond & (tf > 0)
    out = counted.where(cond & any_).select(key, score.alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)
