"""Validation of triples against shapes: one row per violation."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inference import TYPE

VIOLATION = ["focus", "path", "constraint", "value"]


@dataclass
class Shape:
    """Targets select focus nodes (their union); constraints hold for the values of `path`, or for the nodes themselves without one.

    Constraints by name: class, datatype, nodeKind, minCount, maxCount,
    minInclusive, minExclusive, maxInclusive, maxExclusive, minLength,
    maxLength, pattern, languageIn, uniqueLang, equals, disjoint, lessThan,
    lessThanOrEquals, hasValue, in, closed (the predicates allowed), node, not,
    and, or, xone (a shape or shapes), qualified (shape, least, most).
    """

    path: str | None = None
    constraints: dict = field(default_factory=dict)
    target_class: str | None = None
    target_nodes: tuple[str, ...] = ()
    subjects_of: str | None = None
    objects_of: str | None = None


def _number(c: Column) -> Column:
    return F.regexp_extract(c, r'^"?([^"^@]*)"?', 1).try_cast("double")


def _lexical(c: Column) -> Column:
    return F.regexp_replace(c, r'^"(.*)"(@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', "$1")


_lang = lambda c: F.regexp_extract(c, r'^".*"@([A-Za-z0-9-]+)$', 1)
_blank = lambda c: F.startswith(c, F.lit("_:"))
_iri = lambda c: F.regexp(c, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s\"<>]+$"))


def _kind(c: Column, kind: str) -> Column:
    parts = {"IRI": _iri(c), "BlankNode": _blank(c), "Literal": ~_iri(c) & ~_blank(c)}
    return reduce(lambda a, b: a | b, [v for k, v in parts.items() if k.lower() in kind.lower()])


def _typed(c: Column, datatype: str) -> Column:
    given = F.regexp_extract(c, r'"\^\^<([^>]*)>$', 1)
    return F.when(given != "", given == datatype).otherwise(F.lit(datatype.endswith("#string")) & (_lang(c) == "") & _kind(c, "Literal"))


#: Checks of a single value: constraint -> (value, parameter) -> holds.
ONE = {
    "datatype": _typed, "nodeKind": _kind, "minInclusive": lambda c, v: _number(c) >= v, "minExclusive": lambda c, v: _number(c) > v, "maxInclusive": lambda c, v: _number(c) <= v, "maxExclusive": lambda c, v: _number(c) < v,
    "minLength": lambda c, v: F.char_length(_lexical(c)) >= v, "maxLength": lambda c, v: F.char_length(_lexical(c)) <= v, "pattern": lambda c, v: F.regexp(_lexical(c), F.lit(v)), "languageIn": lambda c, v: reduce(lambda a, b: a | b, [(F.lower(_lang(c)) == t.lower()) | F.startswith(F.lower(_lang(c)), F.lit(t.lower() + "-")) for t in v], F.lit(False)), "in": lambda c, v: c.isin(list(v)),
}


def _targets(triples: DataFrame, shape: Shape) -> DataFrame:
    parts = []
    if shape.target_class is not None:
        parts.append(triples.where((F.col("p") == TYPE) & (F.col("o") == shape.target_class)).select(F.col("s").alias("focus")))
    if shape.target_nodes:
        parts.append(triples.sparkSession.createDataFrame([(n,) for n in shape.target_nodes], "focus string"))
    if shape.subjects_of is not None:
        parts.append(triples.where(F.col("p") == shape.subjects_of).select(F.col("s").alias("focus")))
    if shape.objects_of is not None:
        parts.append(triples.where(F.col("p") == shape.objects_of).select(F.col("o").alias("focus")))
    if not parts:
        raise ValueError("a shape needs a target")
    return reduce(DataFrame.unionByName, parts).dropna().distinct()


def _bad(triples: DataFrame, nodes: DataFrame, shape: Shape) -> DataFrame:
    """Nodes (column `value`) that violate a shape."""
    return _violations(triples, nodes.select(F.col("value").alias("focus")).distinct(), shape).select(F.col("focus").alias("value")).distinct()


def _violations(triples: DataFrame, focus: DataFrame, shape: Shape) -> DataFrame:
    path = shape.path
    of = lambda p: triples.where(F.col("p") == p).select(F.col("s").alias("focus"), F.col("o").alias("value"))
    values = focus.select("focus", F.col("focus").alias("value")) if path is None else of(path).join(focus, "focus", "left_semi").distinct()
    out = []

    def add(rows: DataFrame, name: str, value: Column | None = None) -> None:
        out.append(rows.select("focus", F.lit(path).cast("string").alias("path"), F.lit(name).alias("constraint"), (F.lit(None) if value is None else value).cast("string").alias("value")).distinct())

    def count(rows: DataFrame) -> DataFrame:
        return focus.join(rows.groupBy("focus").agg(F.count("*").alias("n")), "focus", "left").select("focus", F.coalesce("n", F.lit(0)).alias("n"))

    for name, wanted in shape.constraints.items():
        value = F.col("value")
        if name in ONE:
            add(values.where(~F.coalesce(ONE[name](value, wanted), F.lit(False))), name, value)
        elif name == "class":
            typed = triples.where((F.col("p") == TYPE) & (F.col("o") == wanted)).select(F.col("s").alias("value"))
            add(values.join(typed, "value", "left_anti"), name, value)
        elif name in ("minCount", "maxCount"):
            add(count(values).where(F.col("n") < wanted if name == "minCount" else F.col("n") > wanted), name)
        elif name == "uniqueLang":
            add(values.withColumn("l", F.lower(_lang(value))).where("l <> ''").groupBy("focus", "l").count().where("count > 1"), name)
        elif name == "hasValue":
            add(focus.join(values.where(value == wanted), "focus", "left_anti"), name)
        elif name == "equals":
            other = of(wanted).join(focus, "focus", "left_semi").distinct()
            add(values.join(other, ["focus", "value"], "left_anti").unionByName(other.join(values, ["focus", "value"], "left_anti")), name, value)
        elif name == "disjoint":
            add(values.join(of(wanted), ["focus", "value"], "left_semi"), name, value)
        elif name in ("lessThan", "lessThanOrEquals"):
            # Each value must be below the least value of the other property, so no pairs are formed.
            least = of(wanted).groupBy("focus").agg(F.min(_number(value)).alias("m"))
            ok = _number(value) < F.col("m") if name == "lessThan" else _number(value) <= F.col("m")
            add(values.join(least, "focus").where(~F.coalesce(ok, F.lit(False))), name, value)
        elif name == "closed":
            extra = triples.join(focus, triples["s"] == focus["focus"], "left_semi").where(~F.col("p").isin([*wanted, TYPE]))
            add(extra.select(F.col("s").alias("focus"), F.col("o").alias("value")), name, value)
        elif name in ("node", "not", "and", "or", "xone"):
            shapes = [wanted] if isinstance(wanted, Shape) else list(wanted)
            failed = reduce(DataFrame.unionByName, [_bad(triples, values, s) for s in shapes]).groupBy("value").agg(F.count("*").alias("n"))
            held = len(shapes) - F.coalesce("n", F.lit(0))
            wrong = {"node": held < len(shapes), "and": held < len(shapes), "not": held > 0, "or": held < 1, "xone": held != 1}[name]
            add(values.join(failed, "value", "left").where(wrong), name, value)
        elif name == "qualified":
            inner, least, most = wanted
            n = count(values.join(_bad(triples, values, inner), "value", "left_anti"))
            add(n.where((F.col("n") < (least or 0)) | (F.col("n") > most if most is not None else F.lit(False))), name)
        else:
            raise ValueError(f"unknown constraint {name}")
    return reduce(DataFrame.unionByName, out) if out else focus.limit(0).select("focus", *[F.lit(None).cast("string").alias(c) for c in VIOLATION[1:]])


def validate(triples: DataFrame, shapes: list[Shape]) -> DataFrame:
    """focus, path, constraint, value of every violation, each once; value is null where the constraint is on the node's values as a whole."""
    triples = triples.select("s", "p", "o").dropna().distinct()
    return reduce(DataFrame.unionByName, [_violations(triples, _targets(triples, s), s) for s in shapes])
