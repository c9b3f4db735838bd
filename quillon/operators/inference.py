"""Entailment over triples: RDFS by closures and joins, and forward rules to a fixed point."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import algebra as A
from quillon.sources.shared import stored

# Names of the vocabulary.
RDF, RDFS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
TYPE, SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE = RDF + "type", RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"


def rdfs(triples: DataFrame) -> DataFrame:
    """s, p, o with everything that sub-classes, sub-properties, domains and ranges entail, each triple once.

    The schema's two hierarchies are closed on their own, then the data pass
    once through properties, domains and ranges, and classes: no loop over the
    data. Nulls entail nothing; literals get no type from a range only if they
    carry quotes.
    """
    triples = triples.select("s", "p", "o").dropna().distinct()
    edges = lambda p: triples.where(F.col("p") == p).select("s", "o")
    properties, classes = A.closure(edges(SUB_PROPERTY)), A.closure(edges(SUB_CLASS))
    lifted = triples.join(properties.toDF("p", "__q"), "p").select("s", F.col("__q").alias("p"), "o")
    facts = triples.unionByName(lifted).distinct()
    typed = lambda p, end: facts.join(edges(p).toDF("p", "__c"), "p").select(F.col(end).alias("s"), F.lit(TYPE).alias("p"), F.col("__c").alias("o")).where(~F.startswith("s", F.lit('"')))
    facts = facts.unionByName(typed(DOMAIN, "s")).unionByName(typed(RANGE, "o"))
    types = facts.where(F.col("p") == TYPE).join(classes.toDF("o", "__c"), "o").select("s", "p", F.col("__c").alias("o"))
    closed = [c.select("s", F.lit(p).alias("p"), "o") for c, p in ((classes, SUB_CLASS), (properties, SUB_PROPERTY))]
    return reduce(DataFrame.unionByName, [facts, types, *closed]).distinct()


_TERM = re.compile(r"\?\w+|<[^>]*>|'[^']*'|[^\s(),]+")


def _patterns(text: str) -> list[tuple]:
    found = []
    for call, inner in re.findall(r"(\w*)\(([^()]*)\)", text):
        terms = [("var", t[1:]) if t.startswith("?") else ("lit", t.strip("<>'")) for t in _TERM.findall(inner)]
        found.append((call or None, terms))
    return found


def parse_rule(text: str) -> tuple[list[tuple], list[tuple]]:
    """`[name: (?a p ?b) (?b p ?c) notEqual(?a, ?c) -> (?a p ?c)]` to body and head."""
    inner = re.sub(r"^\w+:\s+", "", text.strip().strip("[]").strip())
    body, head = inner.split("->")
    return _patterns(body), _patterns(head)


def _number(c):
    return F.regexp_extract(c, r'^"?([-+0-9.eE]+)"?', 1).try_cast("double")


_blank = lambda c: F.startswith(c, F.lit("_:"))
_literal = lambda c: ~_blank(c) & ~c.contains("://")
BUILTINS = {
    "equal": lambda a, b: a == b, "notEqual": lambda a, b: a != b, "lessThan": lambda a, b: _number(a) < _number(b), "greaterThan": lambda a, b: _number(a) > _number(b), "le": lambda a, b: _number(a) <= _number(b), "ge": lambda a, b: _number(a) >= _number(b),
    "isBNode": _blank, "notBNode": lambda a: ~_blank(a), "isLiteral": _literal, "notLiteral": lambda a: ~_literal(a), "bound": lambda *a: reduce(lambda x, y: x & y, [v.isNotNull() for v in a]), "unbound": lambda *a: reduce(lambda x, y: x & y, [v.isNull() for v in a]),
}


def _scan(triples: DataFrame, terms: list[tuple]) -> DataFrame:
    cond, seen = F.lit(True), {}
    for name, (kind, value) in zip("spo", terms, strict=True):
        c = F.col(name)
        if kind == "lit":
            cond = cond & (c == value)
        elif value in seen:
            cond = cond & (c == seen[value])
        else:
            seen[value] = c
    return triples.where(cond).select(*[c.alias(v) for v, c in seen.items()] or [F.lit(True).alias("__unit")])


def _fired(rule: tuple[list, list], every: DataFrame, new: DataFrame) -> DataFrame:
    """What the rule derives with at least one new triple in its body."""
    body, head = rule
    scans = [terms for call, terms in body if call is None]
    parts = []
    for fresh in range(len(scans)):
        order = [fresh, *[i for i in range(len(scans)) if i != fresh]]
        rows = None
        while order:
            at = next((i for i in order if rows is None or any(k == "var" and v in rows.columns for k, v in scans[i])), order[0])
            order.remove(at)
            rows = A.Solutions(_scan(new if at == fresh else every, scans[at])).df if rows is None else A.join(A.Solutions(rows), A.Solutions(_scan(every, scans[at]))).df
        value = lambda t, rows=rows: (F.col(f"`{t[1]}`") if t[1] in rows.columns else F.lit(None).cast("string")) if t[0] == "var" else F.lit(t[1])
        for call, terms in body:
            if call is not None:
                if call not in BUILTINS:
                    raise ValueError(f"unknown builtin {call}")
                rows = rows.where(BUILTINS[call](*[value(t) for t in terms]))
        parts += [rows.select(*[value(t).alias(n) for n, t in zip("spo", terms, strict=True)]) for _, terms in head]
    return reduce(DataFrame.unionByName, parts).dropna().distinct()


def forward(triples: DataFrame, rules: list[str], rounds: int = 100) -> DataFrame:
    """s, p, o closed under forward rules. Semi-naive: each round joins only with what the last one added, and is written to the shared folder. Raises if it does not settle."""
    parsed = [parse_rule(r) for r in rules]
    every = new = stored(triples.select("s", "p", "o").dropna().distinct(), "rules")
    for _ in range(rounds):
        made = reduce(DataFrame.unionByName, [_fired(r, every, new) for r in parsed]).distinct()
        new = stored(made.join(every, ["s", "p", "o"], "left_anti"), "rules")
        if new.isEmpty():
            return every
        every = every.unionByName(new)
    raise RuntimeError(f"rules did not settle in {rounds} rounds")
