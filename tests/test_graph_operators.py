"""Updates, entailment and shapes on small graphs."""

from pyspark.sql import functions as F

from quillon.operators.inference import DOMAIN, RANGE, SUB_CLASS, SUB_PROPERTY, TYPE, forward, rdfs
from quillon.operators.shapes import Shape, validate
from quillon.plans.update import update
from quillon.sources.graphs import Quads

QUADS, TRIPLES = "g string, s string, p string, o string", "s string, p string, o string"


def _all(source):
    return sorted((r.g or "", r.s, r.p, r.o) for r in source.df.collect())


def test_updates(spark, tmp_path):
    q = update(Quads(spark.createDataFrame([], QUADS)), "INSERT DATA { <a> <p> 1 ; <q> 'x' . GRAPH <g> { <b> <p> 2 } } ; DELETE DATA { <a> <q> 'x' }")
    assert _all(q) == [("", "a", "p", "1"), ("g", "b", "p", "2")]
    q = update(q, "INSERT { ?s <twice> ?o . GRAPH <h> { ?s <seen> ?none } } WHERE { ?s <p> ?o }")
    assert _all(q) == [("", "a", "p", "1"), ("", "a", "twice", "1"), ("g", "b", "p", "2")]
    q = update(q, "DELETE { ?s <twice> ?o } INSERT { ?s <once> ?o } WHERE { ?s <twice> ?o }")
    assert _all(q) == [("", "a", "once", "1"), ("", "a", "p", "1"), ("g", "b", "p", "2")]
    assert _all(update(q, "DELETE WHERE { ?s <once> ?o }")) == [("", "a", "p", "1"), ("g", "b", "p", "2")]
    assert _all(update(q, "WITH <g> DELETE { ?s <p> ?o } INSERT { ?s <r> ?o } WHERE { ?s <p> ?o }"))[-1] == ("g", "b", "r", "2")
    assert len(_all(update(q, "ADD <g> TO DEFAULT"))) == 4
    assert _all(update(q, "COPY <g> TO DEFAULT")) == [("", "b", "p", "2"), ("g", "b", "p", "2")]
    assert _all(update(q, "MOVE DEFAULT TO <g> ; CREATE GRAPH <z>")) == [("g", "a", "once", "1"), ("g", "a", "p", "1")]
    assert len(_all(update(q, "CLEAR NAMED"))) == 2 and _all(update(q, "DROP SILENT ALL")) == []
    (tmp_path / "x.nt").write_text("<http://s> <http://p> <http://o> .\n")
    assert _all(update(q, f"LOAD <file://{tmp_path}/x.nt> INTO GRAPH <http://l>"))[-1] == ("http://l", "http://s", "http://p", "http://o")
    assert len(_all(update(q, "LOAD SILENT <file:///nowhere/at/all>"))) == 3


def test_rdfs(spark):
    rows = [("A", SUB_CLASS, "B"), ("B", SUB_CLASS, "C"), ("p", SUB_PROPERTY, "q"), ("q", DOMAIN, "A"), ("q", RANGE, "R"), ("x", "p", "y"), (None, "p", "z"), ("x", "p", "y")]
    got = {tuple(r) for r in rdfs(spark.createDataFrame(rows, TRIPLES)).collect()}
    new = {("A", SUB_CLASS, "C"), ("x", "q", "y"), ("x", TYPE, "A"), ("x", TYPE, "B"), ("x", TYPE, "C"), ("y", TYPE, "R")}
    assert got == {r for r in rows if r[0]} | new
    assert rdfs(spark.createDataFrame([], TRIPLES)).count() == 0


def test_forward_rules(spark):
    rows = [("a", "next", "b"), ("b", "next", "c"), ("c", "next", "a"), ("a", "age", "7"), ("b", "age", "30")]
    rules = ["[step: (?x next ?y) -> (?x far ?y)]", "[(?x far ?y) (?y far ?z) notEqual(?x, ?z) -> (?x far ?z)]", "[(?x age ?n) greaterThan(?n, 18) -> (?x is adult)]"]
    got = {tuple(r) for r in forward(spark.createDataFrame(rows, TRIPLES), rules).collect()}
    assert {(x, y) for x, p, y in got if p == "far"} == {(x, y) for x in "abc" for y in "abc" if x != y}
    assert {(x, y) for x, p, y in got if p == "is"} == {("b", "adult")}


def test_shapes(spark):
    rows = [("http://a", TYPE, "P"), ("http://b", TYPE, "P"), ("http://a", "age", "30"), ("http://a", "name", '"Ann"@en'), ("http://a", "name", '"Anna"@en'), ("http://b", "age", "x"), ("http://b", "age", "200"), ("http://b", "max", "100"), ("http://b", "knows", "http://a"), ("http://a", "knows", "n")]
    df = spark.createDataFrame(rows, TRIPLES)
    found = lambda path, **c: sorted((r.focus[-1], r.value) for r in validate(df, [Shape(path, c, target_class="P")]).collect())
    assert found("age", maxCount=1) == [("b", None)] and found("name", minCount=1) == [("b", None)]
    assert found("age", minInclusive=0) == [("b", "x")] and found("age", maxExclusive=200) == [("b", "200"), ("b", "x")]
    assert found("age", pattern="^[0-9]+$") == [("b", "x")] and found("age", lessThan="max") == [("b", "200"), ("b", "x")]
    assert found("name", uniqueLang=True) == [("a", None)] and found("name", maxLength=3) == [("a", '"Anna"@en')] and found("name", languageIn=["en"]) == []
    assert found("knows", **{"class": "P"}) == [("a", "n")] and found("knows", nodeKind="IRI") == [("a", "n")]
    assert found("age", hasValue="30") == [("b", None)] and found("age", **{"in": ["30", "200"]}) == [("b", "x")]
    assert found("max", equals="age") == [("a", "30"), ("b", "100"), ("b", "200"), ("b", "x")] and found("max", disjoint="age") == []
    assert found(None, closed=["age", "name", "max"]) == [("a", "n"), ("b", "http://a")]
    adult, named = Shape("age", {"minInclusive": 18}), Shape("name", {"minCount": 1})
    assert found(None, node=adult) == [("b", "http://b")] and found(None, **{"not": named}) == [("a", "http://a")]
    assert found(None, **{"and": [adult, named]}) == [("b", "http://b")] == found(None, **{"or": [adult, named]})
    assert found(None, xone=[adult, named]) == [("a", "http://a"), ("b", "http://b")]
    assert found("knows", qualified=(named, 1, None)) == [("a", None)]
    assert validate(df.limit(0), [Shape("age", {"minCount": 1}, target_class="P")]).count() == 0


def test_lists(spark):
    import pytest

    from quillon.operators.lists import FIRST, NIL, REST, list_lengths, list_members

    rows = []
    for name, members in (("a", "xyzxw"), ("b", "q")):
        for i, m in enumerate(members):
            rows += [(f"{name}{i}", FIRST, m), (f"{name}{i}", REST, f"{name}{i + 1}" if i + 1 < len(members) else NIL)]
    df = spark.createDataFrame([*rows, (None, FIRST, "n"), rows[0]], TRIPLES)
    assert sorted(map(tuple, list_members(df).collect())) == [*[("a0", i, m) for i, m in enumerate("xyzxw")], ("b0", 0, "q")]
    assert sorted(map(tuple, list_lengths(df).collect())) == [("a0", 5), ("b0", 1)]
    assert list_members(df.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        list_members(spark.createDataFrame([("a", FIRST, "x"), ("a", REST, "b"), ("b", FIRST, "y"), ("b", REST, "a")], TRIPLES), rounds=4)
