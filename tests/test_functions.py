"""Functions, paths and casts of the query language."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import distributions as D
from quillon.functions.builtins import sample
from quillon.plans.translate import evaluate
from quillon.sources.graphs import Quads

NONE = "g string, s string, p string, o string"
CASES = [
    ("fn:string-length('a\\u00e9x')", 3), ("fn:normalize-space(' a  b ')", "a b"), ("fn:round-half-to-even(2.5)", 2.0), ("fn:round(2.345, 2)", 2.35), ("fn:ceiling(1.2)", 2.0),
    ("op:numeric-integer-divide(-7, 2)", -3), ("op:numeric-mod(-7, 2)", -1), ("IDIV(7, 0)", None), ("afn:substr('abcdef', 1, 3)", "bc"), ("afn:localname('http://x/y#z')", "z"), ("afn:namespace('http://x/y#z')", "http://x/y#"),
    ("afn:max(2, 3)", 3), ("afn:strjoin('-', 'a', 'b')", "a-b"), ("afn:sprintf('%d:%s', 3, 'x')", "3:x"), ("lfn:log(8, 2)", 3.0), ("lfn:log(100)", 2.0), ("lfn:pythagoras(3, 4)", 5.0), ("lfn:root(27, 3)", 3.0), ("lfn:cartesian(0, 0, 3, 4)", 5.0),
    ("fn:days-from-duration('P3DT4H')", 3), ("fn:hours-from-duration('-P3DT4H')", -4), ("fn:minutes-from-duration('PT4H5M')", 5), ("fn:months-from-duration('P1Y2M')", 2), ("fn:seconds-from-duration('PT1.5S')", 1.5),
    ("isIRI('http://x')", True), ("isIRI('x y')", False), ("isBLANK('_:a')", True), ("isLITERAL('text')", True), ("LANG(STRLANG('a', 'en-GB'))", "en-GB"), ("langMATCHES('en-GB', 'EN')", True), ("langMATCHES('', '*')", False),
    ("DATATYPE(3)", "http://www.w3.org/2001/XMLSchema#integer"), ("DATATYPE(STRDT('3', 'http://t'))", "http://t"), ("fn:not('')", True), ("fn:boolean(0)", False), ("SUBJECT(TRIPLE('a', 'b', 'c'))", "a"), ("isTRIPLE(TRIPLE('a', 'b', 'c'))", True),
    ("cdt:size(cdt:concat(cdt:List(1, 2), cdt:List(3)))", 3), ("cdt:get(cdt:merge(cdt:Map('a', 1), cdt:Map('a', 2, 'b', 3)), 'a')", 1), ("cdt:containsKey(cdt:remove(cdt:Map('a', 1), 'a'), 'a')", False), ("cdt:get(cdt:put(cdt:Map('a', 1), 'a', 5), 'a')", 5), ("cdt:contains(cdt:List(1, 2), 2)", True),
    ("CALL('http://x#sq', 3)", 9), ("SHA224('a')", "abd37534c7d9a2efb9465de931cd7055ffdb8879563ae98078d6d6d5"), ("IRI('http://x/a', 'b')", "http://x/b"), ("STRLEN(STRUUID())", 36),
]


def test_functions(spark):
    query = "SELECT " + " ".join(f"({text} AS ?v{i})" for i, (text, _) in enumerate(CASES)) + " WHERE { }"
    got = evaluate(Quads(spark.createDataFrame([], NONE)), query).first()
    for i, (text, want) in enumerate(CASES):
        assert (got[i] == pytest.approx(want) if isinstance(want, float) else got[i] == want), text


def test_paths(spark):
    rows = [(None, "a", "p", "b"), (None, "b", "p", "c"), (None, "c", "p", "d"), (None, "a", "q", "d"), (None, "a", "p", "e"), (None, "e", "p", "c")]
    source = Quads(spark.createDataFrame(rows, NONE))
    pairs = lambda path: sorted((r.x, r.y) for r in evaluate(source, f"SELECT ?x ?y WHERE {{ ?x {path} ?y }}").collect())
    assert pairs("<p>{2}") == [("a", "c"), ("a", "c"), ("b", "d"), ("e", "d")]
    assert pairs("DISTINCT(<p>{2})") == [("a", "c"), ("b", "d"), ("e", "d")]
    assert pairs("<p>{2,}") == [("a", "c"), ("a", "d"), ("b", "d"), ("e", "d")]
    assert len(pairs("<p>{,1}")) == 5 + 5
    assert pairs("!<p>") == [("a", "d")] and pairs("!(<p>|<q>)") == []
    assert pairs("!(^<p>)") == [("d", "a")]
    assert ("a", "d") in pairs("SHORTEST(<p>+)")


def test_samples(spark):
    df = spark.range(1).select(D.mixture((0.5, F.lit(-10.0), F.lit(1.0)), (0.5, F.lit(10.0), F.lit(1.0))).alias("g"))
    draws = [x[0] for x in df.select(sample(F.col("g"), F.lit(4000)).alias("x")).first().x]
    assert len(draws) == 4000 and abs(sum(draws) / 4000) < 0.6 and 0.45 < sum(x > 0 for x in draws) / 4000 < 0.55
    assert max(abs(abs(x) - 10) for x in draws) < 6
    assert draws == [x[0] for x in df.select(sample(F.col("g"), F.lit(4000)).alias("x")).first().x]


def test_divergence_modes(spark):
    g, h = D.gaussian(F.lit(0.0), F.lit(1.0)), D.gaussian(F.lit(0.5), F.lit(1.0))
    from quillon.functions.builtins import BUILTINS as B

    row = spark.range(1).select(B["jsdmode"](g, h, F.lit("GT_1K")).alias("j"), B["divergencetest"](g, h, F.lit(0.1), F.lit(0.05)).alias("t")).first()
    assert 0 < row.j < 0.1 and row.t
    with pytest.raises(Exception, match="unknown mode"):
        spark.range(1).select(B["jsdmode"](g, h, F.lit("nope"))).collect()
