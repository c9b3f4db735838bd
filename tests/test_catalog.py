"""Registered queries against their SQL, and the parts behind them."""

import math

import duckdb
import pytest

from quillon.plans import catalog
from quillon.plans.syntax import parse
from quillon.plans.translate import evaluate
from quillon.sources.graphs import Quads, read_nquads, write_ntriples

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 5) if isinstance(v, float) else v


#: Of the later catalogs one query a family; all of them are compared with their SQL on the larger table by the driver.
FEW = "prefixed_pattern typed_terms_compared literal_forms exists_expression graph_variable_path graph_optional graph_group from_named path_nation_up path_star_from path_zero_length path_multi optional_unbound_join minus_unbound describe_closure update_requests ntriples_round_trip user_aggregate user_function service_source operators_wide strings_wide dates_wide aggregates_wide lists_wide divjoin_right_filter shape_constraints".split()


@pytest.mark.parametrize("name", sorted({*catalog.TEXT, *catalog.FUNCTIONS, *FEW} & catalog.oracle_sql().keys()))
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert sorted(repr([_plain(r[n]) for n in names]) for r in got.collect()) == sorted(repr([_plain(r[i]) for i in at]) for r in want.fetchall())


def test_parser_rejects_what_it_cannot_read():
    for text in ("SELECT ?x WHERE { ?x :p }", "SELECT WHERE", "SELECT ?x WHERE { ?x :p ?y } LIMIT 3 nonsense"):
        with pytest.raises((ValueError, IndexError)):
            parse(text)


def test_quads_paths_and_forms(spark, tmp_path):
    a = lambda x: f"http://x/{x}"
    rows = [(None, a("z1"), "http://x/p", a("z2")), (None, a("z2"), "http://x/p", a("z3")), (None, a("z3"), "http://x/p", a("z1")), ("http://g", a("z1"), "http://x/q", "v")]
    source = Quads(spark.createDataFrame(rows, "g string, s string, p string, o string"))
    assert evaluate(source, "SELECT ?a ?b WHERE { ?a <http://x/p>+ ?b }").count() == 9
    assert evaluate(source, "SELECT ?a ?b WHERE { ?a <http://x/p>/<http://x/p> ?b }").count() == 3
    assert evaluate(source, "SELECT ?a ?b WHERE { ?a ^<http://x/p> ?b }").count() == 3
    assert evaluate(source, "ASK { ?a <http://x/p> ?a }").first().answer is False
    assert [r.g for r in evaluate(source, "SELECT ?g WHERE { GRAPH ?g { ?s <http://x/q> 'v' } }").collect()] == ["http://g"]
    made = evaluate(source, "CONSTRUCT { ?b <http://x/inv> ?a } WHERE { ?a <http://x/p> ?b }")
    assert made.count() == 3
    write_ntriples(made, str(tmp_path / "out"))
    assert sorted(map(tuple, read_nquads(spark, str(tmp_path / "out")).select("s", "p", "o").collect())) == sorted(map(tuple, made.collect()))
    extra = spark.createDataFrame([(None, a("n"), "http://x/p", a("m"))], "g string, s string, p string, o string")
    assert source.insert(extra).df.count() == 5 and source.insert(extra).delete(extra).df.count() == 4


def test_fold_and_unbound_order(spark):
    source = Quads(spark.createDataFrame([], "g string, s string, p string, o string"))
    got = evaluate(source, "SELECT (FOLD(?k, ?v ORDER BY ?n) AS ?m) WHERE { VALUES (?k ?v ?n) { ('a' 'x' 1) ('a' 'y' 2) ('b' 'z' 3) } }").first().m
    assert got == {"a": "y", "b": "z"}
    rows = evaluate(source, "SELECT ?x WHERE { VALUES ?x { 2 UNDEF 1 } } ORDER BY ?x").collect()
    assert [r.x for r in rows] == [None, 1, 2]


def test_unbound_joins_stay_hash_or_merge_joins(spark):
    from quillon.operators import algebra as A

    side = lambda n: A.Solutions(spark.range(n).selectExpr("nullif(id % 7, 3) AS a", "nullif(id % 5, 2) AS b", "id AS c"), frozenset("ab"))
    left, right = side(50), A.Solutions(side(40).df.drop("c"), frozenset("ab"))
    plan = A.left_join(left, right).df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line.split("Join ", 1)[1] for line in plan.splitlines() if "Join " in line]
    assert joins and not any("isnull" in j.lower().replace("isnotnull", "") for j in joins)  # equal keys, no "or unbound"
    got = sorted(map(tuple, A.minus(left, right).df.collect()), key=repr)
    rows = [tuple(r) for r in left.df.collect()]
    other = [tuple(r) for r in right.df.collect()]
    fits = lambda x, y: all(p is None or q is None or p == q for p, q in zip(x, y, strict=False)) and any(p is not None and q is not None for p, q in zip(x, y, strict=False))
    assert got == sorted((x for x in rows if not any(fits(x[:2], y) for y in other)), key=repr)


def test_malformed_lines_are_told(spark, tmp_path):
    from quillon.sources.graphs import malformed_lines

    (tmp_path / "x.nt").write_text('<a:a> <a:b> "c" .\n# comment\n\n<a:a> oops .\n')
    assert [r.value for r in malformed_lines(spark, str(tmp_path / "x.nt")).collect()] == ["<a:a> oops ."]
    assert read_nquads(spark, str(tmp_path / "x.nt")).count() == 1
