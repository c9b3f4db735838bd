"""Registered queries over a quad table made of the star schema, and the SQL of their results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.graphs import XSD, Quads

from .translate import define, evaluate, register_aggregate, register_service

EX = "http://ex/"
P = f"PREFIX ex: <{EX}> PREFIX xsd: <{XSD}> "


def quads(spark: SparkSession, sf_dir: str) -> Quads:
    """Customers in the default graph; the tree n -> n / 2 of nations there and in the graphs g0, g1, g2 (by number), with names of even ones."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customer, nation = read("customer"), read("nation")
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    typed = lambda c, t: F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^<{XSD}{t}>'))
    node = lambda tag, c: F.concat(F.lit(EX + tag), c.cast("string"))
    half = F.floor(n / 2).cast("long")

    def part(table: DataFrame, s, p: str, o, g=None) -> DataFrame:
        return table.select((F.lit(None) if g is None else g).cast("string").alias("g"), s.alias("s"), F.lit(EX + p).alias("p"), o.alias("o"))

    c, m = node("c", k), node("n", n)
    in_graph = node("g", n % 3)
    return Quads(reduce(DataFrame.unionByName, [
        part(customer, c, "balance", typed(F.col("c_acctbal").cast("decimal(18,2)"), "decimal")), part(customer, c, "name", F.col("c_name")),
        part(customer, c, "segment", F.concat(F.lit('"'), F.col("c_mktsegment"), F.when(k % 2 == 0, '"@en-GB').otherwise('"@de'))),
        part(customer, c, "nation", node("n", F.col("c_nationkey"))), part(customer, c, "mixed", F.when(k % 3 == 0, F.lit("abc")).otherwise(typed(k, "integer"))),
        part(customer.where("c_custkey % 5 = 0"), c, "flag", typed(F.when(k % 2 == 0, "true").otherwise("false"), "boolean")),
        part(customer.where("c_custkey % 10 = 1"), c, "near", F.concat(F.lit("_:b"), k.cast("string"))),
        part(customer.where("c_custkey % 10 = 1"), F.concat(F.lit("_:b"), k.cast("string")), "far", F.lit("away")),
        part(nation.where("n_nationkey > 0"), m, "up", node("n", half)), part(nation.where("n_nationkey > 0"), m, "up", node("n", half), in_graph),
        part(nation.where("n_nationkey % 2 = 0"), m, "label", F.col("n_name"), in_graph),
    ]))


_C, _N = "'http://ex/c' || c_custkey", "'http://ex/n' || n_nationkey"
_UP = "up AS (SELECT n_nationkey AS a, n_nationkey // 2 AS b, n_nationkey % 3 AS g FROM nation WHERE n_nationkey > 0)"
_REACH = f"WITH RECURSIVE {_UP}, r AS (SELECT a, b FROM up UNION SELECT r.a, up.b FROM r JOIN up ON r.b = up.a)"
_URI = lambda c, tag="n": f"'http://ex/{tag}' || {c}"

#: name -> (query text, SQL)
TEXT: dict[str, tuple[str, str]] = {
    "prefixed_pattern": (P + "SELECT ?c ?n WHERE { ?c ex:nation ?n ; ex:name ?x FILTER(STRENDS(?x, '7')) }", f"SELECT {_C} AS c, {_URI('c_nationkey')} AS n FROM customer WHERE c_name LIKE '%7'"),
    "base_iri": (f"BASE <{EX}> SELECT ?x WHERE {{ <c7> <name> ?x }}", "SELECT c_name AS x FROM customer WHERE c_custkey = 7"),
    "numeric_filter_mixed_terms": (P + "SELECT ?c WHERE { ?c ex:mixed ?v FILTER(?v > 50 && ?v <= 90.5) }", f"SELECT {_C} AS c FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey BETWEEN 51 AND 90"),
    "typed_terms_compared": (P + "SELECT ?a ?b WHERE { ?a ex:mixed ?x . ex:c100 ex:mixed ?b FILTER(?x < ?b && ?x > 89) }", f"SELECT {_C} AS a, '\"100\"^^<{XSD}integer>' AS b FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey BETWEEN 90 AND 99"),
    "literal_forms": (P + "SELECT ?c WHERE { { ?c ex:mixed 7 } UNION { ?c ex:segment 'BUILDING'@de } UNION { ?c ex:flag true } UNION { ?c ex:mixed '8'^^xsd:integer } }", f"SELECT {_C} AS c FROM customer WHERE c_custkey = 7 UNION ALL SELECT {_C} FROM customer WHERE c_custkey % 2 = 1 AND c_mktsegment = 'BUILDING' UNION ALL SELECT {_C} FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT {_C} FROM customer WHERE c_custkey = 8"),
    "term_functions": (P + "SELECT ?c (LANG(?s) AS ?l) (DATATYPE(?b) AS ?t) (STR(?s) AS ?plain) (isIRI(?c) AS ?i) (isLITERAL(?b) AS ?lit) (isBLANK(?c) AS ?blank) (hasLANG(?s) AS ?has) (langMATCHES(LANG(?s), 'en') AS ?en) (STRLEN(?s) AS ?len) (DATATYPE(?s) AS ?ls) (isURI(?s) AS ?u) WHERE { ?c ex:segment ?s ; ex:balance ?b }", f"SELECT {_C} AS c, CASE WHEN c_custkey % 2 = 0 THEN 'en-GB' ELSE 'de' END AS l, '{XSD}decimal' AS t, c_mktsegment AS plain, true AS i, true AS lit, false AS blank, true AS has, c_custkey % 2 = 0 AS en, CAST(length(c_mktsegment) AS BIGINT) AS len, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' AS ls, false AS u FROM customer"),
    "term_constructors": (P + "SELECT ?c (STRDT(?n, 'http://t') AS ?d) (STRLANG(?n, 'fr') AS ?l) (IRI('http://a/b', 'x') AS ?i) (URI('http://a/b', 'http://z/') AS ?u) (BNODE(?n) = BNODE(?n) AS ?same) (SUBJECT(TRIPLE(?c, 'p', ?n)) AS ?s) (PREDICATE(TRIPLE(?c, 'p', ?n)) AS ?p) (OBJECT(TRIPLE(?c, 'p', ?n)) AS ?o) (isTRIPLE(TRIPLE(?c, 'p', ?n)) AS ?t) (sameTERM(?n, ?n) AS ?st) (isTRIPLE(?n) AS ?nt) WHERE { ?c ex:name ?n }", f"SELECT {_C} AS c, '\"' || c_name || '\"^^<http://t>' AS d, '\"' || c_name || '\"@fr' AS l, 'http://a/x' AS i, 'http://z/' AS u, true AS same, {_C} AS s, 'p' AS p, c_name AS o, true AS t, true AS st, false AS nt FROM customer"),
    "same_value_term": (P + "SELECT ?c (sameVALUE(?v, 7.0) AS ?v7) (sameTERM(?v, ?none) AS ?error) (sameTERM(?v, ?v) AS ?self) WHERE { ?c ex:mixed ?v FILTER(sameVALUE(?v, 7)) }", f"SELECT {_C} AS c, true AS v7, NULL::BOOLEAN AS error, true AS self FROM customer WHERE c_custkey = 7"),
    "ebv_filter": (P + "SELECT ?c WHERE { ?c ex:flag ?f FILTER(?f) }", f"SELECT {_C} AS c FROM customer WHERE c_custkey % 10 = 0"),
    "not_filter": (P + "SELECT ?c WHERE { ?c ex:flag ?f FILTER(!?f || STRLEN(STR(?c)) > 1000) }", f"SELECT {_C} AS c FROM customer WHERE c_custkey % 10 = 5"),
    "exists_expression": (P + "SELECT ?c (EXISTS { ?c ex:flag ?f } AS ?flagged) WHERE { ?c ex:balance ?b FILTER(NOT EXISTS { ?c ex:near ?x } && (?b > 9000 || EXISTS { ?c ex:flag ?f })) }", f"SELECT {_C} AS c, c_custkey % 5 = 0 AS flagged FROM customer WHERE c_custkey % 10 <> 1 AND (c_acctbal > 9000 OR c_custkey % 5 = 0)"),
    "graph_path": (P + "SELECT ?a ?b WHERE { GRAPH ex:g1 { ?a ex:up+ ?b } }", f"WITH RECURSIVE {_UP}, r AS (SELECT a, b FROM up WHERE g = 1 UNION SELECT r.a, up.b FROM r JOIN up ON r.b = up.a AND up.g = 1) SELECT {_URI('a')} AS a, {_URI('b')} AS b FROM r"),
    "graph_variable_path": (P + "SELECT ?g ?a ?b WHERE { GRAPH ?g { ?a ex:up+ ?b } }", f"WITH RECURSIVE {_UP}, r AS (SELECT g, a, b FROM up UNION SELECT r.g, r.a, up.b FROM r JOIN up ON r.b = up.a AND up.g = r.g) SELECT {_URI('g', 'g')} AS g, {_URI('a')} AS a, {_URI('b')} AS b FROM r"),
    "graph_optional": (P + "SELECT ?g ?a ?l WHERE { GRAPH ?g { ?a ex:up ?b OPTIONAL { ?a ex:label ?l } } }", f"SELECT {_URI('(n_nationkey % 3)', 'g')} AS g, {_N} AS a, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS l FROM nation WHERE n_nationkey > 0"),
    "graph_group": (P + "SELECT ?g ?n WHERE { GRAPH ?g { { SELECT (COUNT(*) AS ?n) WHERE { ?a ex:up ?b MINUS { ?a ex:label ?l } } } } }", f"SELECT {_URI('(n_nationkey % 3)', 'g')} AS g, count(*) AS n FROM nation WHERE n_nationkey > 0 AND n_nationkey % 2 = 1 GROUP BY 1"),
    "graph_names": ("SELECT ?g WHERE { GRAPH ?g { } }", "SELECT * FROM (VALUES ('http://ex/g0'), ('http://ex/g1'), ('http://ex/g2')) t(g)"),
    "from_named": (P + "SELECT ?a ?l ?g FROM ex:g0 FROM NAMED ex:g0 FROM NAMED ex:g1 WHERE { ?a ex:up ?b GRAPH ?g { ?b ex:label ?l } }", f"SELECT {_URI('x.n_nationkey')} AS a, y.n_name AS l, {_URI('(y.n_nationkey % 3)', 'g')} AS g FROM nation x JOIN nation y ON y.n_nationkey = x.n_nationkey // 2 WHERE x.n_nationkey > 0 AND x.n_nationkey % 3 = 0 AND y.n_nationkey % 2 = 0 AND y.n_nationkey % 3 < 2"),
    "path_plus_hops": (P + "SELECT ?a ?b WHERE { ?a ex:up+ ?b }", f"{_REACH} SELECT {_URI('a')} AS a, {_URI('b')} AS b FROM r"),
    "path_nation_up": (P + "SELECT ?c ?b WHERE { ?c ex:nation/ex:up* ?b FILTER(?b != ex:n0) }", f"{_REACH} SELECT {_C} AS c, {_URI('b')} AS b FROM customer JOIN (SELECT a, b FROM r UNION SELECT n_nationkey, n_nationkey FROM nation) ON a = c_nationkey WHERE b <> 0"),
    "path_star_from": (P + "SELECT ?b WHERE { ex:n24 ex:up* ?b }", f"{_REACH} SELECT {_URI('b')} AS b FROM r WHERE a = 24 UNION ALL SELECT 'http://ex/n24'"),
    "path_plus_to": (P + "SELECT ?a WHERE { ?a ex:up+ ex:n3 }", f"{_REACH} SELECT {_URI('a')} AS a FROM r WHERE b = 3"),
    "path_zero_length": (P + "SELECT ?b WHERE { ex:nowhere ex:up* ?b }", "SELECT 'http://ex/nowhere' AS b"),
    "path_zero_given": (P + "SELECT ?x WHERE { VALUES ?x { 1 } ex:nowhere ex:up? ex:nowhere }", "SELECT CAST(1 AS BIGINT) AS x"),
    "path_maybe": (P + "SELECT ?b WHERE { ex:n9 ex:up? ?b }", "SELECT 'http://ex/n9' AS b UNION ALL SELECT 'http://ex/n4'"),
    "path_fixed_times": (P + "SELECT ?a ?b WHERE { ?a ex:up{2} ?b }", f"WITH {_UP} SELECT {_URI('x.a')} AS a, {_URI('y.b')} AS b FROM up x JOIN up y ON x.b = y.a"),
    "path_range_times": (P + "SELECT ?b WHERE { ex:n24 ex:up{1,3} ?b }", "SELECT 'http://ex/n' || x AS b FROM (VALUES (12), (6), (3)) t(x)"),
    "path_open_times": (P + "SELECT ?b WHERE { ex:n24 ex:up{2,} ?b }", "SELECT 'http://ex/n' || x AS b FROM (VALUES (6), (3), (1), (0)) t(x)"),
    "path_inverse": (P + "SELECT ?a ?b WHERE { ?a ^ex:up ?b }", f"WITH {_UP} SELECT {_URI('b')} AS a, {_URI('a')} AS b FROM up"),
    "path_negated": (P + "SELECT ?o WHERE { ex:c20 !(ex:name|ex:balance|ex:segment|ex:mixed) ?o }", f"SELECT {_URI('c_nationkey')} AS o FROM customer WHERE c_custkey = 20 UNION ALL SELECT '\"true\"^^<{XSD}boolean>'"),
    "path_negated_inverse": (P + "SELECT ?o WHERE { ex:n1 !(^ex:nation) ?o }", f"WITH {_UP} SELECT {_URI('a')} AS o FROM up WHERE b = 1"),
    "path_shortest": (P + "SELECT ?a ?b WHERE { ?a SHORTEST(ex:up+) ?b }", f"{_REACH} SELECT {_URI('a')} AS a, {_URI('b')} AS b FROM r"),
    "path_multi": (P + "SELECT ?b (COUNT(*) AS ?n) WHERE { ?a MULTI((ex:up|ex:up)+) ?b } GROUP BY ?b", f"WITH RECURSIVE {_UP}, r AS (SELECT a, b, 2 AS n FROM up UNION ALL SELECT r.a, up.b, r.n * 2 FROM r JOIN up ON r.b = up.a) SELECT {_URI('b')} AS b, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1"),
    "optional_unbound_join": (P + "SELECT ?a ?l ?x WHERE { VALUES (?a ?l) { (1 'p') (2 UNDEF) (UNDEF 'q') (3 'r') } OPTIONAL { VALUES (?a ?l ?x) { (1 'p' 10) (2 's' 20) (UNDEF 'q' 30) (1 UNDEF 40) (4 'z' 50) } } }", "WITH l(a,l) AS (VALUES (1,'p'),(2,NULL),(NULL,'q'),(3,'r')), r(a,l,x) AS (VALUES (1,'p',10),(2,'s',20),(NULL,'q',30),(1,NULL,40),(4,'z',50)) SELECT CAST(coalesce(l.a,r.a) AS BIGINT) AS a, coalesce(l.l,r.l) AS l, CAST(x AS BIGINT) AS x FROM l LEFT JOIN r ON (l.a=r.a OR l.a IS NULL OR r.a IS NULL) AND (l.l=r.l OR l.l IS NULL OR r.l IS NULL)"),
    "minus_unbound": (P + "SELECT ?a ?l WHERE { VALUES (?a ?l) { (1 'p') (2 UNDEF) (UNDEF 'q') (3 'r') (UNDEF UNDEF) } MINUS { VALUES (?a ?l) { (1 UNDEF) (UNDEF 'q') (3 'other') } } }", "SELECT CAST(a AS BIGINT) AS a, l FROM (VALUES (2,NULL),(3,'r'),(NULL,NULL)) t(a,l)"),
    "semi_unbound": (P + "SELECT ?a ?l WHERE { VALUES (?a ?l) { (1 'p') (2 UNDEF) (5 'w') (3 'r') } SEMIJOIN { VALUES (?a ?l) { (1 UNDEF) (2 's') (3 'other') (UNDEF 'w') } } }", "SELECT CAST(a AS BIGINT) AS a, l FROM (VALUES (1,'p'),(2,NULL),(5,'w')) t(a,l)"),
    "anti_unbound": (P + "SELECT ?a ?l WHERE { VALUES (?a ?l) { (1 'p') (2 UNDEF) (5 'w') (3 'r') } ANTIJOIN { VALUES (?a ?l) { (1 UNDEF) (2 's') (3 'other') (UNDEF 'w') } } }", "SELECT CAST(a AS BIGINT) AS a, l FROM (VALUES (3,'r')) t(a,l)"),
    "minus_rows": (P + "SELECT ?c WHERE { ?c ex:name ?n MINUS { ?c ex:flag ?f } }", f"SELECT {_C} AS c FROM customer WHERE c_custkey % 5 <> 0"),
    "not_exists_rows": (P + "SELECT ?c WHERE { ?c ex:name ?n FILTER NOT EXISTS { ?c ex:near ?x } }", f"SELECT {_C} AS c FROM customer WHERE c_custkey % 10 <> 1"),
    "let_retest": (P + "SELECT ?c ?n WHERE { ?c ex:name ?n LET(?n := CONCAT('Customer#', '000000007')) }", f"SELECT {_C} AS c, c_name AS n FROM customer WHERE c_name = 'Customer#000000007'"),
    "construct_triples": (P + "CONSTRUCT { ?n ex:down ?c . ?n a ex:Nation } WHERE { ?c ex:nation ?n }", f"SELECT {_URI('c_nationkey')} AS s, 'http://ex/down' AS p, {_C} AS o FROM customer UNION SELECT {_URI('c_nationkey')}, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://ex/Nation' FROM customer"),
    "ask_yes": (P + "ASK { ?c ex:flag true }", "SELECT true AS answer"),
    "ask_no": (P + "ASK { ?c ex:flag 'maybe' }", "SELECT false AS answer"),
    "describe_closure": (P + "DESCRIBE ex:c11", f"SELECT {_C} AS s, 'http://ex/' || p AS p, o FROM customer, LATERAL (VALUES ('balance', '\"' || CAST(c_acctbal AS DECIMAL(18,2)) || '\"^^<{XSD}decimal>'), ('name', c_name), ('segment', '\"' || c_mktsegment || '\"@de'), ('nation', {_URI('c_nationkey')}), ('mixed', '\"11\"^^<{XSD}integer>'), ('near', '_:b11')) t(p, o) WHERE c_custkey = 11 UNION ALL SELECT '_:b11', 'http://ex/far', 'away'"),
    "describe_variable": (P + "DESCRIBE ?n WHERE { ?n ex:up ex:n0 }", "SELECT 'http://ex/n1' AS s, 'http://ex/up' AS p, 'http://ex/n0' AS o"),
    "json_rows": (P + 'JSON { "customer" : ?c , "name" : ?n } WHERE { ?c ex:name ?n ; ex:flag true }', "SELECT '{\"customer\":\"' || 'http://ex/c' || c_custkey || '\",\"name\":\"' || c_name || '\"}' AS json FROM customer WHERE c_custkey % 10 = 0"),
    "user_aggregate": (P + "SELECT ?n (ex:spread(?v) AS ?spread) WHERE { ?c ex:nation ?n ; ex:mixed ?v } GROUP BY ?n", f"SELECT {_URI('c_nationkey')} AS n, CAST(max(c_custkey) FILTER (c_custkey % 3 <> 0) - min(c_custkey) FILTER (c_custkey % 3 <> 0) AS DOUBLE) AS spread FROM customer GROUP BY 1"),
    "user_function": (P + "SELECT ?c (ex:twice(?v) AS ?w) WHERE { ?c ex:mixed ?v }", f"SELECT {_C} AS c, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey * 2 AS DOUBLE) END AS w FROM customer"),
    "service_source": (P + "SELECT ?a ?b WHERE { ?a ex:up ?m SERVICE ex:here { ?m ex:up ?b } SERVICE SILENT ex:absent { ?m ex:never ?z } }", f"WITH {_UP} SELECT {_URI('x.a')} AS a, {_URI('y.b')} AS b FROM up x JOIN up y ON x.b = y.a"),
    "aggregate_errors": (P + "SELECT ?n (COUNT(?v + 1) AS ?numbers) (SUM(?v) AS ?sum) (MIN(?v) AS ?any) WHERE { ?c ex:nation ?n ; ex:mixed ?v FILTER(?v != 'abc') } GROUP BY ?n", f"SELECT {_URI('c_nationkey')} AS n, count(*) AS numbers, CAST(sum(c_custkey) AS DOUBLE) AS sum, min('\"' || c_custkey || '\"^^<{XSD}integer>') AS any FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1"),
    "group_key_error": (P + "SELECT ?k (COUNT(*) AS ?n) WHERE { ?c ex:mixed ?v } GROUP BY ((?v + 0) / 1 > 100 AS ?k)", "SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_custkey > 100 END AS k, count(*) AS n FROM customer GROUP BY 1"),
}


def _spread(v):
    number = F.regexp_extract(v, r'^"(.*)"', 1).try_cast("double")
    return F.max(number) - F.min(number)


def _text(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = quads(spark, sf_dir)
        register_service(EX + "here", source)
        register_aggregate("spread", _spread)
        define("twice", ["x"], "?x * 2")
        return evaluate(source, TEXT[name][0])

    return run


def union_default_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the named graphs as default graph: there are labels in it, which the default graph has not."""
    return evaluate(quads(spark, sf_dir), P + "SELECT ?a ?l WHERE { ?a ex:up ?b ; ex:label ?l }", union_default=True)


#: Requests applied in order to the quads of the nations' tree.
REQUESTS = """PREFIX ex: <http://ex/>
INSERT DATA { ex:a ex:p 'one' . GRAPH ex:new { ex:a ex:p 2 , 'drei'@de } } ;
DELETE DATA { ex:n1 ex:up ex:n0 } ;
DELETE WHERE { GRAPH ex:g2 { ?s ex:label ?l } } ;
WITH ex:g1 DELETE { ?s ex:up ?o } INSERT { ?o ex:down ?s } WHERE { ?s ex:up ?o } ;
INSERT { GRAPH ex:seen { ?s ex:was ?o } } USING ex:g0 WHERE { ?s ex:up ?o } ;
CREATE GRAPH ex:empty ;
ADD ex:g0 TO ex:sum ; ADD ex:g2 TO ex:sum ;
COPY ex:g2 TO ex:copied ;
MOVE ex:new TO ex:moved ;
CLEAR GRAPH ex:g0 ;
DROP GRAPH ex:g2"""

UPDATE_SQL = f"""WITH t AS (SELECT n_nationkey AS n, n_name AS l FROM nation), q AS (
SELECT CAST(NULL AS VARCHAR) AS g, 'http://ex/n' || n AS s, 'http://ex/up' AS p, 'http://ex/n' || n // 2 AS o FROM t WHERE n > 1
UNION ALL SELECT NULL, 'http://ex/a', 'http://ex/p', 'one'
UNION ALL SELECT 'http://ex/moved', 'http://ex/a', 'http://ex/p', '2' UNION ALL SELECT 'http://ex/moved', 'http://ex/a', 'http://ex/p', '"drei"@de'
UNION ALL SELECT 'http://ex/g1', 'http://ex/n' || n // 2, 'http://ex/down', 'http://ex/n' || n FROM t WHERE n % 3 = 1 AND n > 0
UNION ALL SELECT 'http://ex/g1', 'http://ex/n' || n, 'http://ex/label', l FROM t WHERE n % 3 = 1 AND n % 2 = 0
UNION ALL SELECT 'http://ex/seen', 'http://ex/n' || n, 'http://ex/was', 'http://ex/n' || n // 2 FROM t WHERE n % 3 = 0 AND n > 0
UNION ALL SELECT 'http://ex/sum', 'http://ex/n' || n, 'http://ex/up', 'http://ex/n' || n // 2 FROM t WHERE n % 3 <> 1 AND n > 0
UNION ALL SELECT 'http://ex/sum', 'http://ex/n' || n, 'http://ex/label', l FROM t WHERE n % 3 = 0 AND n % 2 = 0
UNION ALL SELECT 'http://ex/copied', 'http://ex/n' || n, 'http://ex/up', 'http://ex/n' || n // 2 FROM t WHERE n % 3 = 2 AND n > 0)
SELECT g, s, p, o FROM q"""


def update_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .update import update

    whole = quads(spark, sf_dir)
    return update(Quads(whole.df.where(F.col("p").isin(EX + "up", EX + "label"))), REQUESTS).df.select("g", "s", "p", "o")


def update_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLEAR DEFAULT leaves named graphs, DROP NAMED what was put into the default graph afterwards."""
    from .update import update

    whole = quads(spark, sf_dir)
    return update(whole, "PREFIX ex: <http://ex/> CLEAR DEFAULT ; COPY ex:g1 TO DEFAULT ; DROP NAMED").df.select("g", "s", "p", "o")


def ntriples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' triples written as N-Triples text and read back."""
    import uuid

    from quillon.sources.graphs import read_nquads, write_ntriples
    from quillon.sources.shared import folder

    path = f"{folder(spark)}/quillon-ntriples-{uuid.uuid4().hex}"
    source = quads(spark, sf_dir)
    write_ntriples(source.df.where(F.col("g").isNull() & F.col("p").isin(EX + "segment", EX + "nation", EX + "name")), path)
    return read_nquads(spark, path).select("s", "p", "o")


FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "union_default_graph": (union_default_graph, f"SELECT {_N} AS a, n_name AS l FROM nation WHERE n_nationkey > 0 AND n_nationkey % 2 = 0"),
    "update_requests": (update_requests, UPDATE_SQL),
    "update_targets": (update_targets, "SELECT CAST(NULL AS VARCHAR) AS g, 'http://ex/n' || n_nationkey AS s, 'http://ex/up' AS p, 'http://ex/n' || n_nationkey // 2 AS o FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT NULL, 'http://ex/n' || n_nationkey, 'http://ex/label', n_name FROM nation WHERE n_nationkey % 3 = 1 AND n_nationkey % 2 = 0"),
    "ntriples_round_trip": (ntriples_round_trip, f"SELECT {_C} AS s, 'http://ex/name' AS p, c_name AS o FROM customer UNION ALL SELECT {_C}, 'http://ex/nation', {_URI('c_nationkey')} FROM customer UNION ALL SELECT {_C}, 'http://ex/segment', '\"' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '\"@en-GB' ELSE '\"@de' END FROM customer"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _text(name) for name in TEXT} | {name: f for name, (f, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in TEXT.items()} | {name: sql for name, (_, sql) in FUNCTIONS.items() if sql}
