"""Registered queries over the star schema and, for each, the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import distributions as D
from quillon.operators import algebra as A
from quillon.operators.divergence import divjoin
from quillon.sources.graphs import MappedTables

from . import catalog_families, catalog_terms
from .translate import evaluate

P, A1, A2, A3, A4, A5 = D.ERF


def _phi(z: str) -> str:
    t = f"(1/(1+{P}*abs({z})/sqrt(2.0)))"
    tail = f"(((((({A5}*{t}+({A4}))*{t}+{A3})*{t}+({A2}))*{t}+{A1})*{t})*exp(-({z})*({z})/2.0))"
    return f"(CASE WHEN ({z})>=0 THEN 1-{tail}/2 ELSE {tail}/2 END)"


#: name -> (query text, SQL)
TEXT: dict[str, tuple[str, str]] = {
    "bgp_star_join": ("SELECT ?name ?nation ?price WHERE { ?o a :orders ; :o_custkey ?c ; :o_totalprice ?price . ?c a :customer ; :c_name ?name ; :c_nationkey ?n . ?n a :nation ; :n_name ?nation FILTER(?price > 300000) }", "SELECT c_name AS name, n_name AS nation, o_totalprice AS price FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey WHERE o_totalprice > 300000"),
    "optional_condition": ("SELECT ?c ?o WHERE { ?c a :customer ; :c_acctbal ?b OPTIONAL { ?o a :orders ; :o_custkey ?c ; :o_totalprice ?p FILTER(?p > 200000 && ?b > 0) } }", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey=c_custkey AND o_totalprice > 200000 AND c_acctbal > 0"),
    "minus_shared": ("SELECT ?c WHERE { ?c a :customer ; :c_name ?n MINUS { ?o a :orders ; :o_custkey ?c } }", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey)"),
    "exists_filter": ("SELECT ?s ?n WHERE { ?s a :supplier ; :s_name ?n FILTER EXISTS { ?l a :lineitem ; :l_suppkey ?s ; :l_quantity ?q FILTER(?q > 49) } }", "SELECT s_suppkey AS s, s_name AS n FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey=s_suppkey AND l_quantity > 49)"),
    "not_exists_filter": ("SELECT ?c WHERE { ?c a :customer ; :c_acctbal ?b FILTER NOT EXISTS { ?o a :orders ; :o_custkey ?c ; :o_totalprice ?p FILTER(?p > ?b * 20) } }", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice > c_acctbal * 20)"),
    "semi_join": ("SELECT ?p WHERE { ?p a :part ; :p_size ?z SEMIJOIN { ?l a :lineitem ; :l_partkey ?p ; :l_discount ?d FILTER(?d >= 0.1) } }", "SELECT p_partkey AS p FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey=p_partkey AND l_discount >= 0.1)"),
    "anti_join": ("SELECT ?p WHERE { ?p a :part ; :p_size ?z ANTIJOIN { ?l a :lineitem ; :l_partkey ?p ; :l_discount ?d FILTER(?d >= 0.1) } }", "SELECT p_partkey AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey=p_partkey AND l_discount >= 0.1)"),
    "union_pad": ("SELECT ?n ?c ?s WHERE { { ?c a :customer ; :c_nationkey ?n } UNION { ?s a :supplier ; :s_nationkey ?n } }", "SELECT c_nationkey AS n, c_custkey AS c, NULL::BIGINT AS s FROM customer UNION ALL SELECT s_nationkey, NULL, s_suppkey FROM supplier"),
    "distinct_terms": ("SELECT DISTINCT ?m ?n WHERE { ?c a :customer ; :c_mktsegment ?m ; :c_nationkey ?n }", "SELECT DISTINCT c_mktsegment AS m, c_nationkey AS n FROM customer"),
    "top_n": ("SELECT ?o ?p WHERE { ?o a :orders ; :o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 25 OFFSET 5", "SELECT o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY p DESC, o LIMIT 25 OFFSET 5"),
    "values_undef_join": ("SELECT ?a ?b ?x WHERE { VALUES (?a ?b) { (1 UNDEF) (UNDEF 2) (3 3) } VALUES (?a ?b ?x) { (1 2 10) (3 UNDEF 20) (UNDEF 2 30) } }", "WITH l(a,b) AS (VALUES (1,NULL),(NULL,2),(3,3)), r(a,b,x) AS (VALUES (1,2,10),(3,NULL,20),(NULL,2,30)) SELECT CAST(coalesce(l.a,r.a) AS BIGINT) AS a, CAST(coalesce(l.b,r.b) AS BIGINT) AS b, CAST(x AS BIGINT) AS x FROM l JOIN r ON (l.a=r.a OR l.a IS NULL OR r.a IS NULL) AND (l.b=r.b OR l.b IS NULL OR r.b IS NULL)"),
    "lateral_top_k": ("SELECT ?c ?o ?p WHERE { ?c a :customer ; :c_mktsegment 'BUILDING' LATERAL { SELECT ?c ?o ?p WHERE { ?o a :orders ; :o_custkey ?c ; :o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 2 } }", "SELECT c, o, p FROM (SELECT c_custkey AS c, o_orderkey AS o, o_totalprice AS p, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM customer JOIN orders ON o_custkey=c_custkey WHERE c_mktsegment='BUILDING') WHERE k <= 2"),
    "group_having": ("SELECT ?seg (COUNT(*) AS ?n) (AVG(?b) AS ?avg) WHERE { ?c a :customer ; :c_mktsegment ?seg ; :c_acctbal ?b } GROUP BY ?seg HAVING (COUNT(*) > 10)", "SELECT c_mktsegment AS seg, count(*) AS n, avg(c_acctbal) AS avg FROM customer GROUP BY 1 HAVING count(*) > 10"),
    "group_expression": ("SELECT ?y (MAX(?p) AS ?top) (COUNT(DISTINCT ?c) AS ?customers) WHERE { ?o a :orders ; :o_orderdate ?d ; :o_totalprice ?p ; :o_custkey ?c } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, max(o_totalprice) AS top, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1"),
    "group_concat_sorted": ("SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?names) WHERE { ?x a :nation ; :n_regionkey ?r ; :n_name ?n } GROUP BY ?r", "SELECT n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "median_variance": ("SELECT ?f (MEDIAN(?q) AS ?med) (COUNT(?q) AS ?n) (MIN(?q) AS ?lo) (MAX(?q) AS ?hi) WHERE { ?l a :lineitem ; :l_returnflag ?f ; :l_quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, median(l_quantity) AS med, count(l_quantity) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1"),
    "mode_tie_max": ("SELECT ?b (MODE(?z) AS ?mode) WHERE { ?p a :part ; :p_brand ?b ; :p_size ?z } GROUP BY ?b", "SELECT b, max(z) AS mode FROM (SELECT p_brand AS b, p_size AS z, rank() OVER (PARTITION BY p_brand ORDER BY count(*) DESC) AS k FROM part GROUP BY 1, 2) WHERE k = 1 GROUP BY b"),
    "fold_list": ("SELECT ?r (FOLD(?k) AS ?list) WHERE { ?x a :nation ; :n_regionkey ?r ; :n_nationkey ?k } GROUP BY ?r", "SELECT n_regionkey AS r, list(n_nationkey ORDER BY n_nationkey) AS list FROM nation GROUP BY 1"),
    "sub_select": ("SELECT ?name ?total WHERE { ?c a :customer ; :c_name ?name { SELECT ?c (SUM(?p) AS ?total) WHERE { ?o a :orders ; :o_custkey ?c ; :o_totalprice ?p } GROUP BY ?c } FILTER(?total > 1000000) }", "SELECT c_name AS name, total FROM customer JOIN (SELECT o_custkey AS c, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c=c_custkey WHERE total > 1000000"),
    "bind_coalesce": ("SELECT ?p ?label WHERE { ?x a :part ; :p_partkey ?p ; :p_name ?n ; :p_size ?z BIND(IF(?z > 25, UCASE(?n), CONCAT('small ', ?n)) AS ?label) }", "SELECT p_partkey AS p, CASE WHEN p_size > 25 THEN upper(p_name) ELSE 'small ' || p_name END AS label FROM part"),
    "string_functions": ("SELECT ?c (STRLEN(?n) AS ?len) (SUBSTR(?n, 3, 4) AS ?sub) (STRBEFORE(?n, '#') AS ?pre) (STRAFTER(?n, '#') AS ?post) (CONTAINS(?n, '1') AS ?has) (REPLACE(?n, '0+', '-') AS ?rep) (LCASE(?n) AS ?low) WHERE { ?c a :customer ; :c_name ?n }", "SELECT c_custkey AS c, length(c_name) AS len, substr(c_name,3,4) AS sub, CASE WHEN contains(c_name,'#') THEN split_part(c_name,'#',1) ELSE '' END AS pre, CASE WHEN contains(c_name,'#') THEN substr(c_name, strpos(c_name,'#')+1) ELSE '' END AS post, contains(c_name,'1') AS has, regexp_replace(c_name,'0+','-','g') AS rep, lower(c_name) AS low FROM customer"),
    "date_functions": ("SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) WHERE { ?o a :orders ; :o_orderdate ?d }", "SELECT o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, hour(o_orderdate) AS h FROM orders"),
    "math_functions": ("SELECT ?p (CEIL(?r) AS ?up) (FLOOR(?r) AS ?down) (ROUND(?r) AS ?near) (ABS(?r - 1000) AS ?gap) WHERE { ?x a :part ; :p_partkey ?p ; :p_retailprice ?r }", "SELECT p_partkey AS p, ceil(p_retailprice) AS up, floor(p_retailprice) AS down, floor(p_retailprice + 0.5) AS near, abs(p_retailprice - 1000) AS gap FROM part"),
    "hash_functions": ("SELECT ?c (MD5(?n) AS ?md5) (SHA256(?n) AS ?sha) WHERE { ?c a :customer ; :c_name ?n }", "SELECT c_custkey AS c, md5(c_name) AS md5, sha256(c_name) AS sha FROM customer"),
    "regex_filter": ("SELECT ?p ?n WHERE { ?p a :part ; :p_type ?n FILTER(REGEX(?n, '^[a-s].*', 'i') && ?n NOT IN ('x')) }", "SELECT p_partkey AS p, p_type AS n FROM part WHERE regexp_matches(p_type, '^[a-s].*', 'i')"),
    "unfold_list": ("SELECT ?n ?part ?at WHERE { ?x a :region ; :r_regionkey ?n UNFOLD(LIST(?n, ?n + 10) AS ?part, ?at) }", "SELECT r_regionkey AS n, r_regionkey AS part, CAST(1 AS BIGINT) AS at FROM region UNION ALL SELECT r_regionkey, r_regionkey + 10, 2 FROM region"),
    "path_plus": ("SELECT ?a ?b WHERE { ?a :next+ ?b }", "WITH RECURSIVE e AS (SELECT n_nationkey AS s, n_regionkey AS o FROM nation), c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s) SELECT s AS a, o AS b FROM c"),
    "path_alternative_distinct": ("SELECT ?a ?b WHERE { ?a DISTINCT(:c_nationkey|:s_nationkey) ?b }", "SELECT c_custkey AS a, c_nationkey AS b FROM customer UNION SELECT s_suppkey, s_nationkey FROM supplier"),
    "library_functions": ("SELECT ?c (fn:normalize-space(?n) AS ?norm) (afn:substr(?n, 2, 6) AS ?cut) (op:numeric-mod(?k, 7) AS ?rest) (IDIV(?k, 7) AS ?whole) (lfn:pythagoras(?k, 4) AS ?hyp) (fn:round-half-to-even(?b) AS ?even) (fn:boolean(?k) AS ?truth) WHERE { ?c a :customer ; :c_name ?n ; :c_nationkey ?k ; :c_acctbal ?b }", "SELECT c_custkey AS c, trim(regexp_replace(c_name, '\\s+', ' ', 'g')) AS norm, substr(c_name, 3, 4) AS cut, c_nationkey % 7 AS rest, CAST(c_nationkey // 7 AS BIGINT) AS whole, sqrt(c_nationkey * c_nationkey + 16.0) AS hyp, round_even(c_acctbal, 0) AS even, c_nationkey <> 0 AS truth FROM customer"),
    "path_sequence": ("SELECT ?c ?r WHERE { ?c :c_nationkey/:n_regionkey ?r }", "SELECT c_custkey AS c, n_regionkey AS r FROM customer JOIN nation ON c_nationkey=n_nationkey"),
    "gauss_threshold": ("SELECT ?u ?p WHERE { { SELECT ?u (AVG(?v) AS ?m) (STDEV(?v) AS ?s) WHERE { ?e a :events ; :user_id ?u ; :value ?v } GROUP BY ?u HAVING (COUNT(*) > 1) } BIND(prob:cdf(GAUSSIAN(?m, ?s), 120.0) AS ?p0) BIND(ROUND(?p0 * 10000) / 10000 AS ?p) FILTER(?p >= 0.9) }", f"SELECT u, floor({_phi('(120.0-m)/s')} * 10000 + 0.5) / 10000 AS p FROM (SELECT user_id AS u, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1 HAVING count(*) > 1) WHERE floor({_phi('(120.0-m)/s')} * 10000 + 0.5) / 10000 >= 0.9"),
}


class _Chained:
    """nation -> region edges under the name `next`."""

    def __init__(self, tables: MappedTables):
        self.tables = tables

    def edges(self, predicate: str) -> DataFrame:
        return self.tables.edges("n_regionkey")


def _text(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = MappedTables.of(spark, sf_dir)
        return evaluate(_Chained(tables) if name == "path_plus" else tables, TEXT[name][0])

    return run


def _gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return events.select("event_type", "m", "s", D.gaussian(F.col("m"), F.col("s")).alias("g"))


def gauss_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation after scale, shift, convolve, multiply, fuse, mix with a fixed N(10, 4)."""
    h, g = D.gaussian(F.lit(10.0), F.lit(2.0)), F.col("g")
    made = {"scale": D.scale(g, F.lit(2.0)), "shift": D.shift(g, F.lit(5.0)), "convolve": D.convolve(g, h), "multiply": D.multiply(g, h), "fuse": D.fuse(g, h), "mix": D.mix(g, h, F.lit(0.25))}
    return _gauss(spark, sf_dir).select("event_type", *[F.round(f(v)[0], 4).alias(f"{n}_{k}") for n, v in made.items() for k, f in (("mean", D.mean), ("std", D.std))])


def gauss_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, g = D.gaussian(F.lit(60.0), F.lit(40.0)), F.col("g")
    return _gauss(spark, sf_dir).select("event_type", F.round(D.kl_gaussian(g, h), 6).alias("kl"), F.round(D.hellinger_gaussian(g, h), 6).alias("hellinger"), F.round(D.bhattacharyya_gaussian(g, h), 6).alias("bhattacharyya"), F.round(D.wasserstein_gaussian(g, h), 6).alias("wasserstein"))


EDGES = [0.0, 20000.0, 40000.0, 60000.0, 80000.0, 120000.0]


def _hists(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    cells = [F.count_if((price >= a) & (price < b)).cast("double") for a, b in zip(EDGES, EDGES[1:], strict=False)]
    made = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus").agg(F.array(*cells).alias("w"))
    return made.select("l_returnflag", "l_linestatus", F.struct(F.array(F.array(*map(F.lit, EDGES))).alias("edges"), F.col("w").alias("weights")).alias("h"))


def hist_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hists(spark, sf_dir).select("l_returnflag", "l_linestatus", F.round(D.hist_mean(F.col("h")), 4).alias("mean"), F.round(D.hist_cdf(F.col("h"), F.lit(50000.0)), 6).alias("cdf"))


def hist_divjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.divergence import hist_divjoin as joined

    h = _hists(spark, sf_dir)
    left = h.select(F.concat("l_returnflag", "l_linestatus").alias("a"), F.col("h").alias("x"))
    right = h.select(F.concat("l_returnflag", "l_linestatus").alias("b"), F.col("h").alias("y"))
    return joined(left, right, "x", "y", 0.0005).where("a < b").select("a", "b", F.round("jsd", 7).alias("jsd"))


def _rounded(x: Column, places: int) -> Column:
    """F.round of a finite number that isn't negative. F.round goes by decimal digits, some microseconds a row; here it is asked near halves only, where the digits decide."""
    large = x * 10.0**places
    near_half = F.abs(large - F.floor(large) - 0.5) < 1e-6
    return F.when(near_half | (large > 1e9), F.round(x, places)).otherwise(F.floor(large + 0.5) / F.lit(10.0**places))


def gauss_divjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of users whose value distributions are alike; interval cells and the pruning cascade decide first."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("*").alias("n")).where("n > 1 and s > 0")
    side = users.select("user_id", D.gaussian(F.col("m"), F.col("s")).alias("g"))
    pairs, _ = divjoin(side.toDF("u", "gu"), side.toDF("v", "gv"), "gu", "gv", 0.002, on=F.col("u") < F.col("v"), observed=False)
    return pairs.select("u", "v", _rounded(F.col("jsd"), 4).alias("jsd"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.streaming.windows import windowed_counts

    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples s, p, o: customers in nations, nations in regions."""
    read = lambda t, a, s, b, o: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.concat(F.lit(a), F.col(s)).alias("s"), F.concat(F.lit(b), F.col(o)).alias("o"))
    return read("customer", "c", "c_custkey", "n", "c_nationkey").withColumn("p", F.lit("in")).unionByName(read("nation", "n", "n_nationkey", "r", "n_regionkey").withColumn("p", F.lit("of"))).select("s", "p", "o")


def rdfs_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as instances of their nation, nations as sub-classes of their region: all types of each customer."""
    from quillon.operators.inference import SUB_CLASS, TYPE, rdfs

    triples = _places(spark, sf_dir).withColumn("p", F.when(F.col("p") == "in", TYPE).otherwise(SUB_CLASS))
    return rdfs(triples).where(F.col("p") == TYPE).select("s", "o")


def forward_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.inference import forward

    return forward(_places(spark, sf_dir), ["[(?c in ?n) (?n of ?r) -> (?c within ?r)]"]).where("p = 'within'").select("s", "o")


def shape_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose balance is negative."""
    from quillon.operators.shapes import Shape, validate

    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("s"), F.lit("balance").alias("p"), F.col("c_acctbal").cast("string").alias("o"))
    return validate(rows, [Shape("balance", {"minInclusive": 0, "maxCount": 1}, subjects_of="balance")]).select("focus", "constraint")


def update_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of nation 3 move to a graph of their own."""
    from quillon.plans.update import update
    from quillon.sources.graphs import Quads

    source = Quads(_places(spark, sf_dir).where("p = 'in'").withColumn("g", F.lit(None).cast("string")))
    return update(source, "DELETE { ?c <in> 'n3' } INSERT { GRAPH <moved> { ?c <in> 'n3' } } WHERE { ?c <in> 'n3' }").df.select("g", "s", "p", "o")


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a word that begins with `licen`, without the word `mit`."""
    from quillon.operators.text import text_query

    return text_query(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "licen* -mit").select("doc_id")


def spatial_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, placed by their numbers, within 3000 km of 10 N 20 E."""
    from quillon.functions.spatial import nearby

    places = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 170 - 85.0).alias("lat"), (F.col("c_custkey") * 7 % 360 - 180.0).alias("lon"))
    return nearby(places, (10.0, 20.0), 3000.0, "kilometre").select("c_custkey", F.round("distance", 3).alias("km"))


_STATS = "WITH g AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)"
_CELLS = ", ".join(f"sum(CASE WHEN l_extendedprice >= {a} AND l_extendedprice < {b} THEN 1.0 ELSE 0.0 END)::DOUBLE AS w{i}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False)))
_HIST = f"WITH h AS (SELECT l_returnflag, l_linestatus, {_CELLS} FROM lineitem GROUP BY 1, 2), t AS (SELECT *, w0+w1+w2+w3+w4 AS n FROM h)"


def _term(i: int) -> str:
    p, q = f"(x.w{i}/x.n)", f"(y.w{i}/y.n)"
    m = f"(({p}+{q})/2)"
    return f"(CASE WHEN {p}>0 THEN {p}*ln({p}/{m}) ELSE 0 END + CASE WHEN {q}>0 THEN {q}*ln({q}/{m}) ELSE 0 END)/2"


_JSD = "(" + "+".join(_term(i) for i in range(5)) + ")"
FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "gauss_transforms": (gauss_transforms, _STATS + ", x AS (SELECT *, 1/(1/(s*s)+1/4.0) AS v FROM g) SELECT event_type, round(2*m,4) AS scale_mean, round(2*s,4) AS scale_std, round(m+5,4) AS shift_mean, round(s,4) AS shift_std, round(m+10,4) AS convolve_mean, round(sqrt(s*s+4),4) AS convolve_std, round(m*10,4) AS multiply_mean, round(sqrt(m*m*4+100*s*s+4*s*s),4) AS multiply_std, round((m*4+10*s*s)/(s*s+4),4) AS fuse_mean, round(sqrt(s*s*4/(s*s+4)),4) AS fuse_std, round(0.25*m+7.5,4) AS mix_mean, round(sqrt(0.25*(s*s+m*m)+0.75*104-(0.25*m+7.5)*(0.25*m+7.5)),4) AS mix_std FROM x"),
    "gauss_divergences": (gauss_divergences, _STATS + " SELECT event_type, round((ln(1600.0/(s*s))+(s*s+(m-60)*(m-60))/1600.0-1)/2,6) AS kl, round(sqrt(1-sqrt(2*s*40/(s*s+1600))*exp(-(m-60)*(m-60)/(4*(s*s+1600)))),6) AS hellinger, round((m-60)*(m-60)/(4*(s*s+1600))+ln((s*s+1600)/(2*s*40))/2,6) AS bhattacharyya, round(sqrt((m-60)*(m-60)+(s-40)*(s-40)),6) AS wasserstein FROM g"),
    "hist_summary": (hist_summary, _HIST + " SELECT l_returnflag, l_linestatus, round((w0*10000+w1*30000+w2*50000+w3*70000+w4*100000)/n,4) AS mean, round((w0+w1+w2*0.5)/n,6) AS cdf FROM t"),
    "hist_divjoin": (hist_divjoin, _HIST + f" SELECT x.l_returnflag||x.l_linestatus AS a, y.l_returnflag||y.l_linestatus AS b, round({_JSD},7) AS jsd FROM t x JOIN t y ON x.l_returnflag||x.l_linestatus < y.l_returnflag||y.l_linestatus WHERE {_JSD} <= 0.0005"),
    "gauss_divjoin": (gauss_divjoin, None),
    "rdfs_types": (rdfs_types, "SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS o FROM customer UNION SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "forward_rules": (forward_rules, "SELECT 'c' || c_custkey AS s, 'r' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "shape_violations": (shape_violations, "SELECT 'c' || c_custkey AS focus, 'minInclusive' AS \"constraint\" FROM customer WHERE c_acctbal < 0"),
    "update_request": (update_request, "SELECT CASE WHEN c_nationkey = 3 THEN 'moved' END AS g, 'c' || c_custkey AS s, 'in' AS p, 'n' || c_nationkey AS o FROM customer"),
    "text_search": (text_search, r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])licen') AND NOT regexp_matches(lower(text), '(^|[^\p{L}\p{N}])mit($|[^\p{L}\p{N}])')"),
    "spatial_nearby": (spatial_nearby, "SELECT c_custkey, round(km, 3) AS km FROM (SELECT c_custkey, 2*6371.0088*asin(least(1.0, sqrt(power(sin(radians(10-lat)/2),2) + cos(radians(lat))*cos(radians(10.0))*power(sin(radians(20-lon)/2),2)))) AS km FROM (SELECT c_custkey, c_custkey % 170 - 85.0 AS lat, c_custkey * 7 % 360 - 180.0 AS lon FROM customer)) WHERE km <= 3000"),
    "event_windows": (event_windows, "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _text(name) for name in TEXT} | {name: f for name, (f, _) in FUNCTIONS.items()} | catalog_terms.queries() | catalog_families.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in TEXT.items() if sql} | {name: sql for name, (_, sql) in FUNCTIONS.items() if sql} | catalog_terms.oracle_sql() | catalog_families.oracle_sql()
