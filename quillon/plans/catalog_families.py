"""Registered queries that exercise one family of functions each: wide rows, and the SQL of the same columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import distributions as D
from quillon.sources.graphs import XSD, MappedTables

from .translate import evaluate

#: column -> (expression of the query language, SQL)
Columns = dict[str, tuple[str, str]]


def _near(columns: Columns) -> Columns:
    """Rounds numbers that two libraries may give with different last bits."""
    return {k: (f"ROUND(({q}) * 10000) / 10000", f"floor(({s}) * 10000 + 0.5) / 10000") for k, (q, s) in columns.items()}


def _wide(key: tuple[str, str], pattern: str, table: str, columns: Columns) -> tuple[str, str]:
    """A query with one row per key and its SQL."""
    name, column = key
    shown = " ".join(f"({q} AS ?{k})" for k, (q, _) in columns.items())
    return f"SELECT ?{name} {shown} WHERE {{ {pattern} }}", f"SELECT {column} AS {name}, " + ", ".join(f"{s} AS {k}" for k, (_, s) in columns.items()) + f" FROM {table}"


_CUSTOMER = "?c a :customer ; :c_name ?n ; :c_acctbal ?b ; :c_custkey ?k"
_K, _B, _NAME = "c_custkey", "c_acctbal", "c_name"
_OPERATORS: Columns = {
    "plus": ("?k + 1", f"{_K} + 1"), "minus": ("?k - 1", f"{_K} - 1"), "times": ("?k * 2", f"{_K} * 2"), "over": ("?b / 4", f"{_B} / 4"), "neg": ("-?k", f"-{_K}"), "pos": ("+?k", _K),
    "lt": ("?k < 5", f"{_K} < 5"), "le": ("?k <= 5", f"{_K} <= 5"), "gt": ("?k > 5", f"{_K} > 5"), "ge": ("?k >= 5", f"{_K} >= 5"), "eq": ("?k = 5", f"{_K} = 5"), "ne": ("?k != 5", f"{_K} <> 5"),
    "no": ("!(?k = 5)", f"{_K} <> 5"), "either": ("?k < 5 || ?k > 100", f"{_K} < 5 OR {_K} > 100"), "both": ("?k > 5 && ?k < 100", f"{_K} > 5 AND {_K} < 100"), "isin": ("?k IN (1, 2, 30)", f"{_K} IN (1, 2, 30)"), "notin": ("?k NOT IN (1, 2, 30)", f"{_K} NOT IN (1, 2, 30)"),
    "zero": ("?b / 0", "CAST(NULL AS DOUBLE)"), "rest": ("MOD(?k, 7)", f"{_K} % 7"), "whole": ("IDIV(?k, 7)", f"CAST({_K} // 7 AS BIGINT)"), "oprest": ("op:numeric-mod(?k, 5)", f"{_K} % 5"), "opwhole": ("op:numeric-integer-divide(?k, 5)", f"CAST({_K} // 5 AS BIGINT)"),
    "isnum": ("isNUMERIC(?k)", "true"), "notnum": ("isNUMERIC(?n)", "false"), "first": ("COALESCE(?none, ?k)", _K), "bnd": ("BOUND(?k)", "true"), "unb": ("BOUND(?none)", "false"), "pick": ("IF(?k > 50, 'big', 'small')", f"CASE WHEN {_K} > 50 THEN 'big' ELSE 'small' END"), "ebv": ("IF(?k - 7, 'some', 'none')", f"CASE WHEN {_K} <> 7 THEN 'some' ELSE 'none' END"),
    "notfn": ("fn:not(?k - 7)", f"{_K} = 7"), "bool": ("fn:boolean(?n)", "true"), "most": ("afn:max(?k, 50)", f"greatest({_K}, 50)"), "least": ("afn:min(?k, 50)", f"least({_K}, 50)"), "even": ("afn:evenInteger(?k)", f"{_K} % 2 = 0"), "sum": ("?n + 1", "CAST(NULL AS DOUBLE)"), "cmp": ("?n > 1", "CAST(NULL AS BOOLEAN)"),
    "big": ("?k * ?k * ?k * ?k * ?k * ?k", f"CASE WHEN {_K}::HUGEINT*{_K}*{_K}*{_K}*{_K}*{_K} <= 9223372036854775807 THEN CAST({_K}::HUGEINT*{_K}*{_K}*{_K}*{_K}*{_K} AS BIGINT) END"),
    "toint": ("xsd:integer('12')", "CAST(12 AS BIGINT)"), "todouble": ("xsd:double('1.5')", "CAST(1.5 AS DOUBLE)"), "tostring": ("xsd:string(?k)", f"CAST({_K} AS VARCHAR)"), "badint": ("xsd:integer('x')", "CAST(NULL AS BIGINT)"), "viacall": ("CALL(<http://f#strlen>, ?n)", f"length({_NAME})"),
}
_STRINGS: Columns = {
    "starts": ("STRSTARTS(?n, 'Cust')", f"starts_with({_NAME}, 'Cust')"), "ends": ("STRENDS(?n, '1')", f"ends_with({_NAME}, '1')"), "uri": ("ENCODE_FOR_URI(?n)", f"url_encode({_NAME})"), "has": ("fn:contains(?n, '#0')", f"contains({_NAME}, '#0')"), "fstarts": ("fn:starts-with(?n, 'X')", "false"), "fends": ("fn:ends-with(?n, '2')", f"ends_with({_NAME}, '2')"),
    "sub": ("fn:substring(?n, 2, 3)", f"substr({_NAME}, 2, 3)"), "before": ("fn:substring-before(?n, '#')", f"split_part({_NAME}, '#', 1)"), "after": ("fn:substring-after(?n, '#')", f"split_part({_NAME}, '#', 2)"), "none": ("fn:substring-after(?n, '?')", "''"), "len": ("fn:string-length(?n)", f"length({_NAME})"), "up": ("fn:upper-case(?n)", f"upper({_NAME})"), "low": ("fn:lower-case(?n)", f"lower({_NAME})"),
    "rep": ("fn:replace(?n, '0+', '-')", f"regexp_replace({_NAME}, '0+', '-', 'g')"), "flags": ("REPLACE(?n, 'CUST', 'x', 'i')", f"regexp_replace({_NAME}, 'CUST', 'x', 'gi')"), "match": ("fn:matches(?n, '[13]$')", f"regexp_matches({_NAME}, '[13]$')"), "regex": ("REGEX(?n, '^CUSTOMER#0+1', 'i')", f"regexp_matches({_NAME}, '^CUSTOMER#0+1', 'i')"), "enc": ("fn:encode-for-uri(?n)", f"url_encode({_NAME})"), "cat": ("fn:concat(?n, '!')", f"{_NAME} || '!'"),
    "alen": ("afn:strlen(?n)", f"length({_NAME})"), "joined": ("afn:strjoin('-', ?n, 'x')", f"{_NAME} || '-x'"), "printed": ("afn:sprintf('%s!', ?n)", f"{_NAME} || '!'"), "cut": ("afn:substring(?n, 9)", f"substr({_NAME}, 10)"), "cut2": ("afn:substr(?n, 0, 4)", f"substr({_NAME}, 1, 4)"), "local": ("afn:localname('http://a/b#c')", "'c'"), "space": ("afn:namespace('http://a/b#c')", "'http://a/b#'"), "norm": ("fn:normalize-space(CONCAT('  a ', ?n, ' '))", f"'a ' || {_NAME}"),
    "nfc": ("fn:normalize-unicode('e\u0301')", "'\u00e9'"), "nfd": ("STRLEN(fn:normalize-unicode('\u00e9', 'NFD'))", "CAST(2 AS BIGINT)"), "ucase": ("UCASE(?n)", f"upper({_NAME})"), "listed": ("fn:string-join(LIST(?n, 'z'), '+')", f"{_NAME} || '+z'"), "shown": ("afn:print(?n)", _NAME), "money": ("fn:format-number(?b, 2)", f"format('{{:,.2f}}', {_B})"),
}
_DATES: Columns = {
    "y": ("fn:year-from-dateTime(?t)", "year(ts)"), "m": ("fn:month-from-dateTime(?t)", "month(ts)"), "d": ("fn:day-from-dateTime(?t)", "day(ts)"), "h": ("fn:hours-from-dateTime(?t)", "hour(ts)"), "mi": ("fn:minutes-from-dateTime(?t)", "minute(ts)"), "s": ("SECONDS(?t)", "extract(microsecond FROM ts) / 1000000.0"), "s2": ("fn:seconds-from-dateTime(?t)", "extract(microsecond FROM ts) / 1000000.0"), "mi2": ("MINUTES(?t)", "minute(ts)"), "h2": ("HOURS(?t)", "hour(ts)"),
    "yd": ("fn:year-from-date(?t)", "year(ts)"), "md": ("fn:month-from-date(?t)", "month(ts)"), "dd": ("fn:day-from-date(?t)", "day(ts)"), "day": ("STR(afn:date(?t))", "CAST(CAST(ts AS DATE) AS VARCHAR)"), "ht": ("fn:hours-from-time('10:20:30')", "CAST(10 AS BIGINT)"), "mt": ("fn:minutes-from-time('10:20:30')", "CAST(20 AS BIGINT)"), "st": ("fn:seconds-from-time('10:20:30.5')", "CAST(30.5 AS DOUBLE)"),
    "text": ("YEAR('2021-03-04T05:06:07Z')", "CAST(2021 AS BIGINT)"), "bad": ("YEAR('never')", "CAST(NULL AS BIGINT)"), "later": ("?t > '2000-01-01T00:00:00'", "true"), "dt": ("STR(fn:dateTime('2020-01-02', '03:04:05'))", "'2020-01-02 03:04:05'"),
    "tz": ("TZ('2021-03-04T05:06:07+02:00')", "'+02:00'"), "tzz": ("TZ('2021-03-04T05:06:07Z')", "'Z'"), "tzn": ("TZ('2021-03-04T05:06:07')", "''"), "zone": ("TIMEZONE('2021-03-04T05:06:07-05:30')", "'-PT5H30M'"), "zonez": ("TIMEZONE('2021-03-04T05:06:07Z')", "'PT0S'"), "nozone": ("TIMEZONE('2021-03-04T05:06:07')", "CAST(NULL AS VARCHAR)"), "fzone": ("fn:timezone-from-dateTime('2021-03-04T05:06:07+01:00')", "'PT1H'"),
    "adj": ("ADJUST('2021-03-04T05:06:07Z', 'PT2H')", "'2021-03-04T07:06:07+02:00'"), "adjn": ("fn:adjust-dateTime-to-timezone('2021-03-04T23:06:07-01:00', 'PT1H30M')", "'2021-03-05T01:36:07+01:30'"), "yrs": ("fn:years-from-duration('P3Y2M')", "CAST(3 AS BIGINT)"), "mos": ("fn:months-from-duration('-P3Y2M')", "CAST(-2 AS BIGINT)"), "days": ("fn:days-from-duration('P5DT6H7M8.5S')", "CAST(5 AS BIGINT)"), "hrs": ("fn:hours-from-duration('P5DT6H7M8.5S')", "CAST(6 AS BIGINT)"), "mins": ("fn:minutes-from-duration('P5DT6H7M8.5S')", "CAST(7 AS BIGINT)"), "secs": ("fn:seconds-from-duration('P5DT6H7M8.5S')", "CAST(8.5 AS DOUBLE)"),
}
_X, _S = "p_retailprice / 1000", "(p_size % 10)"
_MATH: Columns = _near({
    "abs": ("fn:abs(0 - ?x)", _X), "ceil": ("fn:ceiling(?r)", "ceil(p_retailprice)"), "floor": ("fn:floor(?r)", "floor(p_retailprice)"), "round": ("fn:round(?r)", "floor(p_retailprice + 0.5)"), "half": ("fn:round-half-to-even(?z / 2)", "round_even(p_size / 2, 0)"), "exp": ("math:exp(?x)", f"exp({_X})"), "exp10": ("math:exp10(?x)", f"power(10, {_X})"), "log": ("math:log(?x)", f"ln({_X})"), "log10": ("math:log10(?x)", f"log10({_X})"), "pow": ("math:pow(?x, 2)", f"power({_X}, 2)"), "atan2": ("math:atan2(?x, 2)", f"atan2({_X}, 2)"), "sqrt": ("afn:sqrt(?x)", f"sqrt({_X})"), "pi": ("afn:pi()", "pi()"), "e": ("afn:e()", "exp(1)"),
    "sin": ("lfn:sin(?x)", f"sin({_X})"), "cos": ("lfn:cos(?x)", f"cos({_X})"), "tan": ("lfn:tan(?x)", f"tan({_X})"), "sin1": ("lfn:sin1(?x / 10)", f"asin({_X} / 10)"), "cos1": ("lfn:cos1(?x / 10)", f"acos({_X} / 10)"), "tan1": ("lfn:tan1(?x)", f"atan({_X})"), "sec": ("lfn:sec(?x)", f"1 / cos({_X})"), "cosec": ("lfn:cosec(?x)", f"1 / sin({_X})"), "cot": ("lfn:cot(?x)", f"1 / tan({_X})"), "sec1": ("lfn:sec1(?x + 2)", f"acos(1 / ({_X} + 2))"), "cosec1": ("lfn:cosec1(?x + 2)", f"asin(1 / ({_X} + 2))"), "cot1": ("lfn:cot1(?x)", f"atan(1 / ({_X}))"),
    "cube": ("lfn:cube(?x)", f"power({_X}, 3)"), "sq": ("lfn:sq(?x)", f"power({_X}, 2)"), "ten": ("lfn:ten(?x)", f"power(10, {_X})"), "lfe": ("lfn:e(?x)", f"exp({_X})"), "ln": ("lfn:ln(?x)", f"ln({_X})"), "lflog": ("lfn:log(?x)", f"log10({_X})"), "logb": ("lfn:log(?x, 2)", f"ln({_X}) / ln(2)"), "root": ("lfn:root(?x, 3)", f"power({_X}, 1.0 / 3)"), "recip": ("lfn:reciprocal(?x)", f"1 / ({_X})"), "rad": ("lfn:degreesToRadians(?x)", f"radians({_X})"), "deg": ("lfn:radiansToDegrees(?x)", f"degrees({_X})"), "lfpow": ("lfn:pow(?x, 3)", f"power({_X}, 3)"), "lfsqrt": ("lfn:sqrt(?x)", f"sqrt({_X})"), "cart": ("lfn:cartesian(?x, 1, 4, 5)", f"sqrt(power({_X} - 4, 2) + 16)"), "cart3": ("lfn:cartesian(?x, 1, 1, 4, 5, 6)", f"sqrt(power({_X} - 4, 2) + 41)"), "hyp": ("lfn:pythagoras(?x, 2)", f"sqrt(power({_X}, 2) + 4)"),
}) | {"fact": ("lfn:factorial(?z - IDIV(?z, 10) * 10)", f"CAST(factorial(CAST({_S} AS INTEGER)) AS BIGINT)")}
_ABC = b"abc"
_HASHES: Columns = {f"hash_{k}": (f"{f}('abc')", f"'{hashlib.new(h, _ABC).hexdigest()}'") for k, f, h in (("a", "SHA1", "sha1"), ("b", "SHA224", "sha224"), ("c", "SHA256", "sha256"), ("d", "SHA384", "sha384"), ("e", "SHA512", "sha512"), ("f", "MD5", "md5"), ("g", "afn:sha1sum", "sha1"), ("h", "lfn:md5hash", "md5"), ("i", "lfn:sha256hash", "sha256"))}
_HASHES |= {"own": ("SHA1(?n)", f"sha1({_NAME})"), "uuids": ("STRLEN(STRUUID())", "CAST(36 AS BIGINT)"), "uu": ("STRSTARTS(UUID(), 'urn:uuid:')", "true"), "auu": ("STRSTARTS(afn:uuid(), 'urn:uuid:')", "true"), "astr": ("STRLEN(afn:struuid())", "CAST(36 AS BIGINT)"), "rnd": ("RAND() >= 0 && RAND() < 1", "true"), "lfrnd": ("lfn:rnd(2, 3) >= 2", "true"), "nows": ("YEAR(NOW()) > 2000", "true"), "anow": ("YEAR(afn:now()) > 2000", "true"), "ver": ("STRLEN(VERSION()) > 0", "true"), "bn": ("isBLANK(BNODE())", "true")}
_R = "CAST(r_regionkey AS INTEGER)"
_LISTS: Columns = {
    "size": ("cdt:size(LIST(?k, 7, 8))", "CAST(3 AS BIGINT)"), "head": ("cdt:head(LIST(?k, 7))", _R), "get": ("cdt:get(LIST(7, ?k), 2)", _R), "out": ("cdt:get(LIST(7, ?k), 3)", "CAST(NULL AS INTEGER)"), "tail": ("cdt:head(cdt:tail(LIST(7, ?k)))", _R), "notail": ("cdt:size(cdt:tail(cdt:tail(LIST(7))))", "CAST(NULL AS BIGINT)"), "rev": ("cdt:head(cdt:reverse(LIST(7, ?k)))", _R), "cat": ("cdt:size(cdt:concat(LIST(1), LIST(2, ?k)))", "CAST(3 AS BIGINT)"), "has": ("cdt:contains(LIST(1, 2), ?k)", f"{_R} IN (1, 2)"), "hasterm": ("cdt:containsTerm(LIST(1, 2), ?k)", f"{_R} IN (1, 2)"), "sub": ("cdt:size(cdt:subseq(LIST(1, 2, 3, ?k), 2, 2))", "CAST(2 AS BIGINT)"),
    "mget": ("cdt:get(cdt:Map('a', ?k, 'b', 9), 'a')", _R), "msize": ("cdt:size(cdt:Map('a', ?k, 'b', 9))", "CAST(2 AS BIGINT)"), "key": ("cdt:containsKey(cdt:Map('a', ?k), 'a')", "true"), "nokey": ("cdt:containsKey(cdt:Map('a', ?k), 'z')", "false"), "keys": ("cdt:size(cdt:keys(cdt:Map('a', ?k, 'b', 9)))", "CAST(2 AS BIGINT)"), "put": ("cdt:get(cdt:put(cdt:Map('a', 5), 'a', ?k), 'a')", _R), "gone": ("cdt:containsKey(cdt:remove(cdt:Map('a', ?k), 'a'), 'a')", "false"), "left": ("cdt:get(cdt:merge(cdt:Map('a', ?k), cdt:Map('a', 99)), 'a')", _R), "both": ("cdt:size(cdt:merge(cdt:Map('a', ?k), cdt:Map('b', 99)))", "CAST(2 AS BIGINT)"),
    "same": ("LIST(1, ?k) = LIST(1, 2)", f"{_R} = 2"), "lower": ("LIST(1, ?k) < LIST(1, 2)", f"{_R} < 2"), "atleast": ("LIST(1, ?k) >= LIST(1, 2)", f"{_R} >= 2"),
}

TEXT: dict[str, tuple[str, str]] = {
    "operators_wide": _wide(("c", _K), _CUSTOMER, "customer", _OPERATORS),
    "strings_wide": _wide(("c", _K), _CUSTOMER, "customer", _STRINGS),
    "dates_wide": _wide(("e", "event_id"), "?e a :events ; :ts ?t", "events", _DATES),
    "math_wide": _wide(("p", "p_partkey"), "?p a :part ; :p_retailprice ?r ; :p_size ?z BIND(?r / 1000 AS ?x)", "part", _MATH),
    "hashes_wide": _wide(("c", _K), _CUSTOMER, "customer", _HASHES),
    "lists_wide": _wide(("x", "r_regionkey"), "?x a :region ; :r_regionkey ?k", "region", _LISTS),
    "aggregates_wide": (
        "SELECT ?f (SUM(DISTINCT ?q) AS ?ds) (AVG(DISTINCT ?q) AS ?da) (MIN(DISTINCT ?q) AS ?dmin) (MAX(DISTINCT ?q) AS ?dmax) (COUNT(DISTINCT ?q) AS ?dn) (ROUND(VAR_SAMP(?q) * 10000) AS ?vs) (ROUND(VAR_POP(?q) * 10000) AS ?vp) (ROUND(STDEV_POP(?q) * 10000) AS ?sp) (ROUND(STDEV_SAMP(?q) * 10000) AS ?ss) (ROUND(VARIANCE(?q) * 10000) AS ?v) (ROUND(agg:stdev(?q) * 10000) AS ?au) (SAMPLE(?q) AS ?any) (MEDIAN(?q) AS ?med) (MODE(?m) AS ?mode) (GROUP_CONCAT(DISTINCT ?m; SEPARATOR=',') AS ?modes) (COUNT(*) AS ?n) WHERE { ?l a :lineitem ; :l_returnflag ?f ; :l_quantity ?q ; :l_linestatus ?m } GROUP BY ?f",
        "SELECT l_returnflag AS f, sum(DISTINCT l_quantity) AS ds, avg(DISTINCT l_quantity) AS da, min(l_quantity) AS dmin, max(l_quantity) AS dmax, count(DISTINCT l_quantity) AS dn, floor(var_samp(l_quantity) * 10000 + 0.5) AS vs, floor(var_pop(l_quantity) * 10000 + 0.5) AS vp, floor(stddev_pop(l_quantity) * 10000 + 0.5) AS sp, floor(stddev_samp(l_quantity) * 10000 + 0.5) AS ss, floor(var_samp(l_quantity) * 10000 + 0.5) AS v, floor(stddev_samp(l_quantity) * 10000 + 0.5) AS au, min(l_quantity) AS any, median(l_quantity) AS med, (SELECT l_linestatus FROM lineitem y WHERE y.l_returnflag = lineitem.l_returnflag GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) AS mode, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS modes, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    ),
    "group_without_aggregate": ("SELECT ?m WHERE { ?c a :customer ; :c_mktsegment ?m } GROUP BY ?m", "SELECT DISTINCT c_mktsegment AS m FROM customer"),
    "count_distinct_rows": ("SELECT (COUNT(DISTINCT *) AS ?n) (COUNT(?b) AS ?k) WHERE { ?c a :customer ; :c_mktsegment ?m ; :c_acctbal ?b }", "SELECT count(*) AS n, count(*) AS k FROM customer"),
    "variance_of_one": ("SELECT ?k (VAR_SAMP(?b) AS ?vs) (VAR_POP(?b) AS ?vp) WHERE { ?c a :customer ; :c_custkey ?k ; :c_acctbal ?b } GROUP BY ?k", "SELECT c_custkey AS k, CAST(NULL AS DOUBLE) AS vs, CAST(0 AS DOUBLE) AS vp FROM customer"),
    "fold_values": ("SELECT ?r (FOLD(?k ORDER BY DESC(?k)) AS ?list) (cdt:size(FOLD(?n, ?k)) AS ?keys) WHERE { ?x a :nation ; :n_regionkey ?r ; :n_nationkey ?k ; :n_name ?n } GROUP BY ?r", "SELECT n_regionkey AS r, list(n_nationkey ORDER BY n_nationkey DESC) AS list, count(DISTINCT n_name) AS keys FROM nation GROUP BY 1"),
    "reduced_rows": ("SELECT REDUCED ?m WHERE { ?c a :customer ; :c_mktsegment ?m }", "SELECT DISTINCT c_mktsegment AS m FROM customer"),
    "unfold_map": ("SELECT ?k ?key ?v WHERE { ?x a :region ; :r_regionkey ?k UNFOLD(cdt:Map('a', ?k, 'b', 9) AS ?key, ?v) }", "SELECT r_regionkey AS k, 'a' AS key, CAST(r_regionkey AS INTEGER) AS v FROM region UNION ALL SELECT r_regionkey, 'b', 9 FROM region"),
    "cross_filter": ("SELECT ?a ?b WHERE { ?a a :region ; :r_name ?x . ?b a :region ; :r_name ?y FILTER(?x < ?y) }", "SELECT x.r_regionkey AS a, y.r_regionkey AS b FROM region x JOIN region y ON x.r_name < y.r_name"),
    "order_mixed": ("SELECT ?c ?o WHERE { ?c a :nation ; :n_regionkey ?r OPTIONAL { ?o a :region ; :r_regionkey ?r FILTER(?o > 2) } } ORDER BY ?o DESC(?c) LIMIT 12", "SELECT n_nationkey AS c, CASE WHEN n_regionkey > 2 THEN n_regionkey END AS o FROM nation ORDER BY o NULLS FIRST, c DESC LIMIT 12"),
    "divjoin_right_filter": (
        "SELECT ?u ?v WHERE { { SELECT ?u (GAUSSIAN(AVG(?x), STDEV(?x)) AS ?g) WHERE { ?e a :events ; :event_type ?u ; :value ?x } GROUP BY ?u } DIVJOIN(?g, ?h, 0.7, 0.05) { { SELECT ?v (GAUSSIAN(AVG(?y), STDEV(?y)) AS ?h) WHERE { ?e2 a :events ; :event_type ?v ; :value ?y } GROUP BY ?v } FILTER(?u < ?v) } }",
        "SELECT DISTINCT x.event_type AS u, y.event_type AS v FROM events x JOIN (SELECT DISTINCT event_type FROM events) y ON x.event_type < y.event_type",
    ),
    "prob_functions_text": (
        "SELECT ?t (prob:modeCount(?g) AS ?k) (ROUND(prob:quantile(?g, 0.5) * 1000) AS ?median) (ROUND(prob:confidence(?g, ?m - ?s, ?m + ?s) * 100000) AS ?one) (prob:sameDistribution(?g, ?g) AS ?same) (prob:sameDistribution(?g, prob:shift(?g, 1.0)) AS ?other) (ROUND(prob:mean(prob:linearTransform(?g, 2.0, 3.0))  * 1000) AS ?lin) (ROUND(prob:std(prob:marginal(prob:joint(?g, prob:scale(?g, 2.0)), 1)) * 1000) AS ?marg) (prob:sameTerm(?t, ?t) AS ?st) WHERE { { SELECT ?t (AVG(?v) AS ?m) (STDEV(?v) AS ?s) WHERE { ?e a :events ; :event_type ?t ; :value ?v } GROUP BY ?t } BIND(GAUSSIAN(?m, ?s) AS ?g) }",
        "SELECT t, CAST(1 AS INTEGER) AS k, floor(m * 1000 + 0.5) AS median, CAST(68269 AS DOUBLE) AS one, true AS same, false AS other, floor((2 * m + 3) * 1000 + 0.5) AS lin, floor(2 * s * 1000 + 0.5) AS marg, true AS st FROM (SELECT event_type AS t, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)",
    ),
}


def _text(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: evaluate(MappedTables.of(spark, sf_dir), TEXT[name][0])


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return events.withColumn("g", D.gaussian(F.col("m"), F.col("s")))


def prob_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities of a mixture of each type's normal distribution and N(60, 40), at three points."""
    g = D.mix(F.col("g"), D.gaussian(F.lit(60.0), F.lit(40.0)), F.lit(0.25))
    rated = {f"{n}{i}": F.round(f(g, F.lit(x)), 6) for i, x in enumerate((-20.0, 50.0, 130.0)) for n, f in (("pdf", D.pdf), ("logpdf", D.logpdf), ("cdf", D.cdf), ("logcdf", D.logcdf))}
    return _stats(spark, sf_dir).select("event_type", *[v.alias(k) for k, v in rated.items()], D.mode_count(g).alias("modes"), F.round(D.quantile(g, D.cdf(g, F.lit(55.0))), 3).alias("back"), F.round(D.confidence(g, F.lit(0.0), F.lit(100.0)), 5).alias("inside"))


def prob_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jensen-Shannon divergence of each type's normal distribution from N(60, 40)."""
    return _stats(spark, sf_dir).select("event_type", F.round(D.jsd(F.col("g"), D.gaussian(F.lit(60.0), F.lit(40.0))), 5).alias("jsd"))


def _pdf(x: str, m: str, s: str) -> str:
    return f"(exp(-({x}-({m}))*({x}-({m}))/(2*({s})*({s})))/(({s})*sqrt(2*pi())))"


def _jsd_term(p: str, q: str) -> str:
    return f"(CASE WHEN {p} > 1e-300 THEN {p}*ln(2*{p}/({p}+{q})) ELSE 0 END + CASE WHEN {q} > 1e-300 THEN {q}*ln(2*{q}/({p}+{q})) ELSE 0 END)/2"


_GRID = "range(-2400, 2401)"
_STATS = "g AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)"


def _points() -> str:
    out = []
    for i, x in enumerate((-20.0, 50.0, 130.0)):
        pdf = f"(0.25*{_pdf(str(x), 'm', 's')} + 0.75*{_pdf(str(x), '60.0', '40.0')})"
        cdf = f"(0.25*{_cdf(f'(({x}-m)/s)')} + 0.75*{_cdf(f'(({x}-60.0)/40.0)')})"
        out += [f"round({pdf}, 6) AS pdf{i}", f"round(ln({pdf}), 6) AS logpdf{i}", f"round({cdf}, 6) AS cdf{i}", f"round(ln({cdf}), 6) AS logcdf{i}"]
    return ", ".join(out)


def _cdf(z: str) -> str:
    from .catalog import _phi

    return _phi(z)


def _densities_sql() -> str:
    inside = "-".join(f"(0.25*{_cdf(f'(({x}-m)/s)')} + 0.75*{_cdf(f'(({x}-60.0)/40.0)')})" for x in (100.0, 0.0))
    return f"WITH {_STATS} SELECT event_type, {_points()}, CAST(2 AS INTEGER) AS modes, CAST(55 AS DOUBLE) AS back, round({inside}, 5) AS inside FROM g"


_P1, _Q1 = _pdf("x", "m", "s"), _pdf("x", "60.0", "40.0")
_STEP = "0.25"
DIVERGENCE_SQL = f"WITH {_STATS}, d AS (SELECT event_type, {_P1} AS p, {_Q1} AS q FROM (SELECT *, i * {_STEP} AS x FROM g, {_GRID} t(i))) SELECT event_type, round(sum({_jsd_term('p', 'q')}) * {_STEP}, 5) AS jsd FROM d GROUP BY 1"
#: Pairs by numeric integration over a grid of half a unit; means within reach of each other only, as others are far beyond the tolerance.
GAUSS_DIVJOIN_SQL = f"WITH u AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1 HAVING count(*) > 1 AND stddev_samp(value) > 0), pairs AS (SELECT a.user_id AS u, b.user_id AS v, a.m, a.s, b.m AS n, b.s AS t FROM u a JOIN u b ON a.user_id < b.user_id AND abs(a.m - b.m) < 0.2 * (a.s + b.s) AND a.s < 1.3 * b.s AND b.s < 1.3 * a.s), d AS (SELECT u, v, h, {_pdf('x', 'm', 's')} AS p, {_pdf('x', 'n', 't')} AS q FROM (SELECT *, least(s, t) / 12 AS h, (m + n) / 2 + i * least(s, t) / 12 AS x FROM pairs, range(-140, 141) r(i))) SELECT u, v, round(jsd, 4) AS jsd FROM (SELECT u, v, sum({_jsd_term('p', 'q')} * h) AS jsd FROM d GROUP BY 1, 2) WHERE jsd <= 0.002"


def rdfs_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-properties, domains and ranges: what customers and nations are entailed to be."""
    from quillon.operators.inference import DOMAIN, RANGE, SUB_CLASS, SUB_PROPERTY, TYPE, rdfs

    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("c"), "c_custkey").alias("s"), F.lit("livesIn").alias("p"), F.concat(F.lit("n"), "c_nationkey").alias("o"))
    schema = spark.createDataFrame([("livesIn", SUB_PROPERTY, "relatedTo"), ("relatedTo", SUB_PROPERTY, "knows"), ("livesIn", DOMAIN, "Person"), ("relatedTo", RANGE, "Place"), ("Person", SUB_CLASS, "Agent")], "s string, p string, o string")
    found = rdfs(customer.unionByName(schema))
    return found.where(F.col("p").isin("knows", "relatedTo") | ((F.col("p") == TYPE) & F.col("o").isin("Person", "Agent", "Place"))).select("s", F.when(F.col("p") == TYPE, "type").otherwise(F.col("p")).alias("p"), "o")


RULES = [
    "[less: (?a num ?x) (?a lim ?y) lessThan(?x, ?y) -> (?a less ?y)]", "[more: (?a num ?x) (?a lim ?y) greaterThan(?x, ?y) -> (?a more ?y)]", "[le: (?a num ?x) (?a lim ?y) le(?x, ?y) -> (?a le ?y)]", "[ge: (?a num ?x) (?a lim ?y) ge(?x, ?y) -> (?a ge ?y)]",
    "[eq: (?a num ?x) (?a lim ?y) equal(?x, ?y) -> (?a eq ?y)]", "[ne: (?a num ?x) (?a lim ?y) notEqual(?x, ?y) -> (?a ne ?y)]", "[blank: (?a ref ?x) isBNode(?x) -> (?a refBlank ?x)]", "[named: (?a ref ?x) notBNode(?x) -> (?a refNamed ?x)]", "[lit: (?a num ?x) isLiteral(?x) -> (?a numLit ?x)]", "[notlit: (?a ref ?x) notLiteral(?x) -> (?a refNode ?x)]", "[bound: (?a num ?x) bound(?x) -> (?a bnd ?x)]",
]


def rule_builtins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every built-in comparison and test of rules over numbered parts."""
    from quillon.operators.inference import forward

    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey <= 40").withColumn("k", F.col("p_partkey"))
    row = lambda p, o: part.select(F.concat(F.lit("http://p/"), F.col("k")).alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))
    facts = [row("num", F.col("k")), row("lim", F.lit(20)), row("ref", F.when(F.col("k") % 2 == 0, F.concat(F.lit("_:b"), F.col("k"))).otherwise(F.concat(F.lit("http://q/"), F.col("k"))))]
    return forward(reduce(DataFrame.unionByName, facts), RULES).where(~F.col("p").isin("num", "lim", "ref")).select("s", "p", "o")


_RULE = lambda p, o, cond: f"SELECT 'http://p/' || p_partkey AS s, '{p}' AS p, CAST({o} AS VARCHAR) AS o FROM part WHERE p_partkey <= 40 AND {cond}"
RULE_SQL = " UNION ALL ".join([
    _RULE("less", "20", "p_partkey < 20"), _RULE("more", "20", "p_partkey > 20"), _RULE("le", "20", "p_partkey <= 20"), _RULE("ge", "20", "p_partkey >= 20"), _RULE("eq", "20", "p_partkey = 20"), _RULE("ne", "20", "p_partkey <> 20"), _RULE("refBlank", "'_:b' || p_partkey", "p_partkey % 2 = 0"), _RULE("refNamed", "'http://q/' || p_partkey", "p_partkey % 2 = 1"), _RULE("numLit", "p_partkey", "true"),
    _RULE("refNode", "CASE WHEN p_partkey % 2 = 0 THEN '_:b' ELSE 'http://q/' END || p_partkey", "true"), _RULE("bnd", "p_partkey", "true"),
])


def _shape_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey <= 60").withColumn("k", F.col("c_custkey"))
    k = F.col("k")
    number = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^<{XSD}integer>'))
    row = lambda p, o, when="true": few.where(when).select(F.concat(F.lit("http://c/"), k).alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))
    from quillon.operators.inference import TYPE

    return reduce(DataFrame.unionByName, [
        row(TYPE, F.lit("Customer")), row("nation", F.concat(F.lit("http://n/"), k % 4)), row("num", number(k)), row("mixed", F.when(k % 3 == 0, F.lit("word")).otherwise(number(k))), row("flag", F.lit("yes"), "k % 5 = 0"), row("tag", F.lit('"one"@en')), row("tag", F.lit('"two"@en'), "k % 7 = 0"), row("tag", F.lit('"drei"@de'), "k % 2 = 0"),
        row("low", number(k)), row("high", number(F.lit(30))), row("same", number(F.when(k % 4 == 0, k + 1).otherwise(k))), row("other", F.concat(F.lit("http://n/"), F.when(k % 6 == 0, k % 4).otherwise(F.lit(9)))), row("word", F.repeat(F.lit("x"), (k % 9).cast("int"))).where("o <> ''"),
        spark.createDataFrame([("http://n/0", TYPE, "Nation"), ("http://n/1", TYPE, "Nation")], "s string, p string, o string"),
    ])


def _shapes():
    from quillon.operators.shapes import Shape

    to = {"target_class": "Customer"}
    nation, even = Shape("nation", {"class": "Nation"}, **to), Shape("tag", {"languageIn": ["de"]}, **to)
    small, large = Shape(None, {"pattern": "/[1-9]$"}), Shape(None, {"pattern": "/[1-3]\\d$"})
    one = {
        "class": nation, "datatype": Shape("mixed", {"datatype": XSD + "integer"}, **to), "nodeKind": Shape("mixed", {"nodeKind": "IRI"}, target_nodes=("http://c/1", "http://c/2")), "minCount": Shape("flag", {"minCount": 1}, **to), "maxCount": Shape("tag", {"maxCount": 2}, **to),
        "minInclusive": Shape("num", {"minInclusive": 10}, **to), "minExclusive": Shape("num", {"minExclusive": 10}, **to), "maxInclusive": Shape("num", {"maxInclusive": 50}, **to), "maxExclusive": Shape("num", {"maxExclusive": 50}, **to), "minLength": Shape("word", {"minLength": 3}, **to), "maxLength": Shape("word", {"maxLength": 6}, **to), "pattern": Shape("word", {"pattern": "^(xx)+$"}, **to),
        "languageIn": even, "uniqueLang": Shape("tag", {"uniqueLang": True}, **to), "equals": Shape("num", {"equals": "same"}, **to), "disjoint": Shape("nation", {"disjoint": "other"}, **to), "lessThan": Shape("low", {"lessThan": "high"}, **to), "lessThanOrEquals": Shape("low", {"lessThanOrEquals": "high"}, **to), "hasValue": Shape("flag", {"hasValue": "yes"}, **to), "in": Shape("nation", {"in": ["http://n/0", "http://n/2"]}, **to),
        "closed": Shape(None, {"closed": ["nation", "num", "mixed", "tag", "low", "high", "same", "other", "word"]}, subjects_of="num"), "node": Shape(None, {"node": small}, **to), "not": Shape(None, {"not": small}, **to), "and": Shape(None, {"and": [small, Shape(None, {"nodeKind": "IRI"})]}, **to), "or": Shape(None, {"or": [small, large]}, **to), "xone": Shape(None, {"xone": [small, large]}, **to), "qualified": Shape("tag", {"qualified": (Shape(None, {"languageIn": ["en"]}), 0, 1)}, **to), "objects": Shape(None, {"class": "Nation"}, objects_of="nation"),
    }
    return one


def shape_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focus nodes that violate each kind of constraint."""
    from quillon.operators.shapes import validate
    from quillon.sources.shared import stored

    triples = stored(_shape_triples(spark, sf_dir), "shapes")
    parts = [validate(triples, [shape]).select("focus").distinct().withColumn("kind", F.lit(name)) for name, shape in _shapes().items()]
    return reduce(DataFrame.unionByName, parts).select("kind", "focus")


_BREAKS = {
    "class": "k % 4 > 1", "datatype": "k % 3 = 0", "nodeKind": "k IN (1, 2)", "minCount": "k % 5 <> 0", "maxCount": "k % 14 = 0", "minInclusive": "k < 10", "minExclusive": "k <= 10", "maxInclusive": "k > 50", "maxExclusive": "k >= 50", "minLength": "k % 9 BETWEEN 1 AND 2", "maxLength": "k % 9 > 6", "pattern": "k % 9 > 0 AND k % 9 % 2 = 1", "languageIn": "true", "uniqueLang": "k % 7 = 0", "equals": "k % 4 = 0", "disjoint": "k % 6 = 0", "lessThan": "k >= 30", "lessThanOrEquals": "k > 30", "hasValue": "k % 5 <> 0", "in": "k % 2 = 1", "closed": "k % 5 = 0",
    "node": "k > 9 OR k = 0", "not": "k BETWEEN 1 AND 9", "and": "k > 9 OR k = 0", "or": "k >= 40 OR k = 0", "xone": "k >= 40 OR k = 0", "qualified": "k % 7 = 0",
}
SHAPE_SQL = "WITH t AS (SELECT c_custkey AS k FROM customer WHERE c_custkey <= 60) " + " UNION ALL ".join(f"SELECT '{n}' AS kind, 'http://c/' || k AS focus FROM t WHERE {w}" for n, w in _BREAKS.items()) + " UNION ALL SELECT 'objects', * FROM (VALUES ('http://n/2'), ('http://n/3'))"


def text_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for two words, one of which must occur."""
    from quillon.operators.text import text_query

    found = text_query(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "+license apache", limit=20)
    return found.select("doc_id", F.round("score", 6).alias("score"))


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
TEXT_SCORED_SQL = f"""WITH d AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS a, len(list_filter(w, lambda x: x = 'apache')) AS b FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL)),
s AS (SELECT count(*) AS docs, avg(n) AS size, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM d),
r AS (SELECT doc_id, ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / size)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / size)) AS score FROM d, s WHERE a > 0)
SELECT doc_id, round(score, 6) AS score FROM r ORDER BY score DESC, doc_id LIMIT 20"""


def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items by a phrase, a prefix and a fuzzy word, each a query of its own."""
    from quillon.operators.text import text_query

    docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    parts = {"phrase": '"of the"', "prefix": "tha*", "fuzzy": "thet~1", "without": "the -was"}
    return reduce(DataFrame.unionByName, [text_query(docs, "item_id", "text", q).select(F.lit(n).alias("part"), "item_id") for n, q in parts.items()])


_ITEMS = f"WITH d AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL)"
TEXT_PARTS_SQL = _ITEMS + " SELECT 'phrase' AS part, item_id FROM d WHERE contains(' ' || list_aggregate(w, 'string_agg', ' ') || ' ', ' of the ') UNION ALL SELECT 'prefix', item_id FROM d WHERE len(list_filter(w, lambda x: starts_with(x, 'tha'))) > 0 UNION ALL SELECT 'fuzzy', item_id FROM d WHERE len(list_filter(w, lambda x: levenshtein(x, 'thet') <= 1)) > 0 UNION ALL SELECT 'without', item_id FROM d WHERE list_contains(w, 'the') AND NOT list_contains(w, 'was')"


def linked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region as a linked list: members with their places, and lengths."""
    from quillon.operators.lists import FIRST, NIL, REST, list_lengths, list_members
    from pyspark.sql import Window

    over = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    cells = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat_ws("-", F.lit("l"), "n_regionkey", F.row_number().over(over)).alias("s"), F.concat_ws("-", F.lit("l"), "n_regionkey", F.row_number().over(over) + 1).alias("next"), "n_name", F.lead("n_nationkey").over(over).alias("more"))
    triples = cells.select("s", F.lit(FIRST).alias("p"), F.col("n_name").alias("o")).unionByName(cells.select("s", F.lit(REST).alias("p"), F.when(F.col("more").isNull(), NIL).otherwise(F.col("next")).alias("o")))
    return list_members(triples).join(list_lengths(triples), "list").select("list", "index", "member", "length")


FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], Callable[[], str] | str]] = {
    "prob_densities": (prob_densities, _densities_sql),
    "prob_divergence": (prob_divergence, DIVERGENCE_SQL),
    "rdfs_schema": (rdfs_schema, "SELECT 'c' || c_custkey AS s, p, 'n' || c_nationkey AS o FROM customer, (VALUES ('knows'), ('relatedTo')) t(p) UNION ALL SELECT 'c' || c_custkey, 'type', o FROM customer, (VALUES ('Person'), ('Agent')) t(o) UNION ALL SELECT DISTINCT 'n' || c_nationkey, 'type', 'Place' FROM customer"),
    "rule_builtins": (rule_builtins, RULE_SQL),
    "shape_constraints": (shape_constraints, SHAPE_SQL),
    "text_scored": (text_scored, TEXT_SCORED_SQL),
    "text_parts": (text_parts, TEXT_PARTS_SQL),
    "linked_lists": (linked_lists, "SELECT 'l-' || n_regionkey || '-1' AS list, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS index, n_name AS member, count(*) OVER (PARTITION BY n_regionkey) AS length FROM nation"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _text(name) for name in TEXT} | {name: f for name, (f, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in TEXT.items()} | {name: sql() if callable(sql) else sql for name, (_, sql) in FUNCTIONS.items()} | {"gauss_divjoin": GAUSS_DIVJOIN_SQL}
