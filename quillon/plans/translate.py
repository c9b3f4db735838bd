"""Query text to one lazy DataFrame: patterns compose algebra operators, Catalyst plans the rest."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.builtins import BUILTINS
from quillon.operators import algebra as A
from quillon.operators.divergence import divjoin, fusejoin, hist_divjoin, last_stats
from quillon.sources.graphs import IN_GRAPH, term_forms

from .syntax import AGGREGATES, Parser, Query, parse


#: What users register: aggregates (of Columns), functions written as expressions, sources that SERVICE names.
CUSTOM: dict[str, Callable[..., Column]] = {}
DEFINED: dict[str, tuple[list[str], tuple]] = {}
SERVICES: dict[str, object] = {}


def register_aggregate(name: str, function: Callable[..., Column]) -> None:
    """Adds an aggregate: a function of Columns to an aggregate Column (also a grouped-aggregate Pandas UDF)."""
    CUSTOM[name.lower()] = function


def define(name: str, parameters: list[str], expression: str) -> None:
    """Adds a function written in the query language itself: define("twice", ["x"], "?x * 2")."""
    DEFINED[name.lower()] = (parameters, Parser(expression).expression())


def register_service(name: str, source) -> None:
    """Adds a source that SERVICE <name> { ... } is matched against."""
    SERVICES[name] = source


def evaluate(source, text: str, union_default: bool = False, describe: Callable | None = None) -> DataFrame:
    """Runs a SELECT, ASK, CONSTRUCT, DESCRIBE or JSON query over a source with match(triples) and edges(predicate). With union_default, the union of all named graphs is the default graph. `describe` (source, nodes: s) -> triples replaces the closure over blank nodes."""
    return Translator(source.union_default() if union_default else source, describe).run(parse(text))


#: Functions whose string arguments count as text, as numbers, or as times. In quads, terms are strings with quotes and suffix.
_TEXTUAL = frozenset("str strlen ucase lcase substr strstarts strends contains strbefore strafter concat encode_for_uri replace regex md5 sha1 sha224 sha256 sha384 sha512 normalize-space upper-case lower-case string-length starts-with ends-with substring substring-before substring-after".split())
_NUMERIC = frozenset("abs ceil floor round ceiling sqrt exp log log10 pow sin cos tan asin acos atan idiv mod sq cube".split())
_TIMES = frozenset([*"year month day hours minutes seconds".split(), *[f"{part}-from-{kind}" for kind in ("datetime", "date", "time") for part in ("year", "month", "day", "hours", "minutes", "seconds")]])


def _is_number(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


class Translator:
    def __init__(self, source, describe: Callable | None = None):
        self.source = source
        self.describe = describe or described
        self.spark = SparkSession.active()
        self.fresh = 0

    def name(self) -> str:
        self.fresh += 1
        return f"__t{self.fresh}"

    def run(self, q: Query) -> DataFrame:
        if q.default or q.named:
            self.source = self.source.dataset(q.default, q.named)
        if q.form == "ask":
            rows = self.group(q.where)
            return rows.df.limit(1).agg((F.count("*") > 0).alias("answer"))
        if q.form == "construct":
            rows = self.group(q.where)
            parts = [rows.df.select(*[self.made(t, rows, n).alias(n) for t, n in zip(triple, "spo", strict=True)]) for _, *triple in q.template]
            return reduce(DataFrame.unionByName, parts).dropna().distinct()
        if q.form == "describe":
            seeds = [self.spark.createDataFrame([(t[1],)], "s string") for t, _ in q.items if t[0] == "iri"]
            names = [t[1] for t, _ in q.items if t[0] == "var"]
            if names:
                rows = self.group(q.where).df
                seeds += [rows.select(F.col(f"`{n}`").cast("string").alias("s")) for n in names]
            return self.describe(self.source, reduce(DataFrame.unionByName, seeds).dropna().distinct())
        if q.form == "json":
            rows = self.group(q.where)
            return rows.df.select(F.to_json(F.struct(*[self.value(e, rows).alias(k) for e, k in q.items])).alias("json"))
        return self.select(q).df

    def made(self, term: tuple, rows: A.Solutions, place: str) -> Column:
        """A template's term for a row, as a string; a blank node is new for each different row."""
        if term[0] == "var":
            return F.col(f"`{term[1]}`").cast("string") if term[1] in rows.vars else F.lit(None).cast("string")
        if term[0] == "iri" and term[1].startswith("_:"):
            row = F.to_json(F.struct(*[F.col(f"`{v}`") for v in rows.vars]))
            return F.concat(F.lit(term[1] + "-"), F.md5(row.cast("binary")))
        if len(term) == 3:
            return F.lit(f'"{term[1]}"{term[2]}')
        return F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type" if place == "p" and term == ("iri", "a") and self.source.terms else str(term[1]))

    def select(self, q: Query) -> A.Solutions:
        rows = self.group(q.where)
        items = list(q.items) if q.items is not None else [(("var", v), v) for v in rows.vars if not v.startswith("__")]
        within = getattr(self.source, "graph", None)
        if isinstance(within, tuple) and within not in [e for e, _ in items]:  # a sub-select in GRAPH ?g runs in each graph
            items.append((within, within[1]))
            if q.group is not None or any(_has_aggregate(e) for e, _ in items):
                q.group = [*(q.group or []), (within, within[1])]
        grouped = q.group is not None or any(_has_aggregate(e) for e, _ in items)
        if grouped:
            rows = self.aggregate(rows, q, items)
        else:
            for e, v in items:
                if e != ("var", v):
                    rows = self.extended(rows, e, v)
        if q.order and not grouped:
            rows = A.Solutions(rows.df.orderBy(*self.orders(q, rows)), rows.maybe) if not q.distinct else rows
        elif q.order:
            rows = A.Solutions(rows.df.orderBy(*self.orders(q, rows)), rows.maybe)
        out = A.project(rows, [v for _, v in items])
        if q.distinct:
            out = A.Solutions(out.df.distinct(), out.maybe)
            if q.order:
                out = A.Solutions(out.df.orderBy(*self.orders(q, out)), out.maybe)
        df = out.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return A.Solutions(df, out.maybe)

    def orders(self, q: Query, rows: A.Solutions) -> list[Column]:
        """Unbound comes first going up."""
        return [self.value(e, rows).asc_nulls_first() if up else self.value(e, rows).desc_nulls_last() for e, up in q.order]

    def aggregate(self, rows: A.Solutions, q: Query, items: list) -> A.Solutions:
        keys = []
        for e, v in q.group or []:
            name = v or self.name()
            if e != ("var", name):
                rows = A.extend(rows, name, self.value(e, rows))
            keys.append(name)
        found: dict[str, Column] = {}

        def lifted(e):
            if isinstance(e, tuple) and _aggregates(e):
                key = repr(e)
                name = next((n for n, (k, _) in named.items() if k == key), None) or self.name()
                if name not in named:
                    named[name] = (key, self.aggregator(e, rows))
                return ("var", name)
            if isinstance(e, tuple) and e and e[0] in ("op", "call", "in"):
                return tuple([lifted(y) for y in x] if isinstance(x, list) else lifted(x) if isinstance(x, tuple) else x for x in e)
            return e

        named: dict[str, tuple[str, Column]] = {}
        items = [(lifted(e), v) for e, v in items]
        having = [lifted(e) for e in q.having]
        q.order = [(lifted(e), up) for e, up in q.order]
        found = {n: c.alias(n) for n, (_, c) in named.items()}
        columns = list(found.values()) or [F.count("*").alias(self.name())]
        df = rows.df.groupBy(*[f"`{k}`" for k in keys]).agg(*columns)
        out = A.Solutions(df, frozenset(found) | rows.maybe & frozenset(keys))
        for e in having:
            out = self.filtered(out, e)
        for e, v in items:
            if e != ("var", v):
                out = A.extend(out, v, self.value(e, out))
        return out

    def aggregator(self, e: tuple, rows: A.Solutions) -> Column:
        _, name, args, distinct, options = e
        if name.lower() in CUSTOM:
            return CUSTOM[name.lower()](*[self.value(a, rows) for a in args])
        if name == "count":
            if args and args[0] == ("star",):
                return F.count_distinct(F.struct(*[F.col(f"`{v}`") for v in rows.vars])) if distinct else F.count("*")
            return F.count_distinct(self.value(args[0], rows)) if distinct else F.count(self.value(args[0], rows))
        x = self.value(args[0], rows)
        if name in ("sum", "avg", "median", "stdev", "stdev_samp", "stdev_pop", "variance", "var_samp", "var_pop") and self.kinds(rows, x) == ["string"]:
            x = _number(x)
        if name == "fold":
            if len(args) == 2:  # a map; of a repeated key the last by the order counts
                order, up = options.get("order", (args[0], True))
                entries = F.sort_array(F.collect_list(F.struct(self.value(order, rows).alias("o"), x.alias("k"), self.value(args[1], rows).alias("v"))), asc=up)
                return F.aggregate(entries, F.lit(None).cast("map<string,string>"), lambda m, s: F.map_concat(F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: k != s["k"].cast("string")), F.create_map(s["k"].cast("string"), s["v"].cast("string"))))
            order, up = options.get("order", (args[0], True))
            return F.transform(F.sort_array(F.collect_list(F.struct(self.value(order, rows).alias("o"), x.alias("v"))), asc=up), lambda s: s["v"])
        if name == "group_concat":
            text = x.cast("string")
            sorted_ = F.array_sort(F.collect_set(text) if distinct else F.collect_list(text))
            return F.array_join(sorted_, options.get("separator", " "))
        if name == "mode":
            return _mode(x)
        if name == "median":
            return F.median(x)
        sums = {"sum": F.sum_distinct if distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max, "sample": F.min, "stdev": F.stddev_samp, "stdev_samp": F.stddev_samp, "stdev_pop": F.stddev_pop, "variance": F.var_samp, "var_samp": F.var_samp, "var_pop": F.var_pop}
        if distinct and name == "avg":
            return F.sum_distinct(x) / F.count_distinct(x)
        return sums[name](x)

    def group(self, elements: list, within: A.Solutions | None = None) -> A.Solutions:
        """Elements in order; filters of a group apply to all of it."""
        rows, late, triples = within, [], []

        def flush() -> None:
            nonlocal rows
            if triples:
                part = self.basic(triples)
                rows = part if rows is None else A.join(rows, part)
                triples.clear()

        for e in elements:
            kind = e[0]
            if kind == "triple":
                triples.append(e[1:])
                continue
            if kind in ("filter", "exists"):
                late.append(e)
                continue
            flush()
            if kind == "bind":
                rows = self.extended(self.some(rows), e[1], e[2])
            elif kind == "let":
                rows = self.some(rows)
                if e[2] not in rows.vars:
                    rows = self.extended(rows, e[1], e[2])
                else:  # tests a variable that is bound, binds one that isn't
                    value, known = self.value(e[1], rows), F.col(f"`{e[2]}`")
                    rows = A.Solutions(rows.df.where(known.isNull() | (known == value)).withColumn(e[2], F.coalesce(known, value)), rows.maybe)
            elif kind == "unfold":
                rows = self.unfold(self.some(rows), e)
            elif kind == "optional":
                conditions = [x[1] for x in e[1] if x[0] == "filter"]
                inner = self.group([x for x in e[1] if x[0] != "filter"])
                rows = self.optional(self.some(rows), inner, conditions)
            elif kind in ("minus", "semi", "anti"):
                how = {"minus": A.minus, "semi": A.semi_join, "anti": A.anti_join}[kind]
                rows = how(self.some(rows), self.group(e[1]))
            elif kind == "lateral":
                rows = self.lateral(rows, e[1])
            elif kind in ("divjoin", "fusejoin"):
                rows = self.divergence(rows, e)
            else:
                part = self.part(e)
                rows = part if rows is None else A.join(rows, part)
        flush()
        rows = self.some(rows)
        for e in late:
            if e[0] == "filter":
                rows = self.filtered(rows, e[1])
            else:
                rows = (A.semi_join if e[2] else A.anti_join)(rows, self.correlated(e[1], rows))
        return rows

    def some(self, rows: A.Solutions | None) -> A.Solutions:
        return rows if rows is not None else A.Solutions(self.spark.range(1).select(F.lit(True).alias("__unit")))

    def filtered(self, rows: A.Solutions, e: tuple) -> A.Solutions:
        seen = rows.vars
        rows, e = self.marked(rows, e)
        return A.Solutions(rows.df.where(self.truth(self.value(e, rows), rows)).select(*[F.col(f"`{v}`") for v in seen]), rows.maybe)

    def extended(self, rows: A.Solutions, e: tuple, name: str) -> A.Solutions:
        rows, e = self.marked(rows, e)
        return A.extend(rows, name, self.value(e, rows))

    def marked(self, rows: A.Solutions, e):
        """Takes EXISTS out of an expression: each becomes a column that says whether the row has a match."""
        if not isinstance(e, tuple) or not e:
            return rows, e
        if e[0] == "exists":
            name = self.name()
            rows = A.mark(rows, self.correlated(e[1], rows), name)
            return rows, ("var", name) if e[2] else ("op", "!", [("var", name)])
        if e[0] not in ("op", "call", "in"):
            return rows, e
        out = []
        for x in e:
            if isinstance(x, list):
                items = []
                for y in x:
                    rows, y = self.marked(rows, y)
                    items.append(y)
                out.append(items)
            else:
                rows, x = self.marked(rows, x) if isinstance(x, tuple) else (rows, x)
                out.append(x)
        return rows, tuple(out)

    def kinds(self, rows: A.Solutions | None, *columns: Column) -> list[str]:
        base = rows.df if rows is not None else self.spark.range(1)
        return [k for _, k in base.select(*[c.alias(f"__k{i}") for i, c in enumerate(columns)]).dtypes]

    def truth(self, x: Column, rows: A.Solutions | None) -> Column:
        """Effective boolean value; null for what has none."""
        kind = self.kinds(rows, x)[0]
        if kind in ("boolean", "void"):
            return x.cast("boolean")
        if _is_number(kind):
            return (x != 0) & ~F.isnan(x.cast("double"))
        if kind != "string":
            return F.lit(None).cast("boolean")
        if not self.source.terms:
            return F.char_length(x) > 0
        typed = F.regexp_extract(x, r'\^\^<[^>]*#(\w+)>$', 1)
        number = _number(x)
        return F.when(typed == "boolean", _lexical(x).isin("true", "1")).when(number.isNotNull(), (number != 0) & ~F.isnan(number)).when(typed.isin("", "string"), F.char_length(_lexical(x)) > 0)

    def compared(self, symbol: str, a: Column, b: Column, rows: A.Solutions | None) -> Column:
        """A comparison; values that can't be compared give null, as an error does."""
        test = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[symbol]
        ka, kb = self.kinds(rows, a, b)
        if "void" in (ka, kb):
            return F.lit(None).cast("boolean")
        if ka == kb == "string" and self.source.terms:
            na, nb = _typed_number(a), _typed_number(b)
            other = test(a, b) if symbol in ("=", "!=") else test(_lexical(a), _lexical(b))
            return F.when(na.isNotNull() & nb.isNotNull(), test(na, nb)).otherwise(other)
        if ka == kb or (_is_number(ka) and _is_number(kb)) or {ka, kb} <= {"date", "timestamp", "timestamp_ntz"}:
            return test(a, b)
        if "string" in (ka, kb):
            other = kb if ka == "string" else ka
            if _is_number(other):
                return test(*[_number(x) if k == "string" else x for x, k in ((a, ka), (b, kb))])
            if other == "boolean" or other.startswith(("timestamp", "date")):
                return test(*[_lexical(x).try_cast(other) if k == "string" else x for x, k in ((a, ka), (b, kb))])
        return F.lit(None).cast("boolean")

    def calculated(self, symbol: str, a: Column, b: Column, rows: A.Solutions | None) -> Column:
        """Arithmetic; overflow, division by zero and what is no number give null."""
        a, b = (_number(x) if k == "string" else x for x, k in zip((a, b), self.kinds(rows, a, b), strict=True))
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[symbol](a, b)

    def correlated(self, elements: list, outer: A.Solutions) -> A.Solutions:
        """Pattern of an EXISTS: a filter that names outer variables is moved to the join by bringing those in."""
        filters = [e for e in elements if e[0] == "filter"]
        rest = [e for e in elements if e[0] != "filter"]
        inner = self.group(rest)
        for f in filters:
            missing = [v for v in _variables(f[1]) if v not in inner.vars and v in outer.vars]
            if missing:
                keys = [v for v in outer.vars if v in inner.vars]
                brought = A.Solutions(outer.df.select(*[F.col(f"`{v}`") for v in keys + missing]).distinct(), outer.maybe)
                inner = A.join(inner, brought)
            inner = self.filtered(inner, f[1])
        return inner

    def optional(self, left: A.Solutions, right: A.Solutions, conditions: list) -> A.Solutions:
        if not conditions:
            return A.left_join(left, right)
        clash = A.Solutions(left.df.select(*left.vars), left.maybe)
        merged = A.Solutions(left.df.limit(0).join(right.df.select(*[v for v in right.vars if v not in left.vars]).limit(0)) if [v for v in right.vars if v not in left.vars] else left.df)
        condition = reduce(lambda a, b: a & b, [self.truth(self.value(c, merged), merged) for c in conditions])
        return A.left_join(clash, right, condition)

    def unfold(self, rows: A.Solutions, e: tuple) -> A.Solutions:
        _, expr, v, w = e
        value = self.value(expr, rows)
        if dict(rows.df.select(value.alias("x")).dtypes)["x"].startswith("map"):
            df = rows.df.select("*", F.explode_outer(value).alias(v, w or self.name()))
        elif w:
            df = rows.df.select("*", F.posexplode_outer(value).alias(w, v)).withColumn(w, (F.col(w) + 1).cast("long"))
        else:
            df = rows.df.select("*", F.explode_outer(value).alias(v))
        return A.Solutions(df, rows.maybe | {v} | ({w} if w else set()))

    def lateral(self, rows: A.Solutions, elements: list) -> A.Solutions:
        """A sub-query with ORDER BY and LIMIT runs per left row: a ranking over the shared variables."""
        if len(elements) == 1 and elements[0][0] == "select" and elements[0][1].limit is not None:
            q = elements[0][1]
            limit, order = q.limit, q.order
            q.limit, q.order = None, []
            inner = self.select(q)
            keys = [v for v in rows.vars if v in inner.vars]
            q.order = order
            return A.join(rows, A.Solutions(A.top_per_key(inner.df, [f"`{k}`" for k in keys], self.orders(q, inner) or [F.lit(1)], limit), inner.maybe))
        return A.join(rows, self.group(elements))

    def divergence(self, rows: A.Solutions, e: tuple) -> A.Solutions:
        # Filters of the right side that name left variables see the pair.
        late = [x[1] for x in e[-1] if x[0] == "filter"]
        right = self.group([x for x in e[-1] if x[0] != "filter"])
        for f in [f for f in late if not (_variables(f) - set(right.vars)) & set(rows.vars)]:
            right, late = self.filtered(right, f), [x for x in late if x is not f]
        lvar, rvar, tolerance = e[1], e[2], e[3]
        keys = [v for v in rows.vars if v in right.vars]
        if "edges" in dict(rows.df.dtypes)[lvar]:
            out = hist_divjoin(rows.df, right.df, lvar, rvar, tolerance)
        elif e[0] == "fusejoin":
            out = fusejoin(rows.df, right.df, lvar, rvar, tolerance, e[4], keys or None)
        else:
            out = divjoin(rows.df, right.df, lvar, rvar, tolerance, keys=keys or None)[0]
        out = A.Solutions(out, rows.maybe | right.maybe)
        for f in late:
            out = self.filtered(out, f)
        return out

    def part(self, e: tuple) -> A.Solutions:
        if e[0] == "group":
            return self.group(e[1])
        if e[0] == "union":
            return reduce(A.union, [self.group(g) for g in e[1]])
        if e[0] == "select":
            return self.select(e[1])
        if e[0] == "values":
            _, names, rows = e
            kinds = [_kind([r[i] for r in rows]) for i in range(len(names))]
            df = self.spark.createDataFrame([tuple(float(c) if k == "double" and c is not None else c for c, k in zip(r, kinds, strict=True)) for r in rows], ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))).coalesce(1)
            return A.Solutions(df, frozenset(n for i, n in enumerate(names) if any(r[i] is None for r in rows)))
        if e[0] == "graph":
            _, term, block = e
            outer, self.source = self.source, self.source.in_graph(term)
            try:
                rows = self.group(block) if block else None
            finally:
                self.source = outer
            if term[0] == "var" and (rows is None or term[1] not in rows.vars):
                names = A.Solutions(outer.names().select(F.col("g").alias(term[1])))
                rows = names if rows is None else A.join(rows, names)
            return self.some(rows)
        if e[0] == "service":
            _, term, block, silent = e
            if term[1] not in SERVICES:
                if silent:
                    return self.some(None)
                raise ValueError(f"unknown service {term[1]}")
            outer, self.source = self.source, SERVICES[term[1]]
            try:
                return self.group(block)
            finally:
                self.source = outer
        raise ValueError(f"unknown element {e[0]}")

    def basic(self, triples: list) -> A.Solutions:
        simple = [t for t in triples if t[1][0] in ("iri", "var")]
        out = self.source.match(simple) if simple else None
        graph = getattr(self.source, "graph", None)
        for s, p, o in [t for t in triples if t[1][0] not in ("iri", "var")]:
            within = isinstance(graph, tuple)
            pairs = self.path(p) if within else self.ended(s, p, o)
            ends = {"s": F.col("s"), "o": F.col("o")}
            seen: dict[str, Column] = {}
            if within:  # nodes carry their graph
                ends = {n: F.substring_index(c, IN_GRAPH, -1) for n, c in ends.items()}
                seen[graph[1]] = F.substring_index("s", IN_GRAPH, 1)
            cond = F.lit(True)
            for name, term in (("s", s), ("o", o)):
                c = ends[name]
                if term[0] != "var":
                    cond = cond & (c.isin(term_forms(term)) if self.source.terms else c == F.lit(term[1]))
                elif term[1] in seen:
                    cond = cond & (c == seen[term[1]])
                else:
                    seen[term[1]] = c
            part = A.Solutions(pairs.where(cond).select(*[c.alias(v) for v, c in seen.items()] or [F.lit(True).alias("__unit")]))
            if not seen:
                part = A.Solutions(part.df.distinct().withColumnRenamed("__unit", self.name()))
            out = part if out is None else A.join(out, part)
        return out

    def ended(self, s: tuple, p: tuple, o: tuple) -> DataFrame:
        """Pairs of a path, searched from an end that is given; a path that may have no length joins a given end with itself, in the graph or not."""
        given = [t for t in (s, o) if t[0] != "var"]
        if not given or p[0] not in ("star", "plus", "maybe", "times"):
            return self.path(p)
        edges = self.path(p[1])
        kind = dict(edges.dtypes)["s"]
        ends = self.spark.createDataFrame([(f,) for t in given for f in (term_forms(t) if self.source.terms else [t[1]])], f"s {kind}").distinct()
        if p[0] in ("star", "plus"):
            if s[0] != "var":
                pairs = A.reached(edges, ends)
            else:
                pairs = A.reached(edges.select(F.col("o").alias("s"), F.col("s").alias("o")), ends).select(F.col("o").alias("s"), F.col("s").alias("o"))
        else:
            pairs = self.path(p)
        if p[0] in ("star", "maybe") or (p[0] == "times" and p[2] == 0):
            pairs = pairs.unionByName(ends.select("s", F.col("s").alias("o"))).distinct()
        return pairs

    def identity(self, edges: DataFrame) -> DataFrame:
        """Every node with itself: all of the graph, or where a source names none, the ends of the path's own edges."""
        if hasattr(self.source, "nodes"):
            nodes = self.source.nodes()
        else:
            nodes = edges.select("s").unionByName(edges.select(F.col("o").alias("s"))).distinct()
        return nodes.select("s", F.col("s").alias("o"))

    def path(self, p: tuple) -> DataFrame:
        kind = p[0]
        if kind == "iri":
            return self.source.edges(p[1])
        if kind == "inv":
            return self.path(p[1]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if kind == "seq":
            a, b = self.path(p[1]), self.path(p[2])
            return a.select("s", F.col("o").alias("m")).join(b.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        if kind == "alt":
            return self.path(p[1]).unionByName(self.path(p[2]))
        if kind == "not":
            forward, backward = ([x[1] for x in p[1] if x[0] == "iri"], [x[1][1] for x in p[1] if x[0] == "inv"])
            parts = [self.source.other_edges(forward)] if forward or not backward else []
            if backward:
                parts.append(self.source.other_edges(backward).select(F.col("o").alias("s"), F.col("s").alias("o")))
            return reduce(DataFrame.unionByName, parts)
        if kind == "multi":  # a row a path
            inner = p[1]
            if inner[0] not in ("plus", "star"):
                return self.path(inner)
            edges = self.path(inner[1])
            paths = A.counted(edges, 1)
            return paths.unionByName(self.identity(edges)) if inner[0] == "star" else paths
        if kind in ("distinct", "shortest"):  # both leave each pair of ends once
            inner = p[1]
            if kind == "shortest" and inner[0] in ("plus", "star"):
                edges = self.path(inner[1])
                pairs = A.shortest(edges).select("s", "o")
                return pairs.unionByName(self.identity(edges)).distinct() if inner[0] == "star" else pairs
            return self.path(inner).distinct()
        edges = self.path(p[1])
        if kind == "times":
            if p[2] > 0:
                return A.repeated(edges, p[2], p[3])
            longer = A.repeated(edges, 1, p[3]) if p[3] != 0 else edges.limit(0)
            pairs = longer.unionByName(self.identity(edges))
            return pairs.distinct() if p[3] is None else pairs
        if kind == "plus":
            return A.closure(edges)
        if kind == "star":
            return A.closure(edges).unionByName(self.identity(edges)).distinct()
        return edges.unionByName(self.identity(edges)).distinct()

    def value(self, e: tuple, rows: A.Solutions | None) -> Column:
        kind = e[0]
        if kind == "var":
            return F.col(f"`{e[1]}`") if rows is not None and e[1] in rows.vars else F.lit(None)
        if kind in ("lit", "iri"):
            return F.lit(f'"{e[1]}"{e[2]}' if len(e) == 3 and self.source.terms else e[1])
        if kind == "in":
            item = self.value(e[1], rows)
            found = reduce(lambda a, b: a | b, [self.compared("=", item, self.value(x, rows), rows) for x in e[2]], F.lit(False))
            return ~found if e[3] else found
        if kind == "op":
            symbol, args = e[1], [self.value(a, rows) for a in e[2]]
            if symbol == "!":
                return ~self.truth(args[0], rows)
            if symbol == "neg":
                return self.calculated("-", F.lit(0), args[0], rows)
            if symbol in ("||", "&&"):
                a, b = (self.truth(x, rows) for x in args)
                return a | b if symbol == "||" else a & b
            return (self.calculated if symbol in "+-*/" else self.compared)(symbol, *args, rows)
        if kind == "call":
            return self.called(e, rows)
        raise ValueError(f"cannot evaluate {kind} here")

    def called(self, e: tuple, rows: A.Solutions | None) -> Column:
        _, name, args, _, options = e
        low = name.lower()
        if low == "call" and args and args[0][0] in ("iri", "lit"):  # a function named by a constant
            return self.value(("call", re.split("[#/]", str(args[0][1]))[-1], args[1:], False, {}), rows)
        if low in DEFINED:
            names, body = DEFINED[low]
            return self.value(_put(body, dict(zip(names, args, strict=True))), rows)
        columns = [self.value(a, rows) for a in args]
        if low == "if":
            test = self.truth(columns[0], rows)
            return F.when(test, columns[1]).when(~test, columns[2])
        if low == "samevalue":
            return self.compared("=", *columns, rows)
        if low in ("lastdivjoinstats",):
            return _last_stats(args[0][1])
        function = BUILTINS.get(f"{options.get('prefix', '')}:{name}".lower()) or BUILTINS.get(name) or BUILTINS.get(low)
        if function is None:
            raise ValueError(f"unknown function {name}")
        if columns and low in _TEXTUAL | _NUMERIC | _TIMES:
            change = {True: _lexical if self.source.terms else (lambda c: c)}.get(low in _TEXTUAL) or (_number if low in _NUMERIC else lambda c: _lexical(c).try_cast("timestamp"))
            columns = [change(c) if k == "string" else c for c, k in zip(columns, self.kinds(rows, *columns), strict=True)]
        return function(*columns)


def _put(e, given: dict):
    """An expression with variables replaced by expressions."""
    if isinstance(e, list):
        return [_put(x, given) for x in e]
    if not isinstance(e, tuple):
        return e
    return given.get(e[1], e) if e[:1] == ("var",) else tuple(_put(x, given) for x in e)


def _lexical(c: Column) -> Column:
    """The text of a literal term without quotes and suffix."""
    return F.regexp_replace(c, r'(?s)^"(.*)"(@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', "$1")


def _number(c: Column) -> Column:
    """The number that a string or literal term spells, else null."""
    return _lexical(c).try_cast("double")


def _typed_number(c: Column) -> Column:
    """The value of a literal term of a numeric type, else null."""
    lexical = F.regexp_extract(c, r'^"([^"]*)"\^\^<[^>]*#(?:integer|decimal|double|float|int|long|short|byte|nonNegativeInteger|positiveInteger|unsignedInt|unsignedLong)>$', 1)
    return lexical.try_cast("double")


def _last_stats(field: str) -> Column:
    """A count of the last divergence join that ran; a call before any has is an error."""
    found = last_stats()
    if found is None or field not in found:
        raise ValueError(f"no divergence join has run, or it has no count {field}")
    return F.lit(found[field])


def described(source, nodes: DataFrame) -> DataFrame:
    """s, p, o of the nodes and of the blank nodes that they lead to."""
    triples = source.df.where(F.col("g").isNull()).select("s", "p", "o") if "g" in source.df.columns else source.df.select("s", "p", "o")
    blank = triples.where(F.startswith("o", F.lit("_:"))).select("s", "o")
    there = A.reached(blank, nodes).select(F.col("o").alias("s"))
    return triples.join(nodes.unionByName(there).distinct(), "s", "left_semi").select("s", "p", "o").distinct()


def _mode(x: Column) -> Column:
    """Most frequent value, the greatest of those that tie: one pass over the sorted group."""
    values = F.array_sort(F.collect_list(x))
    any_ = F.array_max(values)
    start = F.struct(F.lit(0).alias("most"), F.lit(0).alias("n"), any_.alias("last"), any_.alias("best"))

    def step(s: Column, v: Column) -> Column:
        n = F.when((s["n"] > 0) & (s["last"] == v), s["n"] + 1).otherwise(F.lit(1))
        return F.struct(F.greatest(s["most"], n).alias("most"), n.alias("n"), v.alias("last"), F.when(n >= s["most"], v).otherwise(s["best"]).alias("best"))

    return F.aggregate(values, start, step, lambda s: s["best"])


def _aggregates(e: tuple) -> bool:
    """Whether e is an aggregate; a function of a library may share its name."""
    return bool(e) and e[0] == "call" and (e[1].lower() in CUSTOM or (e[1] in AGGREGATES and e[4].get("prefix", "agg") in ("", "agg")))


def _has_aggregate(e) -> bool:
    return isinstance(e, tuple) and bool(e) and (_aggregates(e) or any(_has_aggregate(y) for x in e for y in (x if isinstance(x, list) else [x])))


def _variables(e) -> set[str]:
    if isinstance(e, tuple) and e and e[0] == "var":
        return {e[1]}
    if isinstance(e, tuple) and e and e[0] == "exists":
        return set()
    return set().union(*[_variables(y) for x in e for y in (x if isinstance(x, list) else [x])]) if isinstance(e, tuple) and e else set()


def _kind(values: list) -> str:
    kinds = {type(v) for v in values if v is not None}
    return "boolean" if kinds == {bool} else "long" if kinds == {int} else "double" if kinds and kinds <= {int, float} else "string"
