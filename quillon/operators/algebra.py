"""Pattern algebra on solution tables: a DataFrame whose columns are variables, plus which of them may be unbound (null)."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Shared variables that may be unbound up to which rows are split by what they bind (four patterns a variable).
MOST_LOOSE = 3


@dataclass
class Solutions:
    df: DataFrame
    maybe: frozenset[str] = frozenset()

    @property
    def vars(self) -> list[str]:
        return self.df.columns


def _shared(left: Solutions, right: Solutions) -> list[str]:
    return [v for v in left.vars if v in set(right.vars)]


def _renamed(right: Solutions, shared: list[str]) -> DataFrame:
    return right.df.select(*[F.col(f"`{v}`").alias(f"{v}__r" if v in shared else v) for v in right.vars])


def _compatible(v: str, loose: bool) -> Column:
    a, b = F.col(f"`{v}`"), F.col(f"`{v}__r`")
    return (a == b) | a.isNull() | b.isNull() if loose else a == b


def _joined(left: Solutions, right: Solutions, how: str, extra=None) -> DataFrame:
    shared = _shared(left, right)
    loose = {v for v in shared if v in left.maybe or v in right.maybe}
    there = _renamed(right, shared)
    on = F.lit(True)
    for v in shared:
        on = on & _compatible(v, v in loose)
    if extra is not None:
        on = on & extra
    return left.df.join(there, on, how)


def _merged(df: DataFrame, left: Solutions, right: Solutions) -> DataFrame:
    shared = set(_shared(left, right))
    cols = [F.coalesce(F.col(f"`{v}`"), F.col(f"`{v}__r`")).alias(v) if v in shared else F.col(f"`{v}`") for v in left.vars]
    return df.select(*cols, *[F.col(f"`{v}`") for v in right.vars if v not in shared])


def _sides(left: Solutions, right: Solutions) -> tuple[list[str], list[str]]:
    """Shared variables that are always bound on both sides, and those that may not be."""
    shared = _shared(left, right)
    loose = [v for v in shared if v in left.maybe or v in right.maybe]
    return [v for v in shared if v not in loose], loose


def _masks(side: Solutions, loose: list[str]) -> list[tuple[DataFrame, frozenset[str]]]:
    """The side's rows by which of the loose variables they bind."""
    out = []
    for bound in product((True, False), repeat=len(loose)):
        if all(b or v in side.maybe for v, b in zip(loose, bound, strict=True)):
            cond = " and ".join(f"`{v}` is {'not ' if b else ''}null" for v, b in zip(loose, bound, strict=True))
            out.append((side.df.where(cond), frozenset(v for v, b in zip(loose, bound, strict=True) if b)))
    return out


def _on(keys: list[str], extra=None) -> Column:
    on = F.lit(True)
    for v in keys:
        on = on & (F.col(f"`{v}`") == F.col(f"`{v}__r`"))
    return on if extra is None else on & extra


def join(left: Solutions, right: Solutions, extra=None) -> Solutions:
    """Rows that agree wherever both are bound. Where a shared variable may be unbound, each pattern of bound variables is joined on its own keys, so that joins stay hash or merge joins."""
    sure, loose = _sides(left, right)
    maybe = frozenset(v for v in {*left.vars, *right.vars} if (v in left.maybe or v not in left.vars) and (v in right.maybe or v not in right.vars))
    if not loose or len(loose) > MOST_LOOSE:
        return Solutions(_merged(_joined(left, right, "inner", extra), left, right), maybe)
    out = None
    for mine, bound in _masks(left, loose):
        for other, there in _masks(right, loose):
            renamed = _renamed(Solutions(other), [*sure, *loose])
            part = _merged(mine.join(renamed, _on([*sure, *[v for v in loose if v in bound & there]], extra), "inner"), left, right)
            out = part if out is None else out.unionByName(part)
    return Solutions(out, maybe)


def _split(left: Solutions, right: Solutions, extra=None, sharing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of left with a compatible right row, the others), by patterns of bound variables; `sharing` wants a variable bound on both sides."""
    sure, loose = _sides(left, right)
    found, missed = left.df.limit(0), left.df.limit(0)
    for mine, bound in _masks(left, loose):
        for other, there in _masks(right, loose):
            keys = [*sure, *[v for v in loose if v in bound & there]]
            if sharing and not keys:
                continue
            renamed = _renamed(Solutions(other), [*sure, *loose])
            if not keys and extra is None:
                renamed = renamed.limit(1)  # any row will do
            found = found.unionByName(mine.join(renamed, _on(keys, extra), "left_semi"))
            mine = mine.join(renamed, _on(keys, extra), "left_anti")
        missed = missed.unionByName(mine)
    return found, missed


def _plain(left: Solutions, right: Solutions) -> bool:
    loose = _sides(left, right)[1]
    return not loose or len(loose) > MOST_LOOSE


def left_join(left: Solutions, right: Solutions, condition=None) -> Solutions:
    """OPTIONAL; the condition sees the merged row."""
    new = [v for v in right.vars if v not in left.vars]
    maybe = left.maybe | right.maybe | frozenset(new)
    if _plain(left, right):
        return Solutions(_merged(_joined(left, right, "left", condition), left, right), left.maybe | frozenset(new) | (right.maybe - frozenset(left.vars)))
    return Solutions(join(left, right, condition).df.unionByName(_split(left, right, condition)[1], allowMissingColumns=True), maybe)


def semi_join(left: Solutions, right: Solutions) -> Solutions:
    return Solutions(_joined(left, right, "left_semi") if _plain(left, right) else _split(left, right)[0], left.maybe)


def anti_join(left: Solutions, right: Solutions) -> Solutions:
    return Solutions(_joined(left, right, "left_anti") if _plain(left, right) else _split(left, right)[1], left.maybe)


def minus(left: Solutions, right: Solutions) -> Solutions:
    """Drops left rows with a compatible right row that shares a bound variable."""
    shared = _shared(left, right)
    if not shared:
        return left
    if not _plain(left, right):
        return Solutions(_split(left, right, sharing=True)[1], left.maybe)
    both = F.lit(False)
    for v in shared:
        both = both | (F.col(f"`{v}`").isNotNull() & F.col(f"`{v}__r`").isNotNull())
    loose = _sides(left, right)[1]
    return Solutions(_joined(left, right, "left_anti", both if loose else None), left.maybe)


def mark(left: Solutions, right: Solutions, name: str) -> Solutions:
    """Adds whether a left row has a compatible right row."""
    found, missed = (semi_join(left, right).df, anti_join(left, right).df) if _plain(left, right) else _split(left, right)
    return Solutions(found.withColumn(name, F.lit(True)).unionByName(missed.withColumn(name, F.lit(False))), left.maybe)


def union(left: Solutions, right: Solutions) -> Solutions:
    gaps = {v for v in left.vars if v not in right.vars} | {v for v in right.vars if v not in left.vars}
    return Solutions(left.df.unionByName(right.df, allowMissingColumns=True), left.maybe | right.maybe | frozenset(gaps))


def extend(rows: Solutions, name: str, value: Column) -> Solutions:
    """Adds a variable; an error in the expression leaves it unbound."""
    if name in rows.vars:
        raise ValueError(f"?{name} is already bound")
    return Solutions(rows.df.withColumn(name, value), rows.maybe | {name})


def project(rows: Solutions, names: list[str]) -> Solutions:
    have = [F.col(f"`{v}`") if v in rows.vars else F.lit(None).cast("string").alias(v) for v in names]
    return Solutions(rows.df.select(*have), frozenset(v for v in names if v in rows.maybe or v not in rows.vars))


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """LATERAL with ORDER BY and LIMIT: the first n rows of each key."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__n") <= n).drop("__n")


def reached(edges: DataFrame, starts: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(s, o): what paths of one edge or more reach from the starts (s). A search by frontier: edges elsewhere are never joined with one another. Each round is written to the shared folder."""
    from quillon.sources.shared import stored

    step = edges.select(F.col("s").alias("m"), F.col("o").alias("to"))
    known = new = stored(edges.join(starts, "s", "left_semi").select("s", "o").distinct(), "reached")
    for _ in range(rounds):
        more = new.join(step, F.col("o") == F.col("m")).select("s", F.col("to").alias("o")).distinct()
        new = stored(more.join(known, ["s", "o"], "left_anti"), "reached")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise RuntimeError(f"search did not settle in {rounds} rounds")


def shortest(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(s, o, steps): pairs joined by a path of one edge or more, with the fewest edges that do."""
    from quillon.sources.shared import stored

    step = edges.select(F.col("s").alias("m"), F.col("o").alias("to")).distinct()
    known = new = stored(edges.select("s", "o").distinct().withColumn("steps", F.lit(1).cast("long")), "shortest")
    for n in range(2, rounds):
        more = new.join(step, F.col("o") == F.col("m")).select("s", F.col("to").alias("o")).distinct().withColumn("steps", F.lit(n).cast("long"))
        new = stored(more.join(known, ["s", "o"], "left_anti").select("s", "o", "steps"), "shortest")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise RuntimeError(f"search did not settle in {rounds} rounds")


def counted(edges: DataFrame, least: int, rounds: int = 1000) -> DataFrame:
    """(s, o) once per path of `least` edges or more: bag semantics, only defined without cycles. Raises if paths do not end."""
    from quillon.sources.shared import stored

    at = stored(edges.select("s", "o"), "counted")
    nodes = edges.select("s").unionByName(edges.select(F.col("o").alias("s"))).distinct()
    out = at if least else at.unionByName(nodes.select("s", F.col("s").alias("o")))
    for _ in range(rounds):
        at = stored(at.select("s", F.col("o").alias("m")).join(edges.select(F.col("s").alias("m"), "o"), "m").select("s", "o"), "counted")
        if at.isEmpty():
            return out
        out = out.unionByName(at)
    raise RuntimeError(f"paths longer than {rounds} edges: a cycle?")


def repeated(edges: DataFrame, least: int, most: int | None) -> DataFrame:
    """(s, o): ends of paths of `least` to `most` edges (None: any number), one row per path for a fixed number of edges up to which the joins are written out, each pair once where the number is open."""
    def step(paths: DataFrame) -> DataFrame:
        return paths.select("s", F.col("o").alias("m")).join(edges.select(F.col("s").alias("m"), "o"), "m").select("s", "o")

    nodes = edges.select("s").unionByName(edges.select(F.col("o").alias("s"))).distinct()
    at = nodes.select("s", F.col("s").alias("o"))
    found = [at] if least == 0 else []
    for n in range(1, (least if most is None else most) + 1):
        at = edges.select("s", "o") if n == 1 else step(at)
        if n >= least:
            found.append(at)
    if most is None:
        longer = closure(edges)
        far = longer if least == 0 else at.select("s", F.col("o").alias("m")).join(longer.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        found.append(far)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct() if most is None else out


def closure(edges: DataFrame, reflexive: bool = False, rounds: int = 64) -> DataFrame:
    """(s, o): all pairs joined by a path of one edge or more (of any length, if reflexive). Safe on cycles.

    Paths double in each round: pairs found so far are joined with themselves
    until no new pair appears. Each round is written to the shared folder, which cuts lineage.
    """
    from quillon.sources.shared import stored

    known = stored(edges.select("s", "o").distinct(), "closure")
    size = known.count()
    for _ in range(rounds):
        longer = known.select("s", F.col("o").alias("m")).join(known.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        known = stored(known.unionByName(longer).distinct(), "closure")
        now = known.count()
        if now == size:
            break
        size = now
    else:
        raise RuntimeError(f"closure did not settle in {rounds} rounds")
    if reflexive:
        nodes = edges.select("s").unionByName(edges.select(F.col("o").alias("s"))).distinct()
        known = known.unionByName(nodes.select("s", F.col("s").alias("o"))).distinct()
    return known
