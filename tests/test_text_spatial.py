"""Text queries and geometry on small fixtures."""

import math

from pyspark.sql import functions as F

from quillon.functions import spatial as S
from quillon.operators.text import text_query


def test_text_query(spark):
    rows = [(1, "The quick brown fox"), (2, "quick quick foxes, brown"), (3, "lazy dog"), (4, None), (5, ""), (6, "Brown bear: quick!")]
    docs = spark.createDataFrame(rows, "id int, t string")
    found = lambda q, **k: [r.id for r in text_query(docs, "id", "t", q, **k).orderBy(F.desc("score"), "id").collect()]
    assert set(found("quick")) == {1, 2, 6} and found("quick", limit=1) == [2]
    assert found('"quick brown"') == [1] and set(found("fox*")) == {1, 2} and found("lazi~1") == [3] and found("+quick -brown") == []
    assert set(found("+brown dog")) == {1, 2, 6} and set(found("dog bear")) == {3, 6} and found("-dog") == [] and found("") == []
    assert text_query(docs.limit(0), "id", "t", "x").count() == 0


def test_geometry(spark):
    box, inner, far = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", "POLYGON((9 9, 10 9, 10 10, 9 9))"
    cases = [("sfcontains", box, inner, True), ("sfwithin", inner, box, True), ("sfwithin", box, inner, False), ("sfintersects", box, far, False), ("sfdisjoint", box, far, True), ("sfcontains", box, "POINT(1 1)", True), ("sfcontains", box, "POINT(4 4)", False), ("sfintersects", box, "POINT(4 4)", True), ("sfintersects", "LINESTRING(-1 2, 5 2)", box, True), ("sfcontains", box, "LINESTRING(-1 2, 5 2)", False), ("sfequals", box, "POLYGON((4 0, 4 4, 0 4, 0 0, 4 0))", True), ("sfequals", "POINT(1 2)", "<http://crs> POINT (1.0 2.0)", True), ("sfintersects", box, "nonsense", None), ("sfintersects", box, None, None)]
    for name, a, b, want in cases:
        df = spark.createDataFrame([(a, b)], "a string, b string")
        assert df.select(S.FUNCTIONS[name](F.col("a"), F.col("b"))).first()[0] == want, (name, a, b)
    row = spark.range(1).select(S.great_circle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0), "kilometre").alias("d"), S.azimuth(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(5.0)).alias("z"), S.within_box(F.lit(1.0), F.lit(179.0), F.lit(0.0), F.lit(170.0), F.lit(5.0), F.lit(-170.0)).alias("w"), S.east_of(F.lit(-170.0), F.lit(170.0)).alias("e")).first()
    assert math.isclose(row.d, math.pi * 6371.0088 / 2, rel_tol=1e-9) and math.isclose(row.z, math.pi / 2) and row.w and row.e
