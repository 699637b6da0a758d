"""Texts of charts, images and formulas on hand-worked cases."""

from pyspark.sql import functions as F

from tidemark.operators import figures as G

_VISION = "struct<description:string,confidence:double,values:array<string>,series:array<string>>"


def test_charts_keep_their_own_layer_and_doubt_the_rest(spark):
    full = (" c ", ["a", "b"], [("t", None), ("y", "m")], "kg", "f", " near ")
    bare = ("", None, None, None, "", None)
    visions = [None, ("d", 0.6, ["1", "x2"], ["s"]), ("d", 0.59, ["1"], ["s"]), ("d", 0.9, ["one"], []), ("d", 0.9, ["1"], []), ("d", 0.9, [], None), ("d", None, [], [])]
    rows = [(i, *own, v) for i, (own, v) in enumerate([(o, v) for o in (full, bare) for v in visions])]
    df = spark.createDataFrame(rows, f"i int, c string, l array<string>, a array<struct<label:string,unit:string>>, u string, f string, n string, v {_VISION}")
    got = {r.i: r.b for r in df.select("i", G.chart(F.lit("NATIVE"), *[F.col(x) for x in "claufnv"]).alias("b")).collect()}
    own = "c\n图例：a、b\n坐标轴：t\n坐标轴：y（m）\n单位：kg\n脚注：f\nnear"
    assert tuple(got[0]) == ("NATIVE", own, False, "")
    assert tuple(got[1]) == ("VISION_DERIVED", own + "\n（模型派生描述）d\n数值：1；x2", False, "")
    assert [got[i].reason for i in range(1, 7)] == ["", "UNSURE", "NO_NUMBER", "NO_SERIES", "", "UNSURE"]
    assert all(got[i].text == own + "\n（模型派生描述）d" and got[i].unverified == (i != 5) for i in range(2, 7))
    assert tuple(got[7]) == ("NATIVE", None, False, "NO_SOURCE")
    assert got[8].text == "（模型派生描述）d\n数值：1；x2"


def test_images_and_formulas(spark):
    rows = [(1, "c", True, None), (2, " c ", False, ("d", 0.1, [], [])), (3, " ", None, ("d", 0.1, ["1"], ["s"])), (4, None, False, None)]
    df = spark.createDataFrame(rows, f"i int, c string, d boolean, v {_VISION}")
    got = {r.i: r.b and tuple(r.b) for r in df.select("i", G.image(F.lit("N"), F.col("c"), F.col("d"), F.col("v")).alias("b")).collect()}
    assert got == {1: None, 2: ("N", "c", False, ""), 3: ("VISION_DERIVED", "（模型派生描述）d", True, "UNSURE"), 4: ("N", None, False, "NO_SOURCE")}
    rows = [(1, "n", "a+b", [("a", "x"), ("b", "y")], "near"), (2, None, "a", None, ""), (3, "n", None, [("a", "x")], "near")]
    df = spark.createDataFrame(rows, "i int, n string, e string, v array<struct<symbol:string,meaning:string>>, c string")
    got = {r.i: tuple(r.b) for r in df.select("i", G.formula(F.lit("N"), *[F.col(x) for x in "nevc"]).alias("b")).collect()}
    assert got == {1: ("N", "公式：n\na+b\n变量：a — x；b — y\nnear", False, ""), 2: ("N", "a", False, ""), 3: ("N", None, False, "NOT_RECOGNISED")}
