"""Functions of one text: that they do not compute a step once for each place where it stands, and what they give."""

import pytest
from pyspark.sql import functions as F

from impactlake.functions import anchors as A
from impactlake.functions import scalars as S


#: How often a plan may name its input; each branch that names a step computes it again.
@pytest.mark.parametrize(
    ("made", "most"),
    [(lambda c: A.parse_anchor(c)["key"], 70), (A.wildcard_breadth, 2), (lambda c: S.parse_test_id(c)["path"], 40), (lambda c: S.join_rest_route(F.lit("wc/v3"), c), 1)],
)
def test_a_step_names_the_one_before_it_once(spark, made, most):
    plan = spark.createDataFrame([("a",)], "said string").select(made(F.col("said")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.splitlines()[0].count("said#") <= most


def test_large_methods_are_cut_until_the_jvm_compiles_them(spark):
    from impactlake.plans import session

    session.measured_joins(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
    session.measured_joins(spark, False)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > 8000


def test_odd_texts(spark):
    rows = [("/a/(?P<x>[(]+)/(?<y>(b))z(c)", "/a/{*}/{*}z(c)"), ("(?P<a", "{*}"), ("(a)[(?P<b>c", "(a)[{*}"), ("", ""), (None, None), ("😀(?<x>.)", "😀{*}")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", S.collapse_route_params(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    rows = [("a/./b//../c", "a/c"), ("a.b/c..d", "a.b/c..d"), ("...", "..."), ("a/...//b", "a/.../b"), ("../..", ""), ("/", ""), ("", ""), (None, None)]
    got = spark.createDataFrame(rows, "t string, want string").select("want", S.normalise_path(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    rows = [("hook:a{*}", "wildcardPrefixed"), ("rest:GET //{*}//{*}/", "wildcardBroad"), ("rest:GET /{*}/x", "wildcardPrefixed"), ("hook:" + "{*}/" * 20000, "wildcardBroad"), (None, "wildcardPrefixed")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", A.wildcard_breadth(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
