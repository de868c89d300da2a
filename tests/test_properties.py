"""Property tests (hypothesis): the distributed operators equal the window
functions they replace on arbitrary small inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.operators.ntile import global_ntile
from ledgerlake.operators.topk import top_k_with_ties

values = st.lists(st.one_of(st.none(), st.integers(min_value=0, max_value=6)), min_size=1, max_size=40)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(vals=values, tiles=st.integers(min_value=1, max_value=9), parts=st.integers(min_value=1, max_value=5))
def test_ntile_property(spark, vals, tiles, parts):
    df = spark.createDataFrame(list(enumerate(vals)), "id long, v long")
    order = [F.col("v").asc(), F.col("id").asc()]
    want = {r.id: r.t for r in df.select("id", F.ntile(tiles).over(Window.orderBy(*order)).alias("t")).collect()}
    got = {r.id: r.t for r in global_ntile(df, tiles, order, "t", partitions=parts).collect()}
    assert got == want


@SETTINGS
@given(vals=values, k=st.integers(min_value=1, max_value=8))
def test_topk_property(spark, vals, k):
    df = spark.createDataFrame(list(enumerate(vals)), "id long, v long")
    ranked = df.select("id", F.rank().over(Window.orderBy(F.col("v").desc())).alias("r"))
    want = sorted((r.id, r.r) for r in ranked.where(F.col("r") <= k).collect())
    got = sorted((r.id, r.rk) for r in top_k_with_ties(df, "v", k, "rk").collect())
    assert got == want
