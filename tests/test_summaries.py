import pytest
from pyspark.sql import functions as F

from tablegov.operators import summaries as Z


def events(spark, n=40_000):
    at = F.timestamp_seconds(F.col("id") * 40)
    return spark.range(n).select(F.col("id"), at.alias("ts"), (F.col("id") * 7919 % 9000).alias("u"),
                                 (F.col("id") * 31 % 1000 / 10).alias("x"),
                                 F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))


def test_merged_spans_agree_with_exact_counts(spark):
    df = events(spark)
    stored = Z.summarise(df, "ts", "1 hour", user="u", value="x")
    for span in (F.date_trunc("day", "slot"), F.date_trunc("week", "slot"), F.lit("all")):
        got = {r["span"]: r for r in Z.merge(stored, span, points={"p50": 0.5, "p99": 0.99}).collect()}
        own = df.withColumn("slot", F.col("ts")).groupBy(span.alias("span")).agg(
            F.count("*").alias("n"), F.count_distinct("u").alias("uv"), F.percentile_approx("x", F.array(
                F.lit(0.48), F.lit(0.52), F.lit(0.97), F.lit(1.0)), 100_000).alias("q")).collect()
        assert len(own) == len(got)
        for r in own:
            g = got[r["span"]]
            assert g["n"] == r["n"] and abs(g["uv"] - r["uv"]) <= 0.05 * r["uv"]
            assert r["q"][0] <= g["p50"] <= r["q"][1] and r["q"][2] <= g["p99"] <= r["q"][3]


def test_late_parts_and_groups(spark, rows):
    df = events(spark, 3000)
    late = F.col("id") % 9 == 0
    parts = Z.summarise(df.where(~late), "ts", "2 hours", ["k"], "u").unionByName(
        Z.summarise(df.where(late), "ts", "2 hours", ["k"], "u"))
    got = {r["k"]: (r["n"], r["uv"]) for r in Z.merge(parts, F.lit(1), ["k"]).collect()}
    for r in df.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("u").alias("uv")).collect():
        n, uv = got[r["k"]]
        assert n == r["n"] and uv == pytest.approx(r["uv"], rel=0.05)


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", None, None), ("2024-01-01 00:30:00", None, None), (None, 4, 2.0)],
                               "t string, u int, x double").withColumn("ts", F.col("t").cast("timestamp"))
    stored = Z.summarise(df, "ts", "2 hours", user="u", value="x")
    row, = Z.merge(stored, F.lit("all"), points={"p50": 0.5}).collect()
    assert (row["n"], row["uv"], row["p50"]) == (2, 0, None)
    assert Z.merge(Z.summarise(df.limit(0), "ts", user="u", value="x"), F.lit("all"), points={"p50": 0.5}).isEmpty()
