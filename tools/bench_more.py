"""Streams, page depths and tree depths, as one JSON line.

    python tools/bench_more.py [sf_dir]
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tablegov.operators import page as P  # noqa: E402
from tablegov.operators.tree import descendants  # noqa: E402
from tablegov.plans import Views  # noqa: E402
from tablegov.session import get_spark  # noqa: E402
from tablegov.streaming import streams as S  # noqa: E402


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stream_rate(spark, rows, build, work: str, files: int = 8) -> float:
    """Rows per second of an availableNow run over ``files`` files."""
    path = f"{work}/in"
    rows.repartitionByRange(files, "ts").write.mode("overwrite").parquet(path)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    start = time.perf_counter()
    query = build(source).writeStream.format("noop").outputMode("append").option(
        "checkpointLocation", f"{work}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    return round(rows.count() / (time.perf_counter() - start))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark(spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
                      spark__ui__showConsoleProgress="false",
                      spark__sql__streaming__stateStore__providerClass=S.ROCKSDB)
    spark.sparkContext.setLogLevel("ERROR")
    v = Views(spark, sf_dir)
    out: dict = {}
    events = v.events.withColumn("ts", F.col("ts").cast("timestamp"))
    work = tempfile.mkdtemp(prefix="tablegov-bench-")
    out["rate_limit_rows_per_sec"] = stream_rate(
        spark, events, lambda s: S.stream_rate_limit(s, 3, "6 hours", client="user_id", watermark="1 hour"), f"{work}/r")
    jobs = v.job_event.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("periodic", F.lit(False))
    out["job_runs_rows_per_sec"] = stream_rate(spark, jobs, lambda s: S.stream_job_runs(s, "1 hour"), f"{work}/j")
    orders = v.order
    by = [("updated_time", "desc")]
    last = P.page(orders, 1, 100, by).items.collect()[-1].asDict()
    pages = {
        "first": lambda: P.page(orders, 1, 100, by).items.collect(),
        "offset_9900": lambda: P.page(orders, 100, 100, by).items.collect(),
        "offset_140000": lambda: P.page(orders, 1401, 100, by).items.collect(),
        "keyset": lambda: P.keyset_page(orders, by, last, 100).collect(),
    }
    for name, fn in pages.items():
        fn()
        out[f"page_{name}_sec"] = timed(fn)
    for depth in (3, 50):
        # A tree of the given depth over the order keys: each level's node hangs below the one before.
        nodes = v.orders.select(F.col("o_orderkey").alias("id"), F.when(
            F.col("o_orderkey") >= F.lit(150_000 // depth), F.col("o_orderkey") - 150_000 // depth).alias("parent_id"))
        roots = nodes.filter("parent_id is null").select("id").limit(100)
        run = lambda: noop(descendants(nodes, roots))
        run()
        out[f"descendants_depth_{depth}_sec"] = timed(run)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
