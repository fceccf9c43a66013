import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from findmill.operators import events as ev
from findmill.operators.diff import interval_coalesce
from findmill.operators.ordered import Running, with_running


def test_running_values_equal_plain_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), i, rng.choice([None, 1, 2, 3, 4])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    w = Window.partitionBy("k").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "k", "i", F.row_number().over(w).alias("c"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"), F.last("v", ignorenulls=True).over(upto).alias("l"), F.lag("v").over(w).alias("p"),
    )
    for width in (1, 7, 1000):
        got = with_running(
            df, ["k"], ["i"], F.floor(F.col("i") / width),
            {"c": Running("count"), "s": Running("sum", F.col("v")), "m": Running("max_before", F.col("v")), "l": Running("last", F.col("v")), "p": Running("lag", F.col("v"))},
        ).select("k", "i", "c", "s", "m", "l", "p")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def merged(ranges):
    out = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(r) for r in out]


def test_interval_coalesce_against_sort_and_merge(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 20), (s := rng.randint(1, 300)), s + rng.randint(0, 6)) for _ in range(900)]
    df = spark.createDataFrame(rows, "g int, start int, end int")
    for width in (8, 1 << 16):
        got = sorted(map(tuple, interval_coalesce(df, ["g"], width).collect()))
        assert got == sorted((g, *r) for g in {r[0] for r in rows} for r in merged([x[1:] for x in rows if x[0] == g]))


def test_hot_scan_sequence_and_ring(spark):
    """One scan holds nine of ten events; its numbers stay dense and the ring exact."""
    df = spark.range(5000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 10 == 0, F.col("id") % 7 + 1).otherwise(0).alias("scan_id"))
    seq = ev.event_seq(df, ["event_id"], F.floor(F.col("event_id") / 100))
    hot = [r["seq"] for r in seq.where("scan_id = 0").orderBy("event_id").collect()]
    assert hot == list(range(1, len(hot) + 1))
    ring = ev.event_ring(seq, 2000).where("scan_id = 0")
    assert ring.count() == 2000 and ring.agg(F.min("seq")).first()[0] == len(hot) - 1999


def test_progress_stops_at_hundred(spark):
    polls = spark.createDataFrame([(1, i, s) for i, s in enumerate(["0", "0", "x", "5", "5", "100", "100", "3"])], "scan_id long, i long, status string")
    got = ev.progress_changes(polls, ["scan_id"], ["i"], F.floor(F.col("i") / 2)).orderBy("i").collect()
    assert [(r["i"], r["pct"]) for r in got] == [(0, 0), (3, 5), (5, 100)]
