"""Chunked scans against plain windows, with chunks small enough to matter."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netlens.functions import net
from netlens.operators import dns, flows
from netlens.operators.ordered import frame_chunk, index_percentiles, scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice("aaab"), i, rng.choice([None, rng.randint(0, 50)])) for i in range(600)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, frame_number long, v long")


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_scan_equals_window(rows, size):
    w = Window.partitionBy("k").orderBy("frame_number")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select(
        "*",
        F.last("v", ignorenulls=True).over(before).alias("last_v"),
        F.lag("frame_number").over(w).alias("prev"),
        F.sum("v").over(w).alias("total"),
        F.row_number().over(w).cast("long").alias("n"),
    )
    got = scan(
        rows,
        ["k"],
        [F.col("frame_number")],
        frame_chunk(size),
        last={"last_v": F.col("v"), "prev": F.col("frame_number")},
        sums={"total": F.col("v"), "n": F.lit(1).cast("long")},
    )
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("bucket", [3, 1 << 20])
def test_index_percentiles(rows, bucket):
    got = {r["k"]: (r["p50"], r["p95"]) for r in index_percentiles(rows, ["k"], "v", {"p50": 0.5, "p95": 0.95}, bucket).collect()}
    want = {}
    for k in "ab":
        values = sorted(r["v"] for r in rows.where(F.col("k") == k).collect() if r["v"] is not None)
        want[k] = (values[int(len(values) * 0.5)], values[int(len(values) * 0.95)])
    assert got == want


@pytest.mark.parametrize("chunk_us", [1_000_000, 60_000_000])
def test_dns_match_brute_force(packets, chunk_us):
    rng = random.Random(11)
    rows = [
        {"protocol": "UDP", "dns_id": rng.randint(1, 2), "dns_qr": rng.randint(0, 1), "dns_rcode": rng.choice([0, 3]),
         "at": rng.randint(0, 40) / 4}
        for _ in range(200)
    ]
    want = {}
    for i, q in enumerate(rows):
        if q["dns_qr"] == 0:
            later = [(r["at"], r["dns_rcode"]) for r in rows if r["dns_qr"] == 1 and r["dns_id"] == q["dns_id"] and r["at"] > q["at"]]
            best = min(later) if later else None
            want[i + 1] = (round((best[0] - q["at"]) * 1e6), best[1]) if best else (None, None)
    got = {r["frame_number"]: (r["response_us"], r["rcode"]) for r in dns.matched_by_id(packets(*rows), chunk_us).collect()}
    assert got == want


def test_idle_sessions_equal_session_window(packets):
    rng = random.Random(5)
    at = 0.0
    rows = []
    for _ in range(150):
        at += rng.choice([1, 100, 299, 300, 301, 1000])
        rows.append({"src_port": 1000 + rng.randint(0, 1), "dst_port": 80, "at": at})
    p = packets(*rows)
    want = (
        net.with_endpoints(p)
        .groupBy(*net.CONVERSATION, F.session_window("ts", "300 seconds").alias("s"))
        .agg(F.count("*").alias("packets"), F.sum("packet_size").alias("bytes"))
        .select(*net.CONVERSATION, net.us("s.start"), net.us("s.end"), "packets", "bytes")
    )
    assert sorted(map(tuple, flows.idle_sessions(p).select(*net.CONVERSATION, "start_us", "end_us", "packets", "bytes").collect())) == sorted(map(tuple, want.collect()))


def test_carries_by_number_are_hashed_and_keep_rows_without_one(spark):
    rows = [("a", None, 7), ("a", 1, 8), ("a", 10, None), ("a", 25, 9)]
    df = spark.createDataFrame(rows, "k string, n long, v long")
    out = scan(df, ["k"], [F.col("n")], F.floor(F.col("n") / 10).cast("long"), last={"prev": F.col("v")})
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["n"]: r["prev"] for r in out.collect()} == {None: None, 1: 7, 10: 8, 25: 8}
