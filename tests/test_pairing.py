"""Stateful pairing on a stream: equal to the table, whatever the micro-batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from netlens.operators import http
from netlens.streaming import live, pairing


def bag(df):
    return sorted(map(repr, map(tuple, df.collect())))


def exchange(n, seed):
    """Requests and responses of a few connections in order of time, with gaps and repeats."""
    rng = random.Random(seed)
    rows, at = [], 0.0
    for _ in range(n):
        at += rng.choice([0.001, 0.4, 3.0])
        port, ask = 1000 + rng.randrange(3), rng.random() < 0.55
        side = {"src_port": port, "dst_port": 80} if ask else {"src_ip": "10.0.0.2", "dst_ip": "10.0.0.1", "src_port": 80, "dst_port": port}
        web = {"http_method": "GET", "http_uri": f"/{port}", "http_host": None} if ask else {"http_status": 200}
        name = {"dns_query": "a.b", "dns_qr": 0, "dns_type": "A"} if ask else {"dns_response": "1.2.3.4", "dns_qr": 1, "dns_rcode": 0}
        rows.append({"at": at, **side, **web, **name})
    return rows


def stream(spark, df, folder, parts, shuffled=0):
    """The rows in files of their order, a few of them out of place, and an end of the feed."""
    rows = df.orderBy("frame_number").collect()
    for i in range(0, len(rows) - shuffled, 7 if shuffled else len(rows)):
        rows[i], rows[i + shuffled] = rows[i + shuffled], rows[i]
    size = -(-len(rows) // parts)
    last = df.limit(1).withColumns({"ts": F.lit("2100-01-01").cast("timestamp"), "capture_id": F.lit(None).cast("string")})
    for i, lo in enumerate([*range(0, len(rows), size), None]):
        part = last if lo is None else spark.createDataFrame(rows[lo : lo + size], df.schema)
        path = os.path.join(folder, f"{i}.json")
        with open(path, "w") as out:
            out.write("\n".join(part.toJSON().collect()))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    session = pairing.stateful_session(spark)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(folder)


def run(out, tmp, mode="append"):
    parts = []
    query = out.writeStream.outputMode(mode).foreachBatch(lambda b, n: parts.extend(b.collect())).option("checkpointLocation", f"{tmp}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    return parts, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]], query


@pytest.mark.parametrize(("parts", "shuffled"), [(1, 0), (6, 2)])
def test_http_pairs_equal_the_table(spark, packets, tmp_path, parts, shuffled):
    table = packets(*exchange(80, 3))
    folder = tmp_path / "in"
    folder.mkdir()
    got, _, _ = run(pairing.http_transactions(stream(spark, table, str(folder), parts, shuffled), timeout_us=10**9), tmp_path)
    want = http.transactions(table)
    assert sorted(map(repr, (tuple(r) for r in got if r["capture_id"]))) == bag(want) and len(got) > 10


def test_unanswered_queries_leave_by_timer(spark, packets, tmp_path):
    rows = exchange(60, 4)
    table = packets(*rows)
    folder = tmp_path / "in"
    folder.mkdir()
    got, state, _ = run(pairing.dns_transactions(stream(spark, table, str(folder), 5), timeout_us=2_000_000), tmp_path)
    want, asked = [], {}
    for number, r in enumerate(rows, 1):
        port = r["src_port"] if "dns_query" in r else r["dst_port"]
        before = asked.pop(port, None)
        slow = before is not None and round(r["at"] * 1e6) - round(before[1] * 1e6) > 2_000_000
        if slow:
            want.append((before[0], "TIMEOUT"))
        if "dns_query" in r:
            asked[port] = (number, r["at"])
        elif before is not None and not slow:
            want.append((before[0], "NOERROR"))
    want += [(number, "TIMEOUT") for number, _ in asked.values()]
    assert sorted((r["query_frame"], r["outcome"]) for r in got if r["capture_id"]) == sorted(want)
    assert {o for _, o in want} == {"TIMEOUT", "NOERROR"}
    assert max(state) > state[-1] and state[-1] <= 3  # what is left belongs to the end of the feed


def test_messages_without_numbers_do_not_break(spark, packets, tmp_path):
    table = packets({"http_method": "GET", "src_port": None}, {"at": 1.0, "http_status": 200, "src_ip": "10.0.0.2", "dst_ip": "10.0.0.1"})
    table = table.withColumn("frame_number", F.nullif("frame_number", F.lit(1)))
    folder = tmp_path / "in"
    folder.mkdir()
    got, _, _ = run(pairing.http_transactions(stream(spark, table, str(folder), 1)), tmp_path)
    assert [(r["request_frame"], r["client_port"], r["status"]) for r in got if r["capture_id"]] == [(None, None, 200)]


def test_connections_leave_after_their_ttl(spark, packets, tmp_path):
    rows = [{"at": float(i), "src_ip": f"10.0.0.{i % 3}", "packet_size": 10 + i} for i in range(30)] + [{"at": 500.0, "src_ip": "10.0.0.0", "packet_size": 7}]
    table = live.from_packets(packets(*rows)).withColumnRenamed("feed", "capture_id").withColumn("frame_number", F.monotonically_increasing_id())
    folder = tmp_path / "in"
    folder.mkdir()
    feed = stream(spark, table, str(folder), 31).withColumnRenamed("capture_id", "feed").withWatermark("ts", "1 second")
    got, state, _ = run(pairing.connections(feed, 60_000_000), tmp_path, "update")
    closed = sorted((r["src_ip"], r["packets"], r["bytes"]) for r in got if r["closed"] and r["feed"])
    size = lambda k: sum(10 + i for i in range(30) if i % 3 == k)
    assert closed == [("10.0.0.0", 1, 7), ("10.0.0.0", 10, size(0)), ("10.0.0.1", 10, size(1)), ("10.0.0.2", 10, size(2))]
    assert sum(1 for r in got if not r["closed"] and r["feed"]) == 31  # one row for each change
    assert max(state) >= 3 and state[-1] <= 1


def test_state_is_kept_by_bucket_not_by_connection(spark, packets, tmp_path):
    rows = [r for k in range(1500) for r in ({"at": k * 0.001, "src_port": 2000 + k, "dst_port": 80, "http_method": "GET", "http_uri": f"/{k}"}, {"at": k * 0.001 + 0.5, "src_ip": "10.0.0.2", "dst_ip": "10.0.0.1", "src_port": 80, "dst_port": 2000 + k, "http_status": 200})]
    folder = tmp_path / "in"
    folder.mkdir()
    got, state, _ = run(pairing.http_transactions(stream(spark, packets(*rows), str(folder), 1)), tmp_path)
    assert sorted((r["client_port"], r["uri"], r["response_us"]) for r in got if r["capture_id"]) == [(2000 + k, f"/{k}", 500_000) for k in range(1500)]
    assert max(state) < 1500  # a row of state for each connection made streams of many connections slow
