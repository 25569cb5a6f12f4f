import json
import struct

from pyspark.sql import functions as F

from netlens.operators import detect, report, screen
from netlens.sources import captures, dissector, tables
from tests.conftest import one


def _nested(value, **extra):
    w = (lambda x: [str(x)]) if value == "list" else str
    return {
        "_source": {
            "layers": {
                "frame": {"frame.number": w(1), "frame.time": w("Jan  1, 2024 00:00:00.500000000 UTC"), "frame.len": w(74)},
                "ip": {"ip.src": w("10.0.0.1"), "ip.dst": w("10.0.0.2"), "ip.proto": w(6)},
                "tcp": {"tcp.srcport": w(40000), "tcp.dstport": w(80), "tcp.flags": w("0x0012"), "tcp.seq": w(0), "tcp.ack": w(1), "tcp.window": w(65535)},
                "http": {"http.request.method": w("GET"), "http.response.code": w("oops")},
                **extra,
            }
        }
    }


def test_dissector_forms(spark, tmp_path):
    flat = {"_source": {"layers": {"frame.number": ["2"], "frame.time": ["1704067200.25"], "ip.src": ["10.0.0.1"], "ip.dst": ["8.8.8.8"],
            "ip.proto": ["17"], "udp.srcport": ["5353"], "udp.dstport": ["53"], "udp.length": ["40"], "dns.qry.name": ["a.b"], "dns.qry.type": ["1"]}}}
    no_ip = {"_source": {"layers": {"frame": {"frame.number": "9"}}}}
    bad = _nested("scalar")
    bad["_source"]["layers"]["tcp"]["tcp.srcport"] = "many"
    lines = [json.dumps(x) for x in (_nested("scalar"), _nested("list"), flat, no_ip, bad)] + ["{broken"]
    (tmp_path / "cap7.json").write_text("\n".join(lines))
    rows = [r.asDict() for r in dissector.read_export(spark, str(tmp_path)).orderBy("frame_number").collect()]
    assert len(rows) == 3 and {r["capture_id"] for r in rows} == {"cap7"}
    assert rows[0] == rows[1]
    assert (rows[0]["tcp_flags"], rows[0]["src_port"], rows[0]["http_method"], rows[0]["http_status"]) == (18, 40000, "GET", None)
    assert rows[0]["ts"].microsecond == 500_000 and rows[2]["ts"].microsecond == 250_000
    assert (rows[2]["protocol"], rows[2]["dst_port"], rows[2]["udp_length"], rows[2]["dns_query"]) == ("UDP", 53, 40, "a.b")
    (tmp_path / "arr").mkdir()
    (tmp_path / "arr" / "x.json").write_text(json.dumps([_nested("list"), flat]))
    assert dissector.read_export(spark, str(tmp_path / "arr"), multiline=True).count() == 2
    for day in ("day1", "day2"):
        (tmp_path / "days" / day).mkdir(parents=True)
        (tmp_path / "days" / day / "x.json").write_text(json.dumps(flat))
    found = lambda path: sorted(r["capture_id"] for r in dissector.read_export(spark, str(path)).collect())
    assert found(tmp_path / "days" / "*" / "x.json") == found(tmp_path / "days" / "day*") == ["day1/x", "day2/x"]
    assert found(tmp_path / "days" / "day1") == found(tmp_path / "days" / "day1" / "x.json") == ["x"]


def _capture(order="<", magic=0xA1B2C3D4, version=(2, 4), snaplen=65535):
    head = struct.pack(order + "IHHiIII", magic, *version, 0, 0, snaplen, 1)
    tcp = struct.pack("!HHIIBBHHH", 40000, 80, 7, 8, 5 << 4, 0x18, 1024, 0, 0) + b"GET / HTTP/1.1"
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + tcp
    frame = b"\0" * 12 + b"\x08\x00" + ip
    arp = b"\0" * 12 + b"\x08\x06" + b"\0" * 28
    record = lambda f, s: struct.pack(order + "IIII", s, 5, len(f), len(f)) + f
    return head + record(frame, 1704067200) + record(arp, 1704067201) + record(frame, 1704067202)


def test_binary_captures(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(_capture())
    (tmp_path / "b.cap").write_bytes(_capture(">"))
    (tmp_path / "old.pcap").write_bytes(_capture(version=(1, 0)))
    (tmp_path / "text.pcap").write_bytes(b"not a capture, only text of some length")
    (tmp_path / "note.txt").write_bytes(_capture())
    rows = captures.read_captures(spark, str(tmp_path)).orderBy("capture_id", "frame_number").collect()
    assert [(r["capture_id"], r["frame_number"]) for r in rows] == [("a.pcap", 1), ("a.pcap", 3), ("b.cap", 1), ("b.cap", 3)]
    r = rows[0]
    assert (r["src_ip"], r["dst_port"], r["tcp_flags"], r["tcp_seq"], bytes(r["payload"])) == ("10.0.0.1", 80, 24, 7, b"GET / HTTP/1.1")
    types = {x["path"].rsplit("/", 1)[1]: x for x in screen.file_types(screen.read_files(spark, str(tmp_path))).collect()}
    assert types["a.pcap"]["header_ok"] and types["b.cap"]["header_ok"] and types["b.cap"]["link_type"] == 1
    assert not types["old.pcap"]["header_ok"] and types["text.pcap"]["looks_like"] == "Text file"
    assert not types["note.txt"]["extension_ok"]


def _udp(source, offset=0, body=b"hello"):
    datagram = struct.pack("!HHHH", source, 53, 8 + len(body), 0) + body
    return struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(datagram), 7, offset, 64, 17, 0) + bytes([10, 0, 0, 1, 10, 0, 0, 2]) + datagram


def test_later_fragments_have_no_ports():
    first, later = captures._packet(_udp(4000, 0x2000), 101), captures._packet(_udp(4000, 100), 101)
    assert (first["src_port"], first["payload"]) == (4000, b"hello")
    assert later["protocol"] == "UDP" and "src_port" not in later


def test_ipv6_is_cut_to_its_length_and_extensions_are_passed():
    datagram = struct.pack("!HHHH", 9, 53, 10, 0) + b"ab"
    hop = bytes([17, 0]) + bytes(6)
    packet = struct.pack("!IHBB", 6 << 28, len(hop + datagram), 0, 64) + bytes(15) + b"\1" + bytes(15) + b"\2" + hop + datagram + b"trailer"
    row = captures._packet(packet, 101)
    assert (row["ip_proto"], row["src_port"], row["payload"]) == (17, 9, b"ab")


def _block(kind, body):
    body += b"\0" * (-len(body) % 4)
    size = struct.pack("<I", len(body) + 12)
    return struct.pack("<I", kind) + size + body + size


def test_block_captures_and_file_status(spark, tmp_path):
    frame = _udp(4001)
    blocks = _block(captures.NG_SECTION, b"\x4d\x3c\x2b\x1a" + struct.pack("<HHq", 1, 0, -1))
    blocks += _block(1, struct.pack("<HHI", 101, 0, 0) + struct.pack("<HHB", 9, 1, 3) + bytes(3)) + _block(1, struct.pack("<HHI", 147, 0, 0))
    blocks += _block(6, struct.pack("<IIIII", 0, 0, 1500, len(frame), 900) + frame) + _block(6, struct.pack("<IIIII", 1, 0, 0, 4, 4) + b"abcd")
    for day in ("day1", "day2"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "cap.pcapng").write_bytes(blocks)
    (tmp_path / "odd.pcap").write_bytes(b"xx")
    rows = captures.read_captures(spark, str(tmp_path)).orderBy("capture_id").collect()
    assert [(r["capture_id"], r["frame_number"], r["src_port"], r["packet_size"]) for r in rows] == [(f"{d}/cap.pcapng", 1, 4001, 900) for d in ("day1", "day2")]
    assert captures.read_captures(spark, str(tmp_path)).selectExpr("unix_micros(ts) AS us").first()["us"] == 1_500_000
    status = {r["capture_id"]: (r["frames"], r["packets"], r["skipped"], r["reason"]) for r in captures.read_status(spark, str(tmp_path)).collect()}
    assert status["day1/cap.pcapng"] == (2, 1, 1, "not IP, link types 147") and status["odd.pcap"] == (0, 0, 0, "no capture")


def test_merging_keeps_what_is_not_replaced(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "capture_id string, tcp int, udp int")
    new = spark.createDataFrame([("a", 9, "x"), ("c", 3, "y")], "capture_id string, tcp int, dns string")
    got = {tuple(r) for r in report.merge_sections(old, new).select("capture_id", "tcp", "udp", "dns").collect()}
    assert got == {("a", 9, 5, "x"), ("b", 2, 6, None), ("c", 3, None, "y")}


def test_packets_table_prunes(spark, tmp_path, packets):
    p = packets({"at": 0}, {"at": 90_000}, {"capture_id": "d"})
    tables.write_packets(p, str(tmp_path / "t"))
    back = tables.read_packets(spark, str(tmp_path / "t"))
    assert back.count() == 3
    day = back.where("capture_id = 'c' AND dt = date '2024-01-02'").select("packet_size")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert day.count() == 1 and "PartitionFilters: [isnotnull(capture_id" in plan


def test_catalog_tables(spark, tmp_path):
    line = {"report_id": 1, "job_id": "j", "original_filename": "f", "status": "completed", "created_at": "2024-01-01T00:00:00Z"}
    bad = line | {"status": "odd"}
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, [line, bad])))
    assert tables.read_reports(spark, str(tmp_path / "r.json"), "json").count() == 1
    job = {"report_id": 1, "job_id": "j", "status": "success", "progress": 100}
    (tmp_path / "j.json").write_text("\n".join(map(json.dumps, [job, job | {"progress": 101}])))
    assert tables.read_jobs(spark, str(tmp_path / "j.json"), "json").count() == 1


def test_documents(spark, tmp_path, packets):
    p = packets(*[{"src_port": 40000, "dst_port": 80, "tcp_flags": 4, "capture_id": c} for c in "ccd"])
    first = report.triage_sections(p)
    docs = report.merge_sections(first, report.deep_sections(p, detect.packet_findings(p, detect.tcp_flags())))
    tables.write_documents(docs, str(tmp_path / "d"))
    tables.write_documents(docs.where("capture_id = 'd'"), str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d"))
    assert back.count() == 2
    c = one(back.where("capture_id = 'c'").select("traffic_stats.packets", "protocols", "top_talkers", "finding_counts"))
    assert (c["packets"], c["protocols"], len(c["top_talkers"])) == (2, {"TCP": 2}, 2)
    assert c["finding_counts"] == [{"type": "TCP_RESET", "severity": "high", "findings": 2}]
    want = {r["capture_id"]: r["risk_score"] for r in detect.risk_score(detect.packet_findings(p, detect.tcp_flags())).collect()}
    assert {r["capture_id"]: r["risk"]["risk_score"] for r in docs.collect()} == want
    rows = report.numbered(report.export_rows(docs)).where("capture_id = 'c'")
    assert rows.where("section = 'traffic_stats' AND item = 'packets' AND value = '2'").count() == 1
    tables.write_export(rows, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == rows.count()
    assert report.summaries(docs).where("capture_id = 'c'").first()["top_protocols"] == ["TCP"]


def test_screening(spark):
    import random

    rng = random.Random(4)
    noise = bytes(rng.randrange(256) for _ in range(20_000))
    files = {
        "noise": noise,
        "nulls": b"\xd4\xc3\xb2\xa1" + b"\0" * 5000,
        "mixed": b"a" * 10_000 + noise[:10_000],
        "tools": b" ".join(s.encode() for s in screen.MALWARE_STRINGS[:5]),
        "poly": b"x" * 150 + b"%PDF" + b"\x90" * 20,
        "early": b"%PDF" + b"x" * 150,
        "empty": b"",
    }
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    p = {r["path"]: r for r in screen.profiles(df).collect()}
    assert "High entropy detected" in p["noise"]["issues"] and p["noise"]["high_sections"] == 10
    assert p["nulls"]["trailing_nulls"] == 5000 and "Excessive null bytes" in p["nulls"]["issues"]
    assert "Unusual entropy distribution" in p["mixed"]["issues"]
    assert p["empty"]["entropy"] == 0.0 and p["empty"]["issues"] == []
    s = {r["path"]: r for r in screen.signatures(df).collect()}
    assert s["tools"]["issues"] == ["Multiple malware indicators detected"]
    assert s["poly"]["embedded"] == ["PDF document"] and s["early"]["embedded"] == []
    assert s["poly"]["exploits"] == ["NOP sled"] and s["poly"]["sequences"] == ["90909090"]
    v = {r["path"]: r["severity"] for r in screen.verdicts(df).collect()}
    assert (v["poly"], v["tools"], v["mixed"], v["early"]) == ("critical", "critical", "low", "high")
    twice = df.union(df.where("path = 'noise'").withColumn("path", F.lit("other")))
    assert one(screen.duplicates(twice))["files"] == 2


def test_tasks_of_the_derived_packets_grow_with_the_events(spark, tmp_path, monkeypatch):
    from netlens.sources import derived

    events = spark.range(200).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id AS user_id", "'view' AS event_type")
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(derived, "TASK_EVENTS", 5)
    p = derived.packets(spark, str(tmp_path))
    assert p.rdd.getNumPartitions() == 40 and p.count() == 1000
