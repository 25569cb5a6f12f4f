"""Captures read in byte ranges: the same packets as frame by frame, whatever the ranges."""

import datetime
import random
import struct

import pytest

from netlens.sources import captures

T0 = 1_704_067_200


def ipv4(proto, body, ihl=5, offset=0, total=None):
    size = ihl * 4 + len(body) if total is None else total
    head = struct.pack("!BBHHHBBH", 0x40 | ihl, 0, size, 7, offset, 64, proto, 0) + bytes([10, 0, random.randrange(4), 1, 192, 168, 0, random.randrange(4)])
    return head + b"\1" * (ihl * 4 - 20) + body


def frame(rng, order):
    data = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 300)))
    if rng.random() < 0.2:  # what looks like records inside a frame
        data = b"".join(struct.pack(order + "IIII", T0, 1, 20, 20) + bytes(20) for _ in range(6)) + data
    tcp = struct.pack("!HHIIBBHHH", rng.randrange(65536), 80, rng.randrange(1 << 32), 9, rng.choice([5, 6, 15]) << 4, rng.randrange(256), 500, 0, 0) + data
    udp = struct.pack("!HHHH", rng.randrange(65536), 53, 8 + len(data), 0) + data
    icmp = bytes([8, 0]) + bytes(6) + data
    six = struct.pack("!IHBB", 6 << 28, len(udp), 17, 64) + bytes(31) + b"\2" + udp
    kind, ip = rng.choice(
        [
            (0x0800, ipv4(6, tcp)), (0x0800, ipv4(6, tcp, total=0)), (0x0800, ipv4(17, udp) + b"pad"), (0x0800, ipv4(1, icmp)),
            (0x0800, ipv4(6, tcp, ihl=7)), (0x0800, ipv4(17, udp, offset=100)), (0x0800, ipv4(6, tcp[:15])), (0x0800, ipv4(47, data)),
            (0x86DD, six), (0x0806, bytes(28)), (0x0800, b"\x45"), (0x0800, ipv4(1, icmp[:3])),
        ]
    )
    vlan = b"\x81\x00\x00\x05" if rng.random() < 0.1 else b""
    return bytes(12) + vlan + struct.pack("!H", kind) + ip


def capture(seed, n, order="<", link=1, snaplen=900):
    rng = random.Random(seed)
    random.seed(seed)
    out, frames = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snaplen, link), []
    for i in range(n):
        whole = frame(rng, order)[14 if link != 1 else 0 :]
        kept = whole[:snaplen] if rng.random() < 0.9 else whole[: rng.randrange(40)]
        out += struct.pack(order + "IIII", T0 + i, rng.randrange(10**6), len(kept), len(whole)) + kept
        frames.append(kept)
    return out, frames


def told(rows):
    return sorted((r["capture_id"], r["frame_number"], r["src_ip"], r["dst_ip"], r["ip_proto"], r["protocol"], r["src_port"], r["dst_port"], r["tcp_seq"], r["tcp_ack"],
                   r["tcp_flags"], r["tcp_window"], r["udp_length"], r["icmp_type"], r["icmp_code"], bytes(r["payload"] or b""), r["vlan_id"]) for r in rows)


def slow(name, frames, link):
    out = []
    for i, f in enumerate(frames, 1):
        row = captures._packet(f, link)
        if row is not None:
            every = dict.fromkeys("src_port dst_port tcp_seq tcp_ack tcp_flags tcp_window udp_length icmp_type icmp_code payload vlan_id".split())
            out.append(every | row | {"capture_id": name, "frame_number": i})
    return told(out)


@pytest.mark.parametrize("split_bytes", [1 << 26, 4000, 700])
def test_ranges_give_what_the_whole_file_gives(spark, tmp_path, split_bytes):
    want = []
    for name, seed, order, link in (("a.pcap", 1, "<", 1), ("b.pcap", 2, ">", 101), ("c.pcap", 3, "<", 12)):
        content, frames = capture(seed, 150, order, link)
        (tmp_path / name).write_bytes(content + b"cut" * seed)
        want += slow(name, frames, link)
    (tmp_path / "none.pcap").write_bytes(b"no capture" * 500)
    (tmp_path / "empty.pcap").write_bytes(b"")  # Spark lists no empty files
    found = captures.ranges(spark, str(tmp_path), split_bytes=split_bytes)
    got = captures.read_captures(spark, str(tmp_path), split_bytes=split_bytes)
    rows = got.collect()
    assert told(rows) == sorted(want)
    assert all(r["ts"].replace(tzinfo=None) >= datetime.datetime(2024, 1, 1) for r in rows)
    status = {r["capture_id"]: r for r in captures.read_status(spark, str(tmp_path), split_bytes=split_bytes).collect()}
    assert {n: s["frames"] for n, s in status.items()} == {"a.pcap": 150, "b.pcap": 150, "c.pcap": 150, "none.pcap": 0}
    assert sum(s["packets"] for s in status.values()) == len(rows) and status["none.pcap"]["reason"] == "no capture"
    if split_bytes == 4000:
        assert found.where("name = 'a.pcap'").count() > 5 and got.rdd.getNumPartitions() > 10


def test_ranges_that_do_not_meet_are_found_from_the_start(spark, tmp_path):
    content, _ = capture(5, 120)
    long = struct.pack("<IIII", T0, 1, 10_000, 10_000) + bytes(10_000)  # a record over the file's own limit
    fake = bytes(12) + b"\x08\x06" + b"".join(struct.pack("<IIII", T0, 1, 20, 20) + bytes(20) for _ in range(20))
    crafted = struct.pack("<IIII", T0, 1, len(fake), len(fake)) + fake  # its end leads to the next record
    (tmp_path / "x.pcap").write_bytes(content + long + content[24:])
    (tmp_path / "y.pcap").write_bytes(content + crafted * 30 + content[24:])
    want = told(captures.read_captures(spark, str(tmp_path)).collect())
    assert len({n for n, *_ in want}) == 2
    for split_bytes in (4000, 500):
        assert told(captures.read_captures(spark, str(tmp_path), split_bytes=split_bytes).collect()) == want
