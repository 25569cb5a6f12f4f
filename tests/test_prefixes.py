import ipaddress
import random

from netlens.operators import filters, prefixes


def random_blocks(rng, n):
    out = []
    for _ in range(n):
        if rng.random() < 0.6:
            out.append(f"10.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}/{rng.randrange(10, 33)}")
        else:
            out.append(f"2001:db8:{rng.randrange(3):x}::{rng.randrange(1 << 16):x}/{rng.choice([0, 16, 32, 47, 48, 63, 64, 65, 100, 112, 120, 127, 128])}")
    return out


def addresses(rng, n):
    four = [f"10.{rng.randrange(5)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(n)]
    six = [f"2001:db8:{rng.randrange(4):x}::{rng.randrange(1 << 16):x}" for _ in range(n)]
    return four + six + ["fe80::1", "ffff::", "0.0.0.0", "255.255.255.255", "10.0.0.256", "host", "", None]


def brute(ip, blocks):
    try:
        ip = ipaddress.ip_address(ip)
    except ValueError:
        return None
    hit = [(n.prefixlen, n.network_address, text) for text, n in blocks if n.version == ip.version and ip in n]
    return max(hit, key=lambda h: h[0])[:2] if hit else None


def test_longest_prefix_against_every_block(spark):
    rng = random.Random(3)
    texts = random_blocks(rng, 400) + ["10.1.2.3", "::1", "128.0.0.0/1"]
    bad = ["10.0.0.0/33", "10.0.0/8", "::/129", "x/8", "10.0.0.0/", "10.0.0.0/8/8", "", None]
    blocks = [(t, ipaddress.ip_network(t, strict=False)) for t in texts]
    seen = addresses(rng, 150) + ["10.1.2.3", "::1"]
    ranges = spark.createDataFrame([(t,) for t in texts + bad], "cidr string")
    rows = prefixes.longest(spark.createDataFrame([(i, a) for i, a in enumerate(seen * 2)], "i int, src_ip string"), ranges).collect()
    assert sorted(r["i"] for r in rows) == list(range(2 * len(seen)))
    for r in rows:
        got = r["cidr"] and ipaddress.ip_network(r["cidr"], strict=False)
        assert (got and (got.prefixlen, got.network_address)) == brute(r["src_ip"], blocks), r


def test_many_blocks_join_by_equal_keys(spark):
    ranges = spark.createDataFrame([(t,) for t in random_blocks(random.Random(5), 100_000)], "cidr string")
    seen = spark.createDataFrame([(a,) for a in addresses(random.Random(6), 300)], "ip string")
    found = prefixes.matches(seen, ranges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() > 100


def test_no_blocks_match_nothing(spark, packets):
    none = spark.createDataFrame([("nowhere/8",)], "cidr string")
    table = packets({}, {"src_ip": "host"})
    assert prefixes.matches(table, none, "src_ip").count() == 0 and prefixes.inside(table, none).count() == 0
    assert [r["cidr"] for r in prefixes.longest(table, none.limit(0)).collect()] == [None, None]


def test_inside_equals_the_filter_of_each_block(spark, packets):
    rng = random.Random(9)
    ends = [a for a in addresses(rng, 20) if a is not None]
    table = packets(*({"src_ip": rng.choice(ends), "dst_ip": rng.choice(ends)} for _ in range(300))).cache()
    texts = random_blocks(rng, 12)
    ranges = spark.createDataFrame([(t,) for t in texts], "cidr string")
    for side in ("any", "src", "dst"):
        want = set()
        for t in texts:
            want |= {r["frame_number"] for r in table.where(filters.by_ip_range(t, side)).select("frame_number").collect()}
        got = [r["frame_number"] for r in prefixes.inside(table, ranges, side).select("frame_number").collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    assert prefixes.inside(table, ranges).columns == table.columns
