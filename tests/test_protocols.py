"""Exact numbers for small packet sequences."""

import pytest

from netlens.functions.net import CONVERSATION
from netlens.operators import dns, flows, http, tcp, traffic, udp
from tests.conftest import one

C = {"src_ip": "192.168.1.10", "dst_ip": "10.0.0.5", "src_port": 40000, "dst_port": 80}
S = {"src_ip": "10.0.0.5", "dst_ip": "192.168.1.10", "src_port": 80, "dst_port": 40000}


def handshake():
    return (
        C | {"packet_size": 74, "tcp_flags": 2, "tcp_seq": 1, "tcp_window": 65535},
        S | {"at": 0.1, "packet_size": 60, "tcp_flags": 18, "tcp_seq": 9, "tcp_window": 65535},
        C | {"at": 0.2, "packet_size": 54, "tcp_flags": 16, "tcp_seq": 2, "tcp_window": 65535},
    )


@pytest.mark.parametrize("grain", [CONVERSATION, tcp.CAPTURE])
def test_tcp_handshake(packets, grain):
    r = one(tcp.analysis(packets(*handshake()), grain))
    assert r["state"] == "established"
    assert r["handshake_us"] == 100_000
    assert (r["packets"], r["bytes"]) == (3, 188)
    assert (r["client_packets"], r["client_bytes"]) == (2, 128)
    assert (r["server_packets"], r["server_bytes"]) == (1, 60)
    assert r["avg_rtt"] == pytest.approx(0.1)


def test_tcp_stream_and_flow(packets):
    p = packets(*handshake())
    s = one(flows.tcp_streams(p))
    assert (s["bytes"], s["handshake_complete"], s["low_port_ip"], s["low_port"]) == (188, True, "10.0.0.5", 80)
    f = one(flows.conversation_flows(p))
    assert (f["client_ip"], f["client_port"], f["client_packets"], f["server_bytes"]) == ("192.168.1.10", 40000, 2, 60)


def test_handshake_needs_order_and_first_ten(packets):
    syn, sa, ack = handshake()
    assert not one(flows.handshakes(packets(ack, syn, sa)))["handshake_complete"]
    assert not one(flows.handshakes(packets(syn, sa)))["handshake_complete"]
    late = [syn] + [C | {"tcp_flags": 8}] * 9 + [sa, ack]
    assert not one(flows.handshakes(packets(*late)))["handshake_complete"]


def test_retransmission_and_order(packets):
    twice = packets(C | {"tcp_seq": 1000, "tcp_flags": 24}, C | {"tcp_seq": 1000, "tcp_flags": 24})
    assert one(tcp.retransmissions(twice))["retransmissions"] == 1
    mixed = packets(*[C | {"tcp_seq": s, "tcp_flags": 24} for s in (1000, 1200, 1100)])
    assert one(tcp.out_of_order(mixed))["out_of_order_packets"] == 1
    assert one(tcp.analysis(mixed))["out_of_order_packets"] == 1


def test_windows(packets):
    r = one(tcp.analysis(packets(*[C | {"tcp_window": w, "tcp_flags": 16} for w in (32768, 65535, 0, 200000)])))
    assert (r["initial_window"], r["min_window"], r["max_window"]) == (32768, 32768, 200000)
    assert (r["zero_window_packets"], r["window_scaling"], r["congested"]) == (1, 4, True)


def test_udp_flow(packets):
    u = {"protocol": "UDP", "ip_proto": 17, "src_port": 53, "dst_port": 53}
    p = packets(
        u | {"packet_size": 64, "udp_length": 32},
        u | {"at": 0.05, "src_ip": "10.0.0.2", "dst_ip": "10.0.0.1", "packet_size": 128, "udp_length": 96},
    )
    r = one(udp.flow_statistics(p))
    assert (r["bytes"], r["requests"], r["responses"]) == (192, 2, 0)
    assert (r["avg_packet_size"], r["avg_payload_size"], r["loss_rate"]) == (96.0, 64.0, 1.0)
    assert one(udp.response_gaps(p))["avg_response_time"] == pytest.approx(0.05)


def test_udp_bursts(packets):
    u = {"protocol": "UDP", "ip_proto": 17, "src_port": 5000, "dst_port": 6000, "packet_size": 1500}
    p = packets(u, u | {"at": 0.001})
    assert one(udp.flow_statistics(p))["potential_fragmentation"]
    assert one(udp.flow_statistics(p))["unidirectional"] == 2
    assert one(udp.bursts(p))["burst_detected"]
    assert not one(udp.bursts(packets(u, u | {"at": 0.2})))["burst_detected"]


@pytest.mark.parametrize("block", [1 << 8, 10])
def test_near_duplicates_match_brute_force(packets, block):
    import random

    rng = random.Random(7)
    rows = [
        {
            "protocol": "UDP",
            "src_ip": f"10.0.0.{rng.randint(1, 2)}",
            "packet_size": rng.choice([60, 61]),
            "at": i * 0.002 + rng.random() * 0.01,
        }
        for i in range(120)
    ]
    want = 0
    for i, a in enumerate(rows):
        for b in rows[i + 1 : i + 10]:
            same = a["src_ip"] == b["src_ip"] and a["packet_size"] == b["packet_size"]
            if same and abs(round(a["at"] * 1e6) - round(b["at"] * 1e6)) < 10_000:
                want += 1
                break
    assert one(udp.near_duplicates(packets(*rows), block=block))["duplicates"] == want


def test_http_pairing(packets):
    get, ok = C | {"packet_size": 200, "http_method": "GET", "http_uri": "/", "http_host": "a"}, S | {
        "at": 0.5, "packet_size": 1500, "http_status": 200}
    r = one(http.transactions(packets(get, ok)))
    assert (r["response_us"], r["status"]) == (500_000, 200)
    assert one(http.summary(packets(get, ok)))["total_bytes"] == 1700
    # A newer request replaces the older one; a second response finds none.
    p = packets(get | {"http_uri": "/old"}, get | {"http_uri": "/new"}, ok, ok)
    assert one(http.transactions(p))["uri"] == "/new"
    assert one(http.summary(packets(get, ok | {"http_status": 404})))["error_rate"] == 1.0
    assert http.transactions(packets(ok, get)).count() == 0


def test_dns(packets):
    q = {"protocol": "UDP", "src_port": 5353, "dst_port": 53, "dns_query": "a.example", "dns_type": "A", "dns_id": 1, "dns_qr": 0}
    a = {"protocol": "UDP", "src_ip": "10.0.0.2", "dst_ip": "10.0.0.1", "src_port": 53, "dst_port": 5353,
         "dns_response": "1.2.3.4", "dns_id": 1, "dns_qr": 1, "dns_rcode": 0, "at": 0.05}
    r = one(dns.transactions(packets(q, a)))
    assert (r["outcome"], r["response_us"]) == ("NOERROR", 50_000)
    s = one(dns.summary(packets(q)))
    assert (s["timeouts"], s["success_rate"]) == (1, 0.0)
    types = {r["query_type"]: r["queries"] for r in dns.type_counts(packets(q, q | {"dns_type": "AAAA"}, q | {"dns_type": "MX"})).collect()}
    assert types == {"A": 1, "AAAA": 1, "MX": 1}
    # By id: strictly later, reusable, failed when the code is not 0.
    same_instant = packets(q | {"at": 0.05}, a)
    assert one(dns.matched_by_id(same_instant))["response_us"] is None
    twice = dns.matched_by_id(packets(q, q | {"at": 0.01}, a | {"dns_rcode": 3})).collect()
    assert sorted(x["response_us"] for x in twice) == [40_000, 50_000] and all(x["failed"] for x in twice)
    assert one(dns.performance(packets(q, a)))["failure_rate"] == 0.0


def test_detected_protocols(packets):
    p = packets(*[C | {"dst_port": d} for d in (80, 443, 53, 67)])
    found = {r["protocol"] for r in traffic.detected_protocols(p).collect()}
    assert {"tcp", "http", "https", "dns", "dhcp"} <= found


def test_empty_input(packets, spark):
    none = packets(C).where("false")
    for df in (tcp.analysis(none), flows.conversation_flows(none), http.response_times(none), dns.summary(none)):
        assert df.count() == 0
