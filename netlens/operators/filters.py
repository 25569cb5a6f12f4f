"""Packet predicates. Each returns a Column, so filters compose and push into the scan."""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions import net


def by_protocol(name: str) -> Column:
    return F.upper("protocol") == name.upper()


def by_port(port: int) -> Column:
    return F.coalesce((F.col("src_port") == port) | (F.col("dst_port") == port), F.lit(False))


def by_ip_range(cidr: str, side: str = "any") -> Column:
    """Address inside the block on the given side: ``src``, ``dst`` or ``any``."""
    if side == "src":
        return net.in_cidr("src_ip", cidr)
    if side == "dst":
        return net.in_cidr("dst_ip", cidr)
    return net.either_in_cidr(cidr)


def by_time(start, end, column: str = "ts") -> Column:
    """Closed time window."""
    return F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def in_handshake() -> Column:
    return (F.col("protocol") == "TCP") & net.has_flags(net.TCP_FLAGS["SYN"])


def in_teardown() -> Column:
    fin, rst = (net.has_flags(net.TCP_FLAGS[f]) for f in ("FIN", "RST"))
    return (F.col("protocol") == "TCP") & (fin | rst)


def source_filters(df: DataFrame, filters: Sequence[str]) -> DataFrame:
    """SQL filter texts joined by AND and applied at the scan."""
    for text in filters:
        df = df.where(F.expr(text))
    return df


@dataclass(frozen=True)
class PacketFilter:
    """Optional conditions, all of which have to hold; an unset one is true."""

    protocols: Sequence[str] | None = None
    src_ips: Sequence[str] | None = None
    dst_ips: Sequence[str] | None = None
    ip_ranges: Sequence[str] | None = None
    src_ports: Sequence[int] | None = None
    dst_ports: Sequence[int] | None = None
    port_ranges: Sequence[str] | None = None
    min_packet_size: int | None = None
    max_packet_size: int | None = None
    start_time: str | None = None
    end_time: str | None = None
    http_methods: Sequence[str] | None = None
    dns_query_types: Sequence[str] | None = None

    def predicate(self) -> Column:
        parts: list[Column] = []
        members = {
            "protocol": self.protocols,
            "src_ip": self.src_ips,
            "dst_ip": self.dst_ips,
            "src_port": self.src_ports,
            "dst_port": self.dst_ports,
            "http_method": self.http_methods,
            "dns_type": self.dns_query_types,
        }
        parts += [F.col(c).isin(*values) for c, values in members.items() if values]
        if self.ip_ranges:
            parts.append(reduce(lambda a, b: a | b, map(net.either_in_cidr, self.ip_ranges)))
        if self.port_ranges:
            spans = [tuple(int(x) for x in r.split("-")) for r in self.port_ranges]
            parts.append(
                reduce(
                    lambda a, b: a | b,
                    [F.col(c).between(a, b) for a, b in spans for c in ("src_port", "dst_port")],
                )
            )
        if self.min_packet_size:
            parts.append(F.col("packet_size") >= self.min_packet_size)
        if self.max_packet_size:
            parts.append(F.col("packet_size") <= self.max_packet_size)
        if self.start_time:
            parts.append(F.col("ts") >= F.lit(self.start_time).cast("timestamp"))
        if self.end_time:
            parts.append(F.col("ts") <= F.lit(self.end_time).cast("timestamp"))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, packets: DataFrame) -> DataFrame:
        return packets.where(self.predicate())
