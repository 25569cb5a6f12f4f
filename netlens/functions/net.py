"""Address, endpoint and TCP-flag expressions."""

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# TCP flag bits in display order.
TCP_FLAGS = {
    "FIN": 0x01,
    "SYN": 0x02,
    "RST": 0x04,
    "PSH": 0x08,
    "ACK": 0x10,
    "URG": 0x20,
    "ECE": 0x40,
    "CWR": 0x80,
}

# IP protocol numbers with a name of their own.
IP_PROTOCOLS = {
    1: "ICMP",
    2: "IGMP",
    6: "TCP",
    17: "UDP",
    41: "IPv6",
    47: "GRE",
    50: "ESP",
    51: "AH",
}

# IPv4 ranges that are not publicly routable (IANA special-purpose registry).
PRIVATE_RANGES = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
)
# Addresses inside those ranges that are routable all the same.
PRIVATE_EXCEPTIONS = ("192.0.0.9/32", "192.0.0.10/32")

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def us(ts: Column | str) -> Column:
    """Epoch microseconds."""
    return F.unix_micros(_col(ts))


def ip_num(ip: Column | str) -> Column:
    """IPv4 text as an unsigned number in a BIGINT; NULL when the text is not IPv4."""
    ip = _col(ip)
    octets = [F.get(F.split(ip, r"\."), i).try_cast("long") for i in range(4)]
    value = reduce(lambda acc, o: acc * 256 + o, octets)
    valid = ip.rlike(_IPV4) & reduce(lambda a, b: a & b, [o <= 255 for o in octets])
    return F.when(valid, value)


def _in_network(number: Column, net: ipaddress.IPv4Network) -> Column:
    first, last = int(net.network_address), int(net.broadcast_address)
    return number.between(F.lit(first).cast("long"), F.lit(last).cast("long"))


def in_cidr(ip: Column | str, cidr: str) -> Column:
    """Is the address inside the block (host bits allowed)? A bad block or address is false."""
    try:
        net = ipaddress.ip_network(cidr, strict=False)
    except ValueError:
        return F.lit(False)
    if net.version == 6:
        return F.coalesce(_ipv6_in(_col(ip), net), F.lit(False))
    return F.coalesce(_ipv4_in(_col(ip), net), F.lit(False))


def _ipv4_in(ip: Column, net: ipaddress.IPv4Network) -> Column:
    """Whether the text is an address of the block, told by the text alone: the octets that the
    block fixes, then those values that the octet at its border may have, then any octets."""
    first, last = net.network_address.packed, net.broadcast_address.packed
    fixed = "".join(f"{octet}." for octet in first[: net.prefixlen // 8])[: None if net.prefixlen < 32 else -1]
    octets = [
        str(lo) if lo == hi else _OCTET if hi - lo == 255 else "(" + "|".join(map(str, range(lo, hi + 1))) + ")"
        for lo, hi in zip(first, last, strict=True)
    ]
    return ip.startswith(fixed) & ip.rlike("^" + r"\.".join(octets) + "$")


def _ipv6_hex(ip: Column) -> Column:
    """IPv6 text (without an embedded IPv4 tail) as 32 hex digits, else NULL."""
    halves = F.split(F.lower(ip), "::")
    groups = [F.filter(F.split(F.get(halves, i), ":"), lambda g: g != "") for i in (0, 1)]
    pad = [F.transform(g, lambda x: F.lpad(x, 4, "0")) for g in groups]
    tail = F.coalesce(pad[1], F.array().cast("array<string>"))
    fill = F.array_repeat(F.lit("0000"), (8 - F.size(pad[0]) - F.size(tail)).cast("int"))
    whole = F.concat_ws("", pad[0], fill, tail)
    well_formed = ip.rlike(r"^[0-9a-fA-F:]+$") & ip.contains(":") & (F.size(halves) <= 2)
    return F.when(well_formed & (F.length(whole) == 32), whole)


def ip_key(ip: Column | str) -> Column:
    """IPv4 or IPv6 text as ``(family, hi, lo)``: 4 or 6 and the bits from the top of two BIGINTs.
    NULL when the text is neither."""
    ip = _col(ip)
    number, digits = ip_num(ip), _ipv6_hex(ip)
    half = [F.conv(F.substring(digits, at, 16), 16, -10).cast("long") for at in (1, 17)]
    four = F.struct(F.lit(4).alias("family"), F.shiftleft(number, 32).alias("hi"), F.lit(0).cast("long").alias("lo"))
    six = F.struct(F.lit(6).alias("family"), half[0].alias("hi"), half[1].alias("lo"))
    return F.when(number.isNotNull(), four).when(digits.isNotNull(), six)


def masked(key: Column, length: Column) -> Column:
    """The key of an address with all bits behind the first ``length`` cleared, and the length."""

    def top(bits: Column) -> Column:
        kept = F.call_function("shiftleft", F.lit(-1).cast("long"), F.lit(64) - bits)
        return F.when(bits >= 64, F.lit(-1).cast("long")).when(bits <= 0, F.lit(0).cast("long")).otherwise(kept)

    return F.struct(
        key["family"].alias("family"),
        length.alias("length"),
        key["hi"].bitwiseAND(top(length)).alias("hi"),
        key["lo"].bitwiseAND(top(length - 64)).alias("lo"),
    )


def _ipv6_in(ip: Column, net: ipaddress.IPv6Network) -> Column:
    first = f"{int(net.network_address):032x}"
    last = f"{int(net.broadcast_address):032x}"
    return _ipv6_hex(ip).between(first, last)


def either_in_cidr(cidr: str, src: str = "src_ip", dst: str = "dst_ip") -> Column:
    """Either side inside the block, on rows where both sides are addresses.

    The block test comes first: most rows fail it and are done.
    """

    def is_address(c: str) -> Column:
        return ip_num(c).isNotNull() | _col(c).contains(":")

    return (in_cidr(src, cidr) & is_address(dst)) | (in_cidr(dst, cidr) & is_address(src))


def ip_class(ip: Column | str) -> Column:
    """multicast, broadcast, internal, external or unknown; the first that applies."""
    ip = _col(ip)
    n = ip_num(ip)
    v6 = _ipv6_hex(ip)
    private = reduce(
        lambda a, b: a | b, [_in_network(n, ipaddress.ip_network(c)) for c in PRIVATE_RANGES]
    ) & ~reduce(
        lambda a, b: a | b, [_in_network(n, ipaddress.ip_network(c)) for c in PRIVATE_EXCEPTIONS]
    )
    v6_private = v6.rlike("^f[cd]") | v6.rlike("^fe[89ab]") | v6.rlike("^0{31}[01]$")
    return (
        F.when(_in_network(n, ipaddress.ip_network("224.0.0.0/4")), F.lit("multicast"))
        .when(n.isNotNull() & ip.endswith(".255"), F.lit("broadcast"))
        .when(n.isNotNull(), F.when(private, F.lit("internal")).otherwise("external"))
        .when(v6.startswith("ff"), F.lit("multicast"))
        .when(v6_private, F.lit("internal"))
        .when(v6.isNotNull(), F.lit("external"))
        .otherwise("unknown")
    )


def protocol_name(number: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in IP_PROTOCOLS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, _col(number).cast("int")), F.lit("OTHER"))


def has_flags(mask: int, flags: Column | str = "tcp_flags") -> Column:
    """All bits of the mask are set (false on rows without flags)."""
    return F.coalesce(_col(flags).bitwiseAND(F.lit(mask)) == mask, F.lit(False))


def bare_syn(flags: Column | str = "tcp_flags") -> Column:
    return F.coalesce(_col(flags).bitwiseAND(F.lit(0x12)) == 0x02, F.lit(False))


def syn_ack(flags: Column | str = "tcp_flags") -> Column:
    return has_flags(0x12, flags)


def ack_without_syn(flags: Column | str = "tcp_flags") -> Column:
    return F.coalesce(_col(flags).bitwiseAND(F.lit(0x12)) == 0x10, F.lit(False))


def flags_from_text(text: Column | str) -> Column:
    """Hex (``0x…``) or decimal flag text as a bitmask; NULL if it is neither."""
    text = _col(text)
    return (
        F.when(text.rlike("^0x[0-9a-fA-F]+$"), F.conv(F.substring(text, 3, 64), 16, 10))
        .when(text.rlike(r"^\d+$"), text)
        .try_cast("int")
    )


def flag_names(mask: Column | str) -> Column:
    """Comma-joined flag names of a bitmask."""
    mask = _col(mask)
    return F.concat_ws(
        ",",
        *[F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in TCP_FLAGS.items()],
    )


def flag_text(text: Column | str) -> Column:
    """Flag text rewritten as names; text that is no number is kept."""
    return F.coalesce(flag_names_or_null(flags_from_text(text)), _col(text))


def flag_names_or_null(mask: Column) -> Column:
    return F.when(mask.isNotNull(), flag_names(mask))


def has_ports(src: str = "src_port", dst: str = "dst_port") -> Column:
    return (F.coalesce(_col(src), F.lit(0)) != 0) & (F.coalesce(_col(dst), F.lit(0)) != 0)


def with_endpoints(df):
    """Add the unordered endpoint pair: ``lo_ip, lo_port, hi_ip, hi_port``.

    Endpoints sort as (text, number). Ports are 0 on both sides unless both are present,
    so traffic without ports groups by its addresses alone.
    """
    ports = has_ports()

    def end(ip: str, port: str) -> Column:
        number = F.when(ports, F.coalesce(F.col(port), F.lit(0))).otherwise(0)
        return F.struct(F.col(ip).alias("ip"), number.alias("port"))

    src, dst = end("src_ip", "src_port"), end("dst_ip", "dst_port")
    return df.withColumns(
        {
            "lo_ip": F.least(src, dst)["ip"],
            "lo_port": F.least(src, dst)["port"],
            "hi_ip": F.greatest(src, dst)["ip"],
            "hi_port": F.greatest(src, dst)["port"],
        }
    )


CONVERSATION = ["capture_id", "lo_ip", "lo_port", "hi_ip", "hi_port"]
FLOW = ["capture_id", "src_ip", "src_port", "dst_ip", "dst_port"]


def _endpoint_text(ip: str, port: str, ports: Column) -> Column:
    return F.when(ports, F.concat_ws(":", ip, _col(port).cast("string"))).otherwise(_col(ip))


def flow_key() -> Column:
    """``src:port->dst:port``; addresses only when a port is 0 or absent."""
    ports = has_ports()
    return F.concat_ws(
        "->",
        _endpoint_text("src_ip", "src_port", ports),
        _endpoint_text("dst_ip", "dst_port", ports),
    )


def conversation_key() -> Column:
    """Text form of the unordered endpoint pair (needs ``with_endpoints``)."""
    ports = F.col("lo_port") != 0
    return F.concat_ws(
        "<->",
        _endpoint_text("lo_ip", "lo_port", ports),
        _endpoint_text("hi_ip", "hi_port", ports),
    )


def node_id(name: Column | str) -> Column:
    clean = F.regexp_replace(_col(name), "[^a-zA-Z0-9_]", "_")
    return (
        F.when(clean == "", F.lit("unknown_node"))
        .when(clean.rlike("^[0-9]"), F.concat(F.lit("node_"), clean))
        .otherwise(clean)
    )


def ips_in_text(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), F.lit(0))
