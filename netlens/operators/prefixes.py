"""Addresses against a table of blocks of any size: longest-prefix match as an equi-join."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions import net


def networks(ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """(network, cidr) of every distinct block of the table; ``network`` is what ``net.masked``
    gives for its addresses.

    Host bits are allowed, a text without a length is one address, and a text that is no block
    matches nothing and is left out. Of texts that mean one block the least stands for all."""
    text = F.col(cidr)
    parts = F.split(text, "/")
    key = net.ip_key(F.get(parts, 0))
    width = F.when(key["family"] == 4, 32).otherwise(128)
    given = F.when(F.get(parts, 1).rlike(r"^\d{1,3}$"), F.get(parts, 1).cast("int"))
    length = F.when(F.size(parts) == 1, width).when(F.size(parts) == 2, given)
    blocks = ranges.select(text.alias("cidr"), key.alias("key"), length.alias("length"), width.alias("width"))
    # grouped by its parts first, a key is worked out once and not once for each bit mask
    blocks = blocks.groupBy("key", "length", "width").agg(F.min("cidr").alias("cidr")).where("key IS NOT NULL AND length <= width")
    return blocks.groupBy(net.masked(F.col("key"), F.col("length")).alias("network")).agg(F.min("cidr").alias("cidr"))


def matches(addresses: DataFrame, ranges: DataFrame, ip: str = "ip", cidr: str = "cidr") -> DataFrame:
    """(ip, cidr, prefix_length) of every distinct address that lies in a block: the longest one.

    An address is looked up once for each length that the table has (at most 33 and 129, which
    is all that the driver learns of it), so the join is by equal keys and no block is
    compared with addresses outside it."""
    blocks = networks(ranges, cidr)
    lengths = blocks.groupBy("network.family").agg(F.array_sort(F.collect_set("network.length"))).collect()
    # a table without blocks gives no lookups
    of_family = F.coalesce(*[F.when(F.col("key.family") == f, F.lit(of)) for f, of in lengths], F.array().cast("array<int>"))
    seen = addresses.select(F.col(ip).alias("ip")).distinct().select("ip", net.ip_key("ip").alias("key")).where("key IS NOT NULL")
    tried = seen.select("ip", "key", F.explode(of_family).alias("prefix_length"))
    tried = tried.select("ip", "prefix_length", net.masked(F.col("key"), F.col("prefix_length")).alias("network"))
    return tried.join(blocks, "network").groupBy("ip").agg(F.max_by("cidr", "prefix_length").alias("cidr"), F.max("prefix_length").alias("prefix_length"))


def longest(df: DataFrame, ranges: DataFrame, ip: str = "src_ip", cidr: str = "cidr", to: str = "cidr") -> DataFrame:
    """All rows with the longest block that holds the address in column ``ip`` (else NULL)."""
    found = matches(df, ranges, ip, cidr).select(F.col("ip").alias(ip), F.col("cidr").alias(to))
    return df.join(found, ip, "left").select(*df.columns, to)


def inside(packets: DataFrame, ranges: DataFrame, side: str = "any", cidr: str = "cidr") -> DataFrame:
    """Packets with an address in any of the blocks, on the given side: ``src``, ``dst`` or
    ``any`` (there both sides have to be addresses, as for ``filters.by_ip_range``)."""
    if side in ("src", "dst"):
        column = f"{side}_ip"
        return packets.join(matches(packets, ranges, column, cidr).select(F.col("ip").alias(column)), column, "left_semi").select(packets.columns)
    ends = packets.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    found = matches(ends, ranges, "ip", cidr)
    src, dst = (found.select(F.col("ip").alias(f"_{s}"), F.lit(True).alias(f"_{s}_in")) for s in ("src", "dst"))

    def is_address(c: str):
        return net.ip_num(c).isNotNull() | F.col(c).contains(":")

    both = packets.where(is_address("src_ip") & is_address("dst_ip"))
    both = both.join(src, F.col("src_ip") == F.col("_src"), "left").join(dst, F.col("dst_ip") == F.col("_dst"), "left")
    return both.where("_src_in OR _dst_in").select(packets.columns)
