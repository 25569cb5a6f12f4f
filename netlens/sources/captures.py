"""Binary captures in a folder as packet rows.

Only fixed headers are read (link, IP, TCP, UDP, ICMP). Captures of plain records are read in byte
ranges, each a task of its own: a range finds its first record by a chain of headers that is longer
than any frame can be; a first pass counts the records of each range (which gives the frame numbers) and
checks that every range ends where the next one starts. Captures made of blocks
are read from their start, a file per task, without holding the file."""

import io
import ipaddress
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netlens.functions.net import IP_PROTOCOLS
from netlens.operators.stage import checkpointed
from netlens.schema import PACKETS

# First four bytes -> byte order and fractions per second.
CAPTURE_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
MAX_SNAPLEN = 1_048_576
# Link types; IPv6 extension headers; block types of the newer capture format.
ETHERNET, RAW_IP, LOOPBACK, LINUX_COOKED, LINUX_COOKED_2 = 1, (12, 101, 228, 229), (0, 108), 113, 276
IPV6_FRAGMENT, IPV6_EXTENSIONS = 44, (0, 43, 44, 60, 135)
NG_SECTION, NG_INTERFACE, NG_PACKET, NG_SIMPLE = 0x0A0D0D0A, 1, 6, 3
NG_ORDER = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
NG_RESOLUTION = 9
CHUNK = 50_000
#: Bytes of one range of a capture.
SPLIT_BYTES = 64 << 20
RECORD = 16
_ARROW_TYPES = {
    "string": pa.string(),
    "integer": pa.int32(),
    "long": pa.int64(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "timestamp": pa.timestamp("us", tz="UTC"),
}
_ARROW = pa.schema([(f.name, _ARROW_TYPES[f.dataType.typeName()]) for f in PACKETS.fields])


def header_fields(content: bytes) -> tuple[str, int, int] | None:
    """Byte order, fractions per second and link type of a valid global header, else None."""
    known = CAPTURE_MAGIC.get(content[:4])
    if known is None or len(content) < 24:
        return None
    major, minor, _, _, snaplen, link = struct.unpack(known[0] + "HHiIII", content[4:24])
    if (major, minor) != (2, 4) or not 0 < snaplen <= MAX_SNAPLEN:
        return None
    return known[0], known[1], link


def _after_extensions(proto: int, body: bytes) -> tuple[int, int, bytes]:
    """Protocol, fragment offset and body behind the extension headers of IPv6."""
    offset = 0
    while proto in IPV6_EXTENSIONS and len(body) >= 8:
        if proto == IPV6_FRAGMENT:
            offset, size = int.from_bytes(body[2:4], "big") >> 3, 8
        else:
            size = (body[1] + 1) * 8
        proto, body = body[0], body[size:]
        if offset:
            break
    return proto, offset, body


def _packet(frame: bytes, link: int) -> dict | None:
    if link == ETHERNET:
        kind, at = int.from_bytes(frame[12:14], "big"), 14
        vlan = None
        if kind == 0x8100:
            vlan = int.from_bytes(frame[14:16], "big") & 0x0FFF
            kind, at = int.from_bytes(frame[16:18], "big"), 18
        if kind not in (0x0800, 0x86DD):
            return None
    elif link in RAW_IP:
        at, vlan = 0, None
    elif link in LOOPBACK:
        at, vlan = 4, None
    elif link == LINUX_COOKED:
        at, vlan = 16, None
    elif link == LINUX_COOKED_2:
        at, vlan = 20, None
    else:
        return None
    ip = frame[at:]
    version = ip[0] >> 4 if ip else 0
    offset = 0
    if version == 4 and len(ip) >= 20:
        proto, src, dst, body = ip[9], ip[12:16], ip[16:20], ip[(ip[0] & 15) * 4 : int.from_bytes(ip[2:4], "big") or None]
        offset = int.from_bytes(ip[6:8], "big") & 0x1FFF
    elif version == 6 and len(ip) >= 40:
        size = int.from_bytes(ip[4:6], "big")
        proto, src, dst, body = ip[6], ip[8:24], ip[24:40], ip[40 : 40 + size if size else None]
        proto, offset, body = _after_extensions(proto, body)
    else:
        return None
    row = {
        "src_ip": str(ipaddress.ip_address(src)),
        "dst_ip": str(ipaddress.ip_address(dst)),
        "ip_proto": proto,
        "protocol": IP_PROTOCOLS.get(proto, "OTHER"),
        "vlan_id": vlan,
    }
    if offset:  # a later fragment has no transport header
        return row
    if proto == 6 and len(body) >= 20:
        row["src_port"], row["dst_port"], row["tcp_seq"], row["tcp_ack"] = struct.unpack("!HHII", body[:12])
        row["tcp_flags"], row["tcp_window"] = body[13], int.from_bytes(body[14:16], "big")
        row["payload"] = body[(body[12] >> 4) * 4 :] or None
    elif proto == 17 and len(body) >= 8:
        row["src_port"], row["dst_port"], row["udp_length"], _ = struct.unpack("!HHHH", body[:8])
        row["payload"] = body[8:] or None
    elif proto == 1 and len(body) >= 2:
        row["icmp_type"], row["icmp_code"] = body[0], body[1]
        row["payload"] = body[8:] or None
    return row


class _Header:
    """The global header of a capture of plain records."""

    def __init__(self, content: bytes):
        self.order, self.fractions, self.link = header_fields(content)
        self.snaplen = struct.unpack(self.order + "I", content[16:20])[0]
        self.record = struct.Struct(self.order + "IIII")

    def plausible(self, data: np.ndarray) -> np.ndarray:
        """Places in the bytes at which a record header may stand."""
        n = len(data) - RECORD + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        weights = (0, 8, 16, 24) if self.order == "<" else (24, 16, 8, 0)
        wide = data.astype(np.uint32)
        part, kept, size = (sum(wide[4 * k + i : 4 * k + i + n] << np.uint32(w) for i, w in enumerate(weights)) for k in (1, 2, 3))
        return np.flatnonzero((part < self.fractions) & (kept <= self.snaplen) & (kept <= size))

    def chained(self, data: bytes, at: int, to: int, whole: bool) -> bool:
        """Whether records follow each other from ``at`` up to ``to``, or to the end of the file if
        the bytes reach it (``whole``)."""
        while at < to:
            if at + RECORD > len(data):
                return whole
            _, part, kept, size = self.record.unpack_from(data, at)
            if part >= self.fractions or kept > self.snaplen or kept > size:
                return False
            at += RECORD + kept
        return True

    def first_record(self, file: pa.NativeFile, length: int, lo: int) -> int:
        """Where the first record at or after ``lo`` starts; the file's end if there is none."""
        if lo <= 24:
            return 24
        reach = self.snaplen + RECORD  # no record is longer
        data = file.read_at(min(3 * reach, length - lo), lo)
        whole = lo + len(data) >= length
        for at in self.plausible(np.frombuffer(data, np.uint8)[: reach + RECORD]).tolist():
            if self.chained(data, at, at + reach + 1, whole):
                return lo + at
        return length

    def records(self, data: bytes, stop: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Seconds, fraction, bytes kept, size on the wire and place of each record that starts
        before ``stop``."""
        at = 0
        while at < stop and at + RECORD <= len(data):
            seconds, part, kept, size = self.record.unpack_from(data, at)
            yield seconds, part, kept, size, at + RECORD
            at += RECORD + kept


def _unit(order: str, options: bytes) -> int:
    """Time units per second among the options of an interface (a million if not told)."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "HH", options[at : at + 4])
        if code == NG_RESOLUTION and size:
            exponent = options[at + 4]
            return 1 << (exponent & 0x7F) if exponent & 0x80 else 10**exponent
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def _blocks(file) -> Iterator[tuple[int, int, int, bytes]]:
    """Link type, time in microseconds, size on the wire and bytes of every frame of a capture made
    of blocks; a simple packet has no time and is taken as 0."""
    order, links = "<", []
    while len(head := file.read(12)) == 12:
        if head[:4] == NG_SECTION.to_bytes(4, "little"):
            order, links = NG_ORDER.get(head[8:12], order), []
        kind, size = struct.unpack(order + "II", head[:8])
        if size < 12:
            return
        body = head[8:12] + file.read(size - 12)
        body = body[: max(0, size - 12)]
        if kind == NG_INTERFACE and len(body) >= 8:
            links.append((struct.unpack(order + "H", body[:2])[0], _unit(order, body[8:])))
        elif kind == NG_PACKET and len(body) >= 20:
            source, high, low, kept, wire = struct.unpack(order + "IIIII", body[:20])
            if source < len(links):
                link, unit = links[source]
                yield link, ((high << 32) | low) * 1_000_000 // unit, wire, body[20 : 20 + kept]
        elif kind == NG_SIMPLE and len(body) >= 4 and links:
            wire = struct.unpack(order + "I", body[:4])[0]
            yield links[0][0], 0, wire, body[4 : 4 + wire]


def _format(head: bytes) -> str:
    """``records``, ``blocks`` or ``none``."""
    if header_fields(head) is not None:
        return "records"
    return "blocks" if head[:4] == NG_SECTION.to_bytes(4, "little") and head[8:12] in NG_ORDER else "none"


def _open(path: str) -> pa.NativeFile:
    """A file that Spark has listed, for reading at any place."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, place = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(place)


def _dotted(addresses: np.ndarray) -> pa.Array:
    """Texts of IPv4 addresses given as numbers."""
    distinct, of = np.unique(addresses, return_inverse=True)
    texts = pa.array([f"{a >> 24}.{a >> 16 & 255}.{a >> 8 & 255}.{a & 255}" for a in distinct.tolist()], pa.string())
    return texts.take(pa.array(of))


def _plain(data: np.ndarray, at: np.ndarray, kept: np.ndarray, link: int) -> tuple[np.ndarray, np.ndarray]:
    """Frames that are whole IPv4 packets without options or fragments, with a whole TCP, UDP or
    ICMP header, on Ethernet or raw IP: which ones, and where their IP header starts."""
    if link not in (ETHERNET, *RAW_IP):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = 14 if link == ETHERNET else 0
    good = np.flatnonzero(kept >= lead + 28)
    ip = at[good] + lead
    fits = data[ip] == 0x45
    if lead:
        fits &= (data[ip - 2] == 8) & (data[ip - 1] == 0)
    fits &= ((data[ip + 6] & 0x1F) == 0) & (data[ip + 7] == 0)
    proto = data[ip + 9]
    total = data[ip + 2].astype(np.int64) << 8 | data[ip + 3]
    body = np.minimum(np.where(total == 0, kept[good] - lead, total), kept[good] - lead) - 20
    fits &= ((proto == 6) & (body >= 20)) | ((proto == 17) & (body >= 8)) | ((proto == 1) & (body >= 8))
    return good[fits], ip[fits]


def _columns(content: bytes, at: np.ndarray, kept: np.ndarray, link: int) -> tuple[pa.RecordBatch | None, np.ndarray]:
    """The plain frames as columns, taken out of the bytes all at once, and which frames they are."""
    data = np.frombuffer(content, np.uint8)
    rows, ip = _plain(data, at, kept, link)
    if not len(rows):
        return None, rows
    number = lambda place, size: sum(data[place + i].astype(np.int64) << 8 * (size - 1 - i) for i in range(size))
    proto, t = data[ip + 9], ip + 20
    tcp, udp, icmp = proto == 6, proto == 17, proto == 1
    total = number(ip + 2, 2)
    left = kept[rows] - (ip - at[rows])
    end = ip + np.where(total == 0, left, np.minimum(total, left))
    safe = np.where(tcp, t, ip)  # places whose TCP fields can be read whatever the frame is
    head = np.where(tcp, (data[safe + 12] >> 4).astype(np.int64) * 4, 8)
    payload = [content[a:b] or None for a, b in zip(np.minimum(t + head, end).tolist(), end.tolist(), strict=True)]
    ported, ints = tcp | udp, lambda values, where: pa.array(values, pa.int32(), mask=~where)
    made = {
        "src_ip": _dotted(number(ip + 12, 4)), "dst_ip": _dotted(number(ip + 16, 4)), "ip_proto": pa.array(proto, pa.int32()),
        "protocol": pa.array(np.array([IP_PROTOCOLS.get(p, "OTHER") for p in range(256)], object)[proto], pa.string()),
        "src_port": ints(number(t, 2), ported), "dst_port": ints(number(t + 2, 2), ported),
        "tcp_seq": pa.array(number(t + 4, 4), pa.int64(), mask=~tcp), "tcp_ack": pa.array(number(np.where(tcp, t + 8, ip), 4), pa.int64(), mask=~tcp),
        "tcp_flags": ints(data[safe + 13], tcp), "tcp_window": ints(number(safe + 14, 2), tcp), "udp_length": ints(number(t + 4, 2), udp),
        "icmp_type": ints(data[t], icmp), "icmp_code": ints(data[t + 1], icmp), "payload": pa.array(payload, pa.binary()),
    }
    arrays = [made.get(f.name, pa.nulls(len(rows), f.type)) for f in _ARROW]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, _ARROW, strict=True)], schema=_ARROW), rows


def _set(batch: pa.RecordBatch, **values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values.get(f.name, batch.column(i)).cast(f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def _read_records(name: str, header: _Header, data: bytes, first: int) -> Iterator[tuple[pa.RecordBatch | None, list[int]]]:
    """Packets of the records that the bytes hold, the first of them number ``first``, in batches,
    with the link type of each frame that is none."""
    found = np.array(list(header.records(data, len(data))), np.int64).reshape(-1, 5)
    for lo in range(0, len(found), CHUNK):
        seconds, part, kept, size, at = found[lo : lo + CHUNK].T
        kept = np.minimum(kept, len(data) - at)
        numbers = first + lo + np.arange(len(at))
        micros = seconds * 1_000_000 + part * 1_000_000 // header.fractions
        batch, rows = _columns(data, at, kept, header.link)
        if batch is not None:
            yield _set(batch, capture_id=pa.array([name] * len(rows)), frame_number=pa.array(numbers[rows]), ts=pa.array(micros[rows]).cast(pa.timestamp("us", "UTC")), packet_size=pa.array(size[rows])), []
        rest = np.setdiff1d(np.arange(len(at)), rows)
        others, none = [], []
        for i in rest.tolist():
            row = _packet(data[at[i] : at[i] + kept[i]], header.link)
            if row is None:
                none.append(header.link)
            else:
                others.append({**row, "capture_id": name, "frame_number": int(numbers[i]), "ts": int(micros[i]), "packet_size": int(size[i])})
        if others or none:
            yield (_batch(others) if others else None), none


def _read_blocks(name: str, file: pa.NativeFile) -> Iterator[tuple[pa.RecordBatch | None, list[int]]]:
    rows, none = [], []
    for number, (link, micros, size, frame) in enumerate(_blocks(io.BufferedReader(file, 1 << 20)), 1):
        row = _packet(frame, link)
        if row is None:
            none.append(link)
        else:
            rows.append({**row, "capture_id": name, "frame_number": number, "ts": micros, "packet_size": size})
        if len(rows) + len(none) >= CHUNK:
            yield (_batch(rows) if rows else None), none
            rows, none = [], []
    if rows or none:
        yield (_batch(rows) if rows else None), none


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(name, path, length) of the files: the name is the path relative to the folder, which no two
    files share. Contents are not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
    inside = F.substring_index("path", f"{root}/", -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(inside.alias("name"), "path", "length")


RANGES = "name string, path string, length bigint, format string, lo bigint, start bigint, stop bigint, frames bigint"


def _ranges_of(r: dict, split_bytes: int, from_start: bool) -> Iterator[dict]:
    """The range of a file that begins at ``lo``; with ``from_start`` all of its ranges, each from
    where the one before it ended."""
    with _open(r["path"]) as file:
        length = r["length"]
        head = file.read_at(min(24, length), 0)
        r |= {"format": _format(head), "start": 0, "stop": length, "frames": 0}
        if r["format"] != "records":
            if not r["lo"]:  # only captures of records are split
                yield r
            return
        header = _Header(head)
        stop = 24 if from_start else header.first_record(file, length, r["lo"])
        for lo in range(0, length, split_bytes) if from_start else [r["lo"]]:
            start, frames, hi = stop, 0, min(lo + split_bytes, length)
            if start < hi:
                data = file.read_at(min(hi + RECORD, length) - start, start)
                for _, _, kept, _, at in header.records(data, hi - start):
                    frames += 1
                    stop = start + at + kept
            yield r | {"lo": lo, "start": start, "stop": min(stop, length), "frames": frames}


def ranges(spark: SparkSession, folder: str, pattern: str = "*.{pcap,cap,pcapng}", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per byte range of every file (``RANGES``, and ``first``, the number of its first
    frame): where its first record starts, where the last one ends, and how many there are. Only
    record headers are looked at. Where a range does not end where the next one starts (a record
    longer than the file allows, or bytes made to look like records at the end of a frame), the
    ranges of that file are found anew from its start, by one task."""
    files = _files(spark, folder, pattern)
    cut = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / F.lit(split_bytes)))).cast("array<bigint>")
    parts = files.withColumn("part", F.explode(cut)).select("name", "path", "length", (F.col("part") * split_bytes).alias("lo"))

    def found(rows: DataFrame, from_start: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [f.split()[0] for f in RANGES.split(", ")]
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in RANGES.split(", ")]
            for batch in batches:
                for r in batch.to_pylist():
                    made = list(_ranges_of(r, split_bytes, from_start))
                    yield pa.RecordBatch.from_pylist(made, schema=pa.schema(list(zip(names, kinds, strict=True))))

        return checkpointed(_spread(rows).mapInArrow(run, RANGES))

    order = Window.partitionBy("name").orderBy("lo")
    whole = found(parts, False)
    meets = whole.withColumn("next", F.lead("start").over(order)).where("format = 'records' AND next <> stop AND stop + 16 <= length")
    apart = checkpointed(meets.select("name").distinct())
    if not apart.isEmpty():
        again = found(parts.where("lo = 0").join(apart, "name", "left_semi"), True)
        whole = whole.join(apart, "name", "left_anti").select(*again.columns).unionByName(again)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    return whole.withColumn("first", F.coalesce(F.sum("frames").over(earlier), F.lit(0)) + 1)


def _spread(rows: DataFrame) -> DataFrame:
    """About one row per task."""
    return rows.repartition(max(1, min(rows.count(), 100_000)))


def _read(r: dict) -> Iterator[tuple[pa.RecordBatch | None, list[int]]]:
    with _open(r["path"]) as file:
        if r["format"] == "records":
            header = _Header(file.read_at(24, 0))
            yield from _read_records(r["name"], header, file.read_at(r["stop"] - r["start"], r["start"]), r["first"])
        elif r["format"] == "blocks":
            yield from _read_blocks(r["name"], file)


def read_captures(spark: SparkSession, folder: str, pattern: str = "*.{pcap,cap,pcapng}", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Packets of every capture in the folder; ``capture_id`` is the path below it. Files that
    are no captures and frames that hold no IP give no rows: ``read_status`` counts them. A task
    holds one range of ``split_bytes``, or one batch of a capture made of blocks."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from (made for made, _ in _read(r) if made is not None)

    found = ranges(spark, folder, pattern, split_bytes)
    return _spread(found.where((F.col("format") == "blocks") | (F.col("frames") > 0))).mapInArrow(parse, PACKETS)


STATUS = "capture_id string, frames long, packets long, skipped long, reason string"


def read_status(spark: SparkSession, folder: str, pattern: str = "*.{pcap,cap,pcapng}", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per file: frames, packets read, frames skipped and why."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                read, none = 0, []
                for made, links in _read(r):
                    read += made.num_rows if made is not None else 0
                    none += links
                yield pa.RecordBatch.from_pylist([{"name": r["name"], "format": r["format"], "read": read, "skipped": len(none), "links": sorted(set(none))}], schema=kinds)

    kinds = pa.schema([("name", pa.string()), ("format", pa.string()), ("read", pa.int64()), ("skipped", pa.int64()), ("links", pa.list_(pa.int64()))])
    part = _spread(ranges(spark, folder, pattern, split_bytes)).mapInArrow(count, "name string, format string, read long, skipped long, links array<long>")
    whole = part.groupBy("name", "format").agg(F.sum("read").alias("packets"), F.sum("skipped").alias("skipped"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("links")))).alias("links"))
    other = F.when(F.size("links") > 0, F.concat(F.lit("not IP, link types "), F.array_join(F.col("links").cast("array<string>"), ", ")))
    return whole.select(
        F.col("name").alias("capture_id"),
        (F.col("packets") + F.col("skipped")).alias("frames"),
        "packets",
        "skipped",
        F.when(F.col("format") == "none", "no capture").otherwise(other).alias("reason"),
    )
