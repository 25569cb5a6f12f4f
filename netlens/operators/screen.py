"""Screening of capture files: type, byte profile, signatures, severity, hashes.

Input is (path, content) as the binaryFile source gives it, one row per file.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.functions import text

# First four bytes (hex) of capture files.
CAPTURE_TYPES = {
    "D4C3B2A1": "pcap",
    "A1B2C3D4": "pcap",
    "4D3CB2A1": "pcap",
    "A1B23C4D": "pcap",
    "34CDB2A1": "pcap",
    "A1B2CD34": "pcap",
    "0A0D0D0A": "pcapng",
    "4D3C2B1A": "pcapng",
    "1A2B3C4D": "pcapng",
    "3412B2A1": "pcap",
    "A1B21234": "pcap",
}
# Leading bytes (hex) -> what the file looks like, first match wins.
LOOK_ALIKES = (
    ("504B0304", "ZIP archive"),
    ("1F8B08", "GZIP compressed file"),
    ("4D5A", "Windows executable (PE)"),
    ("7F454C46", "Linux executable (ELF)"),
    ("FFD8FF", "JPEG image"),
    ("89504E47", "PNG image"),
    ("25504446", "PDF document"),
    ("FFFE", "UTF-16 LE text file"),
    ("FEFF", "UTF-16 BE text file"),
    ("EFBBBF", "UTF-8 text file with BOM"),
)
EXTENSIONS = (".pcap", ".pcapng", ".cap")
MIN_SIZE, MAX_SIZE = 24, 2 * 1024**3
MAX_SNAPLEN = 1_048_576

# Byte-profile limits.
MAX_ENTROPY, MAX_NULLS, MAX_PRINTABLE = 7.8, 0.9, 0.8
LSB_DEVIATION, TRAILING_NULLS = 0.25, 80
SECTIONS, SECTION_MIN_BYTES = 10, 1024
HIGH_SECTION, HIGH_SECTIONS, SECTION_VARIANCE = 7.5, 7, 2.0

# Strings whose joint presence suggests malware, and how many it takes.
MALWARE_STRINGS = (
    "CreateRemoteThread", "VirtualAllocEx", "WriteProcessMemory", "GetProcAddress", "LoadLibrary",
    "WinExec", "ShellExecute", "cmd.exe", "powershell.exe", "rundll32.exe", "nc.exe -l", "ncat --exec",
    "/bin/sh -i", "bash -i", "python -c", "exec(", "eval(", "base64", "FromBase64String",
    "ToBase64String", "CryptoStream", "AES.Create", "DES.Create",
)
MALWARE_LIMIT = 5
# Headers that do not belong inside a capture, searched after byte 100.
EMBEDDED = (
    (b"\x4d\x5a", "PE executable"),
    (b"\x7f\x45\x4c\x46", "ELF executable"),
    (b"\x50\x4b\x03\x04", "ZIP archive"),
    (b"%PDF", "PDF document"),
    (b"\xff\xd8\xff", "JPEG image"),
)
EMBEDDED_AFTER = 100
# Byte runs seen in exploits.
SEQUENCES = (b"\x90" * 4, b"\xcc" * 4, b"\xde\xad\xbe\xef", b"\xca\xfe\xba\xbe")
# Exploit signatures and their names.
EXPLOITS = (
    (b"\x31\xc0\x50\x68", "Shellcode pattern"),
    (b"\x89\xe5\x31\xc0", "Stack manipulation"),
    (b"\x31\xdb\x8d\x43", "Register clearing pattern"),
    (b"A" * 40, "Buffer overflow pattern"),
    (b"\x90" * 20, "NOP sled"),
    (b"\xeb\xfe", "Infinite loop"),
    (b"HKEY_LOCAL_MACHINE\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run", "Registry persistence"),
    (b"CreateProcess", "Process creation"),
    (b"VirtualProtect", "Memory protection manipulation"),
)
# What counts as repetition at the start of a file. A run of RUN equal bytes that begins
# among the first HEAD; equal bytes in whole chunks, and four bytes eight times over, counted over a
# stretch at given steps; consecutive nulls.
HEAD, RUN = 1000, 100
CHUNK, CHUNK_STRETCH, CHUNKS = 16, 500, 15
CYCLE, CYCLES_EACH, CYCLE_STRETCH, CYCLES = 4, 8, 200, 2
NULL_RUN = 100
# Limits of plausible header fields.
VERSIONS_MAJOR, VERSIONS_MINOR, PLAUSIBLE_SNAPLEN, PLAUSIBLE_LINK = (1, 10), (0, 10), 1_000_000, 1000
# Words that rate an issue.
HIGH_WORDS = ("malware", "executable", "exploit", "suspicious")
MEDIUM_WORDS = ("entropy", "pattern", "embedded")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length", "content")
    )


def _header_number(head: Column, start: int, size: int, little: Column) -> Column:
    """An unsigned number from hex text, in the byte order of the file."""
    digits = F.substring(head, start * 2 + 1, size * 2)
    swapped = F.concat(*[F.substring(digits, size * 2 - 1 - 2 * i, 2) for i in range(size)])
    return F.conv(F.when(little, swapped).otherwise(digits), 16, 10).try_cast("long")


def _size(files: DataFrame) -> Column:
    """Bytes of a file: as listed, if the table says so, so that contents need not be read."""
    return (F.col("length") if "length" in files.columns else F.octet_length("content")).cast("long")


def file_types(files: DataFrame) -> DataFrame:
    """Type by magic or look, header fields, and whether name, size and header are valid."""
    head = F.hex(F.substring("content", 1, 24))
    magic = F.substring(head, 1, 8)
    types = F.create_map(*[F.lit(x) for kv in CAPTURE_TYPES.items() for x in kv])
    looks = None
    for prefix, name in LOOK_ALIKES:
        hit = F.startswith(head, F.lit(prefix))
        looks = F.when(hit, F.lit(name)) if looks is None else looks.when(hit, F.lit(name))
    printable = magic.rlike("^([2-6][0-9A-F]|7[0-9A-E]){4}$")
    looks = looks.when(printable, F.lit("Text file")).otherwise("Unknown binary format")
    little = magic.isin("D4C3B2A1", "4D3CB2A1", "34CDB2A1", "3412B2A1")
    name = F.element_at(F.split("path", "/"), -1)
    facts = files.select(
        "path",
        _size(files).alias("size"),
        F.try_element_at(types, magic).alias("capture_type"),
        looks.alias("looks_like"),
        _header_number(head, 4, 2, little).alias("version_major"),
        _header_number(head, 6, 2, little).alias("version_minor"),
        _header_number(head, 16, 4, little).alias("snaplen"),
        _header_number(head, 20, 4, little).alias("link_type"),
        F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*EXTENSIONS).alias("extension_ok"),
    )
    header = (
        (F.col("version_major") == 2)
        & (F.col("version_minor") == 4)
        & F.col("snaplen").between(1, MAX_SNAPLEN)
    )
    is_pcap = F.col("capture_type") == "pcap"
    valid = F.when(is_pcap, header).otherwise(F.col("capture_type").isNotNull())
    return facts.withColumns(
        {
            "looks_like": F.when(F.col("capture_type").isNull(), F.col("looks_like")),
            "size_ok": F.col("size").between(MIN_SIZE, MAX_SIZE),
            "header_ok": F.coalesce(valid, F.lit(False)),
            **{
                c: F.when(is_pcap, F.col(c))
                for c in ("version_major", "version_minor", "snaplen", "link_type")
            },
        }
    )


_PROFILE = T.StructType(
    [
        T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("section_entropy", T.ArrayType(T.DoubleType())),
        T.StructField("trailing_nulls", T.LongType()),
    ]
)


@F.pandas_udf(_PROFILE)
def byte_profile(content: pd.Series) -> pd.DataFrame:
    """Byte histogram, entropy of ten equal sections, and NUL bytes at the end."""

    def entropy(h: np.ndarray) -> float:
        p = h[h > 0] / h.sum() if h.sum() else np.ones(1)
        return float(-(p * np.log2(p)).sum())

    rows = []
    for raw in content:
        b = np.frombuffer(raw or b"", dtype=np.uint8)
        step = len(b) // SECTIONS
        edges = [i * step for i in range(SECTIONS)] + [len(b)]
        hists = [np.bincount(b[s:e], minlength=256) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        filled = np.flatnonzero(b)
        trailing = len(b) - (int(filled[-1]) + 1 if len(filled) else 0)
        rows.append((np.sum(hists, axis=0), [entropy(h) for h in hists], trailing))
    return pd.DataFrame(rows, columns=["counts", "section_entropy", "trailing_nulls"])


def profiles(files: DataFrame) -> DataFrame:
    """Byte statistics of whole files and the limits they break."""
    p = files.select("path", _size(files).alias("size"), byte_profile("content").alias("p"))
    counts = F.col("p.counts")

    def total(first: int, last: int, step: int = 1) -> Column:
        picked = F.transform(F.sequence(F.lit(first), F.lit(last), F.lit(step)), lambda i: F.get(counts, i))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x)

    def share(n: Column) -> Column:
        return F.when(F.col("size") > 0, n / F.col("size")).otherwise(0.0)

    sections = F.col("p.section_entropy")
    mean = F.aggregate(sections, F.lit(0.0), lambda a, x: a + x) / SECTIONS
    spread = F.aggregate(
        F.transform(sections, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x
    )
    long_enough = F.col("size") >= SECTION_MIN_BYTES
    measured = p.select(
        "path",
        "size",
        share(F.get(counts, F.lit(0))).alias("null_ratio"),
        share(total(32, 126)).alias("printable_ratio"),
        share(total(1, 255, 2)).alias("lsb_ratio"),
        text.entropy_of_counts(F.filter(counts, lambda n: n > 0)).alias("entropy"),
        F.col("p.trailing_nulls").alias("trailing_nulls"),
        F.when(long_enough, F.size(F.filter(sections, lambda x: x > HIGH_SECTION)))
        .otherwise(0)
        .alias("high_sections"),
        F.when(long_enough, spread / SECTIONS).otherwise(0.0).alias("section_variance"),
    )
    issues = F.array_compact(
        F.array(
            F.when(F.col("null_ratio") > MAX_NULLS, F.lit("Excessive null bytes")),
            F.when(F.col("printable_ratio") > MAX_PRINTABLE, F.lit("High printable character ratio, suspicious for a capture")),
            F.when(F.col("entropy") > MAX_ENTROPY, F.lit("High entropy detected")),
            F.when(
                (F.col("size") > 1000) & (F.abs(F.col("lsb_ratio") - 0.5) > LSB_DEVIATION),
                F.lit("Unusual LSB distribution"),
            ),
            F.when(F.col("trailing_nulls") > TRAILING_NULLS, F.lit("Excessive trailing null bytes")),
            F.when(F.col("high_sections") > HIGH_SECTIONS, F.lit("Excessive high-entropy sections")),
            F.when(F.col("section_variance") > SECTION_VARIANCE, F.lit("Unusual entropy distribution")),
        )
    )
    return measured.withColumn("issues", issues)


def _holds(b: bytes, after: int = 0) -> Column:
    content = F.col("content").cast("binary")
    if after:
        content = F.substring(content, after + 1, MAX_SIZE - 1)
    return F.contains(content, F.lit(b))


def signatures(files: DataFrame) -> DataFrame:
    """Signature hits of each file, and the issues they amount to."""
    strings = F.array_compact(
        F.array(*[F.when(_holds(s.encode()), F.lit(s)) for s in MALWARE_STRINGS])
    )
    embedded = F.array_compact(
        F.array(*[F.when(_holds(b, EMBEDDED_AFTER), F.lit(n)) for b, n in EMBEDDED])
    )
    runs = F.array_compact(F.array(*[F.when(_holds(b), F.lit(b.hex())) for b in SEQUENCES]))
    exploits = F.array_compact(F.array(*[F.when(_holds(b), F.lit(n)) for b, n in EXPLOITS]))
    hits = files.select(
        "path",
        strings.alias("malware_strings"),
        embedded.alias("embedded"),
        runs.alias("sequences"),
        exploits.alias("exploits"),
    )
    issues = F.concat(
        F.when(
            F.size("malware_strings") >= MALWARE_LIMIT, F.array(F.lit("Multiple malware indicators detected"))
        ).otherwise(F.array().cast("array<string>")),
        F.transform("embedded", lambda n: F.concat(F.lit("Embedded file detected: "), n)),
        F.transform("sequences", lambda h: F.concat(F.lit("Suspicious byte sequence detected: "), h)),
        F.transform("exploits", lambda n: F.concat(F.lit("Exploit signature: "), n)),
    )
    return hits.withColumn("issues", issues)


def repetitions(files: DataFrame) -> DataFrame:
    """Repetition at the start of each file: a long run of one byte, chunks of one byte, four bytes
    over and over, and padding with nulls. All but the first need a file of ``HEAD`` bytes."""
    content = F.col("content").cast("binary")
    # one character for each byte, so that places and back references are those of bytes
    head = F.decode(F.substring(content, 1, HEAD + RUN - 1), "ISO-8859-1")
    seen = files.select("path", F.octet_length(content).alias("size"), head.alias("head"))
    start = F.substring("head", 1, HEAD)

    def repeated(step: int, stretch: int, part: int) -> Column:
        """Pieces of ``step`` characters that repeat their first ``part`` all through."""
        places = F.sequence(F.lit(1), F.lit(min(HEAD - step, stretch)), F.lit(step))
        pieces = F.transform(places, lambda at: F.substr(F.col("head"), at, F.lit(step)))
        return F.size(F.filter(pieces, lambda p: p == F.repeat(F.substr(p, F.lit(1), F.lit(part)), F.lit(step // part))))

    long = F.col("size") >= HEAD
    run = F.substr("head", F.lit(1), F.least(F.lit(HEAD + RUN - 1), F.greatest(F.col("size") - 1, F.lit(0)))).rlike(r"(?s)(.)\1{%d}" % (RUN - 1))
    measured = seen.select(
        "path",
        run.alias("long_run"),
        F.when(long, repeated(CHUNK, CHUNK_STRETCH, 1)).otherwise(0).alias("equal_chunks"),
        F.when(long, start.rlike(r"\x00{%d}" % (NULL_RUN + 1))).otherwise(False).alias("null_padding"),
        F.when(long, repeated(CYCLE * CYCLES_EACH, CYCLE_STRETCH, CYCLE)).otherwise(0).alias("cycles"),
    )
    issues = F.array_compact(
        F.array(
            F.when(F.col("long_run"), F.lit("Long repetitive pattern detected (potential padding)")),
            F.when(F.col("equal_chunks") > CHUNKS, F.lit("Excessive repetitive pattern detected")),
            F.when(F.col("null_padding"), F.lit("Excessive null byte padding detected")),
            F.when(F.col("cycles") > CYCLES, F.lit("Multiple suspicious alternating patterns detected")),
        )
    )
    return measured.withColumn("issues", issues)


def structure(files: DataFrame) -> DataFrame:
    """Header fields of captures of plain records that are out of their plausible ranges, read with
    the low byte first whatever the file says; ``consistent`` if there are none. Other files of 24
    bytes or more are not judged."""
    head = F.hex(F.substring(F.col("content").cast("binary"), 1, MIN_SIZE))
    plain = F.substring(head, 1, 8).isin(*[m for m, kind in CAPTURE_TYPES.items() if kind == "pcap"])
    number = lambda start, size: _header_number(head, start, size, F.lit(True))
    versions = number(4, 2).between(*VERSIONS_MAJOR) & number(6, 2).between(*VERSIONS_MINOR)
    found = F.array(
        F.when(plain & ~versions, F.lit("Invalid version numbers")),
        F.when(plain & (number(16, 4) > PLAUSIBLE_SNAPLEN), F.lit("Excessive snaplen value")),
        F.when(plain & (number(20, 4) > PLAUSIBLE_LINK), F.lit("Unusual network type")),
    )
    small = F.length(head) < 2 * MIN_SIZE
    issues = F.when(small, F.array(F.lit("File too small"))).otherwise(F.array_compact(found))
    return files.select("path", issues.alias("issues")).withColumn("consistent", F.size("issues") == 0)


def severity(issues: Column) -> Column:
    """critical, high, medium or low, by the words in the issues."""

    def count(words) -> Column:
        return F.size(F.filter(issues, lambda i: F.lower(i).rlike("|".join(words))))

    high, medium = count(HIGH_WORDS), count(MEDIUM_WORDS)
    return (
        F.when(high >= 2, F.lit("critical"))
        .when(high >= 1, F.lit("high"))
        .when(medium >= 2, F.lit("medium"))
        .otherwise("low")
    )


def verdicts(files: DataFrame) -> DataFrame:
    """All issues of a file with their severity."""
    both = profiles(files).select("path", F.col("issues").alias("a")).join(
        signatures(files).select("path", F.col("issues").alias("b")), "path"
    )
    return both.select("path", F.concat("a", "b").alias("issues")).withColumn(
        "severity", severity(F.col("issues"))
    )


def hashes(files: DataFrame) -> DataFrame:
    return files.select(
        "path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"),
        _size(files).alias("size"),
    )


def duplicates(files: DataFrame) -> DataFrame:
    """Hashes more than one file has, with the count and the first path."""
    return (
        hashes(files)
        .groupBy("sha256")
        .agg(F.count("*").alias("files"), F.min("path").alias("first_path"), F.sum("size").alias("bytes"))
        .where(F.col("files") > 1)
    )
