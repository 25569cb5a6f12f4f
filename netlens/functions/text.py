"""Domain-name and payload expressions: entropy, look-alike tests, protocol guesses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SUSPICIOUS_TLDS = (".tk", ".ml", ".ga", ".cf")
DASHED_IP = r"\d{1,3}-\d{1,3}-\d{1,3}-\d{1,3}"
LONG_HEX = r"[a-f0-9]{32,}"
REPEATED = r"(.)\1{4,}"
RUN_ENDS = r"(?s)(?<=(.))(?!\1|\z)"
PORT_APPLICATIONS = {
    80: "HTTP",
    443: "HTTPS",
    21: "FTP",
    22: "SSH",
    23: "Telnet",
    25: "SMTP",
    53: "DNS",
    110: "POP3",
    143: "IMAP",
    993: "IMAPS",
    995: "POP3S",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def byte_text(content) -> Column:
    """A text or binary value with one character per byte, as ISO-8859-1 maps them."""
    return F.decode(_col(content).cast("binary"), "ISO-8859-1")


def byte_counts(content) -> Column:
    """Distinct bytes of a text or binary value with their counts: array<struct<byte, n>>."""
    return char_counts(byte_text(content))


def char_counts(chars) -> Column:
    """Distinct characters with their counts: they are sorted, and a count is the length of a run."""
    ordered = F.array_join(F.sort_array(F.filter(F.split(_col(chars), ""), lambda c: c != "")), "")

    def runs(s: Column) -> Column:
        return F.transform(
            F.split(s, RUN_ENDS), lambda run: F.struct(F.substring(run, 1, 1).alias("byte"), F.length(run).alias("n"))
        )

    none = F.array().cast("array<struct<byte: string, n: int>>")
    return _let(ordered, lambda s: F.when(F.length(s) > 0, runs(s)).when(F.length(s) == 0, none))


def entropy_of_counts(counts: Column) -> Column:
    """Shannon entropy in bits of an array of positive counts: log2 N − Σ c·log2 c / N."""

    def of(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0).cast("long"), lambda a, n: a + n)
        weighted = F.aggregate(c, F.lit(0.0), lambda a, n: a + n * F.log2(n.cast("double")))
        return _let(
            total, lambda t: F.when(t > 0, F.log2(t.cast("double")) - weighted / t).otherwise(F.lit(0.0))
        )

    return _let(counts, of)


def entropy(content) -> Column:
    """Byte entropy of a text or binary value; 0 when empty."""
    c = _col(content)
    counts = F.transform(byte_counts(c), lambda s: s["n"].cast("long"))
    return F.when(F.octet_length(c.cast("binary")) > 0, entropy_of_counts(counts)).otherwise(
        F.lit(0.0)
    )


def looks_generated(domain) -> Column:
    """More than ten characters and over four consonants per vowel (with at least one vowel)."""
    d = F.lower(_col(domain))
    vowels = F.length(F.regexp_replace(d, "[^aeiou]", ""))
    letters = F.length(F.regexp_replace(d, r"[^\p{L}]", ""))
    return (F.length(d) > 10) & (vowels > 0) & (letters - vowels > vowels * 4)


def suspicious_pattern(domain) -> Column:
    """A dashed address, a long hex run, or one character five times in a row."""
    d = F.lower(_col(domain))
    return d.rlike(DASHED_IP) | d.rlike(LONG_HEX) | d.rlike(REPEATED)


def suspicious_deep(domain) -> Column:
    d = _col(domain)
    tld = F.lit(False)
    for t in SUSPICIOUS_TLDS:
        tld = tld | d.endswith(t)
    return (F.length(d) > 100) | (entropy(d) > 4.0) | tld


def suspicion_reasons(domain) -> Column:
    d = _col(domain)
    return F.array_compact(
        F.array(
            F.when(F.length(d) > 100, F.lit("excessive_length")),
            F.when(entropy(d) > 4.0, F.lit("high_entropy")),
            F.when(d.rlike("[0-9]{4,}"), F.lit("excessive_numbers")),
        )
    )


def application_protocol(payload, port) -> Column:
    """Application by payload prefix, then by port; the first match wins."""
    p, port = _col(payload).cast("binary"), _col(port)

    def starts(b: bytes) -> Column:
        return F.startswith(p, F.lit(b))

    greeting = F.contains(F.substring(p, 1, 20), F.lit(b"220 "))
    names = F.create_map(*[F.lit(x) for kv in PORT_APPLICATIONS.items() for x in kv])
    by_port = F.coalesce(port, F.lit(-1))
    return (
        F.when(F.coalesce(F.octet_length(p), F.lit(0)) == 0, F.lit("unknown"))
        .when(starts(b"GET ") | starts(b"POST ") | starts(b"HTTP/"), F.lit("HTTP"))
        .when(starts(b"\x16\x03") | (by_port == 443), F.lit("HTTPS/TLS"))
        .when(greeting | by_port.isin(20, 21), F.lit("FTP"))
        .when(starts(b"SSH-") | (by_port == 22), F.lit("SSH"))
        .when(by_port == 53, F.lit("DNS"))
        .otherwise(F.coalesce(F.try_element_at(names, by_port), F.lit("unknown")))
    )
