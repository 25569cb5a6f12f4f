from pyspark.sql import functions as F

from netlens.operators import report, screen
from netlens.plans.detection import _TRIAGE
from netlens.plans.registry import query
from netlens.plans.shape import rounded
from netlens.sources import derived


def _q(name, sql):
    return query(name, sql, base="payloads")


@_q(
    "v1_file_types",
    """, h AS (SELECT path, strlen(content) AS size, hex(content)[1:8] AS magic FROM payloads)
SELECT path, size, NULL::VARCHAR AS capture_type, CASE WHEN starts_with(magic, '1F8B08') THEN 'GZIP compressed file'
  WHEN starts_with(magic, '4D5A') THEN 'Windows executable (PE)' WHEN magic = '25504446' THEN 'PDF document'
  WHEN starts_with(magic, 'EFBBBF') THEN 'UTF-8 text file with BOM'
  WHEN regexp_full_match(magic, '([2-6][0-9A-F]|7[0-9A-E]){4}') THEN 'Text file' ELSE 'Unknown binary format' END AS looks_like,
  false AS extension_ok, size BETWEEN 24 AND 2147483648 AS size_ok, false AS header_ok FROM h""",
)
def v1(spark, sf):
    return screen.file_types(derived.payloads(spark, sf)).select(
        "path", "size", "capture_type", "looks_like", "extension_ok", "size_ok", "header_ok"
    )


_V2 = """, hx AS (SELECT path, strlen(content) AS size, regexp_extract_all(hex(content), '..') AS l FROM payloads),
b AS (SELECT path, size, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM hx),
c AS (SELECT path, x, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2),
t AS (SELECT path, sum(n) FILTER (x = '00') AS nulls, sum(n) FILTER (x BETWEEN '20' AND '7E') AS printable,
   sum(n) FILTER (x[2] IN ('1','3','5','7','9','B','D','F')) AS odd, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM c GROUP BY 1),
se AS (SELECT path, s, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM (SELECT path, least(9, i // (size // 10)) AS s, x,
   count(*)::DOUBLE AS n FROM b WHERE size >= 1024 GROUP BY 1, 2, 3) GROUP BY 1, 2),
sv AS (SELECT path, count(*) FILTER (e > 7.5) AS high_sections, var_pop(e) AS section_variance FROM se GROUP BY 1),
v2 AS (SELECT h.path, h.size, coalesce(nulls / size, 0) AS null_ratio, coalesce(printable / size, 0) AS printable_ratio,
   coalesce(odd / size, 0) AS lsb_ratio, coalesce(entropy, 0) AS entropy, coalesce(high_sections, 0) AS high_sections,
   coalesce(section_variance, 0) AS section_variance FROM hx h LEFT JOIN t USING (path) LEFT JOIN sv USING (path)),
i2 AS (SELECT path, list_filter([CASE WHEN null_ratio > 0.9 THEN 'Excessive null bytes' END,
   CASE WHEN printable_ratio > 0.8 THEN 'High printable character ratio, suspicious for a capture' END,
   CASE WHEN entropy > 7.8 THEN 'High entropy detected' END,
   CASE WHEN size > 1000 AND abs(lsb_ratio - 0.5) > 0.25 THEN 'Unusual LSB distribution' END,
   CASE WHEN high_sections > 7 THEN 'Excessive high-entropy sections' END,
   CASE WHEN section_variance > 2 THEN 'Unusual entropy distribution' END], lambda x: x IS NOT NULL) AS issues FROM v2)
"""


@_q(
    "v2_byte_profiles",
    _V2
    + """SELECT path, size, round(null_ratio, 6) AS null_ratio, round(printable_ratio, 6) AS printable_ratio, round(lsb_ratio, 6) AS lsb_ratio,
  round(entropy, 6) AS entropy, high_sections::INT AS high_sections, round(section_variance, 6) AS section_variance,
  (SELECT length(content) - length(rtrim(content, chr(0))) FROM payloads p WHERE p.path = v2.path)::BIGINT AS trailing_nulls,
  array_to_string(issues, '; ') AS issues FROM v2 JOIN i2 USING (path)""",
)
def v2(spark, sf):
    p = screen.profiles(derived.payloads(spark, sf))
    return rounded(p.withColumn("issues", F.concat_ws("; ", "issues")))


def _t(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spaced(b: bytes) -> str:
    return _t(" ".join(f"{x:02X}" for x in b))


def _sql_list(items) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {_t(n)} END" for n, c in items) + "], lambda x: x IS NOT NULL)"


_V3 = (
    """, hx AS (SELECT path, content, array_to_string(regexp_extract_all(hex(content), '..'), ' ') AS h,
   array_to_string(regexp_extract_all(hex(content), '..')[101:], ' ') AS tail FROM payloads),
v3 AS (SELECT path, """
    + _sql_list([(s, f"contains(content, {_t(s)})") for s in screen.MALWARE_STRINGS])
    + " AS malware_strings, "
    + _sql_list([(n, f"contains(tail, {_spaced(b)})") for b, n in screen.EMBEDDED])
    + " AS embedded, "
    + _sql_list([(b.hex(), f"contains(h, {_spaced(b)})") for b in screen.SEQUENCES])
    + " AS sequences, "
    + _sql_list([(n, f"contains(h, {_spaced(b)})") for b, n in screen.EXPLOITS])
    + """ AS exploits FROM hx),
i3 AS (SELECT *, list_concat(list_concat(CASE WHEN len(malware_strings) >= 5 THEN ['Multiple malware indicators detected'] ELSE [] END,
   list_transform(embedded, lambda n: 'Embedded file detected: ' || n)), list_concat(
   list_transform(sequences, lambda n: 'Suspicious byte sequence detected: ' || n),
   list_transform(exploits, lambda n: 'Exploit signature: ' || n))) AS issues FROM v3)
"""
)


@_q(
    "v3_signature_hits",
    _V3
    + """SELECT path, array_to_string(malware_strings, ',') AS malware_strings, array_to_string(embedded, ',') AS embedded,
  array_to_string(sequences, ',') AS sequences, array_to_string(exploits, ',') AS exploits, array_to_string(issues, '; ') AS issues FROM i3""",
)
def v3(spark, sf):
    s = screen.signatures(derived.payloads(spark, sf))
    return s.select(
        "path",
        *[F.concat_ws(",", c).alias(c) for c in ("malware_strings", "embedded", "sequences", "exploits")],
        F.concat_ws("; ", "issues").alias("issues"),
    )


@_q(
    "v4_file_severity",
    _V2
    + _V3.replace(", hx AS", ", hx3 AS").replace("FROM hx)", "FROM hx3)")
    + """, a AS (SELECT path, list_concat(i2.issues, i3.issues) AS issues FROM i2 JOIN i3 USING (path)),
n AS (SELECT path, issues, len(list_filter(issues, lambda x: regexp_matches(lower(x), 'malware|executable|exploit|suspicious'))) AS h,
   len(list_filter(issues, lambda x: regexp_matches(lower(x), 'entropy|pattern|embedded'))) AS m FROM a)
SELECT path, array_to_string(issues, '; ') AS issues, CASE WHEN h >= 2 THEN 'critical' WHEN h >= 1 THEN 'high' WHEN m >= 2 THEN 'medium'
  ELSE 'low' END AS severity FROM n""",
)
def v4(spark, sf):
    v = screen.verdicts(derived.payloads(spark, sf))
    return v.withColumn("issues", F.concat_ws("; ", "issues"))


@_q("v5_file_hashes", "SELECT path, sha256(content) AS sha256, strlen(content) AS size FROM payloads")
def v5(spark, sf):
    return screen.hashes(derived.payloads(spark, sf))


@_q(
    "v5_duplicate_files",
    """SELECT sha256(content) AS sha256, count(*) AS files, min(path) AS first_path, sum(strlen(content))::BIGINT AS bytes
FROM payloads GROUP BY 1 HAVING count(*) > 1""",
)
def v5_duplicates(spark, sf):
    return screen.duplicates(derived.payloads(spark, sf))


@query("s6_s7_analysis_documents")
def s6(spark, sf):
    return report.documents(derived.packets(spark, sf))


@query("s11_export_rows")
def s11(spark, sf):
    return report.numbered(report.export_rows(report.documents(derived.packets(spark, sf))))


@query(
    "s11_export_counts",
    f""", h AS (SELECT capture_id, ip, count(*) AS n, sum(packet_size)::BIGINT AS b FROM (
   SELECT capture_id, src_ip AS ip, packet_size FROM packets UNION ALL SELECT capture_id, dst_ip, packet_size FROM packets) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, ip) AS rank FROM h)
SELECT capture_id, 'protocols' AS section, protocol AS item, count(*)::VARCHAR AS value FROM packets GROUP BY 1, 3
UNION ALL SELECT capture_id, 'top_talkers', ip, b::VARCHAR FROM r WHERE rank <= 10
UNION ALL SELECT capture_id, 'findings', type || '/' || severity, count(*)::VARCHAR FROM ({_TRIAGE}) GROUP BY capture_id, type, severity
UNION ALL SELECT capture_id, 'traffic_stats', 'packets', count(*)::VARCHAR FROM packets GROUP BY 1
UNION ALL SELECT capture_id, 'traffic_stats', 'bytes', sum(packet_size)::BIGINT::VARCHAR FROM packets GROUP BY 1
UNION ALL SELECT capture_id, 'tcp', 'resets', (count(*) FILTER (tcp_flags & 4 <> 0))::VARCHAR FROM packets GROUP BY 1
UNION ALL SELECT capture_id, 'http', 'requests', count(http_method)::VARCHAR FROM packets GROUP BY 1
UNION ALL SELECT capture_id, 'dns', 'queries', count(dns_query)::VARCHAR FROM packets GROUP BY 1 HAVING count(dns_query) > 0""",
)
def s11_counts(spark, sf):
    rows = report.export_rows(report.documents(derived.packets(spark, sf)))
    listed = F.col("section").isin("protocols", "top_talkers", "findings")
    single = F.concat_ws(".", "section", "item").isin(
        "traffic_stats.packets", "traffic_stats.bytes", "tcp.resets", "http.requests", "dns.queries"
    )
    return rows.where(listed | single)


@query(
    "c9_report_summaries",
    """, p AS (SELECT capture_id, protocol, count(*) AS n FROM packets GROUP BY 1, 2),
t AS (SELECT capture_id, count(*) AS total_packets, sum(packet_size)::BIGINT AS total_bytes,
   round((max(us) - min(us)) / 1e6, 6) AS duration_s FROM packets GROUP BY 1)
SELECT t.*, (SELECT string_agg(protocol, ',' ORDER BY n DESC, protocol) FROM p WHERE p.capture_id = t.capture_id) AS top_protocols FROM t""",
)
def c9(spark, sf):
    s = report.summaries(report.documents(derived.packets(spark, sf)))
    return rounded(s.drop("issues_found").withColumn("top_protocols", F.concat_ws(",", "top_protocols")))


@_q(
    "v2_repetition_checks",
    """, f AS (SELECT path, CASE strlen(content) % 5 WHEN 0 THEN repeat('A', 150) WHEN 1 THEN repeat('ABCD', 60) WHEN 2 THEN repeat(chr(0), 120)
   WHEN 4 THEN repeat('A', 400) ELSE '' END || content AS c FROM payloads),
h AS (SELECT path, strlen(c) AS size, hex(c)[1:2198] AS x FROM f),
m AS (SELECT path,
   len(list_filter(range(0, least(size - 100, 1000)), lambda i: substr(x, 2 * i + 1, 200) = repeat(substr(x, 2 * i + 1, 2), 100))) > 0 AS long_run,
   CASE WHEN size >= 1000 THEN len(list_filter(range(0, 500, 16), lambda i: substr(x, 2 * i + 1, 32) = repeat(substr(x, 2 * i + 1, 2), 16))) ELSE 0 END AS equal_chunks,
   size >= 1000 AND len(list_filter(range(0, 900), lambda i: substr(x, 2 * i + 1, 202) = repeat('00', 101))) > 0 AS null_padding,
   CASE WHEN size >= 1000 THEN len(list_filter(range(0, 200, 32), lambda i: substr(x, 2 * i + 1, 64) = repeat(substr(x, 2 * i + 1, 8), 8))) ELSE 0 END AS cycles FROM h)
SELECT path, long_run, equal_chunks::INT AS equal_chunks, null_padding, cycles::INT AS cycles, array_to_string(list_filter([
   CASE WHEN long_run THEN 'Long repetitive pattern detected (potential padding)' END,
   CASE WHEN equal_chunks > 15 THEN 'Excessive repetitive pattern detected' END,
   CASE WHEN null_padding THEN 'Excessive null byte padding detected' END,
   CASE WHEN cycles > 2 THEN 'Multiple suspicious alternating patterns detected' END], lambda s: s IS NOT NULL), '; ') AS issues FROM m""",
)
def v2_repetitions(spark, sf):
    """The payloads behind padding of a kind that their length decides."""
    files = derived.payloads(spark, sf)
    kind = F.octet_length("content") % 5
    padding = F.when(kind == 0, "A" * 150).when(kind == 1, "ABCD" * 60).when(kind == 2, "\0" * 120).when(kind == 4, "A" * 400).otherwise("")
    padded = files.withColumn("content", F.concat(padding.cast("binary"), "content"))
    return screen.repetitions(padded).withColumn("issues", F.concat_ws("; ", "issues"))


@_q(
    "v2_header_structure",
    """, n AS (SELECT path, strlen(content) AS size FROM payloads)
SELECT path, array_to_string(list_filter([CASE WHEN size % 13 NOT BETWEEN 1 AND 10 OR size % 12 > 10 THEN 'Invalid version numbers' END,
   CASE WHEN size * 700 % 2000000 > 1000000 THEN 'Excessive snaplen value' END, CASE WHEN size % 2000 > 1000 THEN 'Unusual network type' END],
   lambda s: s IS NOT NULL), '; ') AS issues, size % 13 BETWEEN 1 AND 10 AND size % 12 <= 10 AND size * 700 % 2000000 <= 1000000
   AND size % 2000 <= 1000 AS consistent FROM n""",
)
def v2_structure(spark, sf):
    """Headers whose fields the lengths of the payloads decide."""
    size = F.octet_length("content")

    def little(n, width):
        digits = F.lpad(F.hex(n.cast("bigint")), 2 * width, "0")
        return F.concat(*[F.substring(digits, 2 * width - 1 - 2 * i, 2) for i in range(width)])

    fields = F.concat(F.lit("D4C3B2A1"), little(size % 13, 2), little(size % 12, 2), F.lit("00" * 8), little(size * 700 % 2_000_000, 4), little(size % 2000, 4))
    files = derived.payloads(spark, sf).withColumn("content", F.unhex(fields))
    return screen.structure(files).withColumn("issues", F.concat_ws("; ", "issues"))
