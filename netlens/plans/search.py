from pyspark.sql import functions as F

from netlens.operators import detect, filters, prefixes, search
from netlens.operators.search import Criterion, RuleBook, SearchQuery
from netlens.operators.stage import checkpointed
from netlens.plans.detection import _D8, _TRIAGE
from netlens.plans.flows import _A8, _CONV
from netlens.plans.registry import query
from netlens.plans.shape import rounded
from netlens.sources import derived

# ---------------------------------------------------------------- packet filters

_PK = "SELECT capture_id, frame_number FROM packets WHERE "


def _packets_where(spark, sf, cond):
    return derived.packets(spark, sf).where(cond).select("capture_id", "frame_number")


def _filter_query(name, cond_sql, cond):
    @query(name, _PK + cond_sql)
    def run(spark, sf):
        return _packets_where(spark, sf, cond())

    return run


_filter_query("f1_by_protocol", "upper(protocol) = 'UDP'", lambda: filters.by_protocol("udp"))
_filter_query("f2_by_port", "src_port = 443 OR dst_port = 443", lambda: filters.by_port(443))

_OCT = "(string_split({c}, '.')[{i}])::INT"


def _cidr_sql(col, prefix, mask_octets):
    return " AND ".join(f"{_OCT.format(c=col, i=i + 1)} {cond}" for i, cond in enumerate(mask_octets))


_IN_172 = "(" + _cidr_sql("{s}", None, ["= 10", "= 0", "BETWEEN 2 AND 3"]) + ")"


@query("f3_by_ip_range", _PK + _IN_172.format(s="src_ip") + " OR " + _IN_172.format(s="dst_ip"))
def f3(spark, sf):
    return _packets_where(spark, sf, filters.by_ip_range("10.0.2.77/23"))


@query("f3_bad_ip_range", _PK + "false")
def f3_bad(spark, sf):
    return _packets_where(spark, sf, filters.by_ip_range("10.0.2.0/99"))


# a table of blocks that grows with the data: networks of suppliers inside those of nations
_BLOCKS = """blocks AS (
  SELECT '10.0.' || (s_suppkey % 7) || '.' || (s_suppkey * 4 % 256) || '/' || (22 + s_suppkey % 11) AS cidr FROM supplier
  UNION SELECT '10.' || n_nationkey || '.0.0/' || (8 + n_nationkey % 9) FROM nation WHERE n_nationkey < 3)"""

_LONGEST = f"""
, {_BLOCKS},
octets AS (SELECT cidr, string_split(string_split(cidr, '/')[1], '.') AS o, (string_split(cidr, '/')[2])::INT AS length FROM blocks),
spans AS (
  SELECT cidr, length, n - n % (1::BIGINT << (32 - length)) AS low, n - n % (1::BIGINT << (32 - length)) + (1::BIGINT << (32 - length)) - 1 AS high
  FROM (SELECT cidr, length, ((o[1]::BIGINT * 256 + o[2]::BIGINT) * 256 + o[3]::BIGINT) * 256 + o[4]::BIGINT AS n FROM octets) q),
hosts AS (
  SELECT src_ip, packets, bytes, ((o[1]::BIGINT * 256 + o[2]::BIGINT) * 256 + o[3]::BIGINT) * 256 + o[4]::BIGINT AS n
  FROM (SELECT src_ip, string_split(src_ip, '.') AS o, count(*) AS packets, sum(packet_size)::BIGINT AS bytes FROM packets GROUP BY src_ip) q),
ranked AS (
  SELECT src_ip, packets, bytes, cidr, length, row_number() OVER (PARTITION BY src_ip ORDER BY length DESC NULLS LAST, cidr) AS k
  FROM hosts LEFT JOIN spans ON n BETWEEN low AND high)
"""


def _blocks(spark, sf):
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr(
        "concat('10.0.', s_suppkey % 7, '.', s_suppkey * 4 % 256, '/', 22 + s_suppkey % 11) AS cidr"
    )
    nations = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey < 3")
    return suppliers.union(nations.selectExpr("concat('10.', n_nationkey, '.0.0/', 8 + n_nationkey % 9)"))


@query("f3_longest_prefix", _LONGEST + "SELECT src_ip, cidr, length AS prefix_length, packets, bytes FROM ranked WHERE k = 1")
def f3_longest(spark, sf):
    hosts = derived.packets(spark, sf).groupBy("src_ip").agg(F.count("*").alias("packets"), F.sum("packet_size").alias("bytes"))
    found = prefixes.matches(hosts, _blocks(spark, sf), "src_ip").withColumnRenamed("ip", "src_ip")
    return hosts.join(found, "src_ip", "left").select("src_ip", "cidr", "prefix_length", "packets", "bytes")


@query(
    "f4_packets_in_many_ranges",
    _LONGEST
    + """, held AS (SELECT src_ip AS ip FROM ranked WHERE k = 1 AND cidr IS NOT NULL)
SELECT capture_id, frame_number FROM packets WHERE src_ip IN (SELECT ip FROM held) OR dst_ip IN (SELECT ip FROM held)
  OR dst_ip IN (SELECT DISTINCT d.dst_ip FROM (SELECT DISTINCT dst_ip, string_split(dst_ip, '.') AS p FROM packets) d JOIN spans
    ON ((p[1]::BIGINT * 256 + p[2]::BIGINT) * 256 + p[3]::BIGINT) * 256 + p[4]::BIGINT BETWEEN low AND high)""",
)
def f4_many(spark, sf):
    return prefixes.inside(derived.packets(spark, sf), _blocks(spark, sf)).select("capture_id", "frame_number")


@query(
    "f4_packet_filter",
    _PK
    + "protocol IN ('TCP', 'UDP') AND ((" + _IN_172.format(s="src_ip") + " OR " + _IN_172.format(s="dst_ip")
    + """) OR (src_ip = '8.8.8.8' OR dst_ip = '8.8.8.8')) AND (src_port BETWEEN 1 AND 100 OR dst_port BETWEEN 1 AND 100
  OR src_port BETWEEN 8000 AND 8100 OR dst_port BETWEEN 8000 AND 8100) AND packet_size >= 70 AND packet_size <= 700
  AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""",
)
def f4(spark, sf):
    f = filters.PacketFilter(
        protocols=["TCP", "UDP"],
        ip_ranges=["10.0.2.0/23", "8.8.8.8/32", "not-a-range"],
        port_ranges=["1-100", "8000-8100"],
        min_packet_size=70,
        max_packet_size=700,
        start_time="2024-01-03 00:00:00",
        end_time="2024-01-20 12:00:00",
    )
    return _packets_where(spark, sf, f.predicate())


@query(
    "f4_packet_filter_members",
    _PK
    + """src_ip IN ('8.8.8.8', '10.0.1.2', '10.0.3.4', '93.184.10.34') AND dst_port IN (80, 8080) AND http_method IN ('GET', 'POST')""",
)
def f4_members(spark, sf):
    f = filters.PacketFilter(
        src_ips=["8.8.8.8", "10.0.1.2", "10.0.3.4", "93.184.10.34"],
        dst_ports=[80, 8080],
        http_methods=["GET", "POST"],
    )
    return _packets_where(spark, sf, f.predicate())


@query("f12_source_filters", _PK + "protocol = 'TCP' AND tcp_window = 0 AND packet_size > 100")
def f12(spark, sf):
    return filters.source_filters(
        derived.packets(spark, sf), ["protocol = 'TCP'", "tcp_window = 0", "packet_size > 100"]
    ).select("capture_id", "frame_number")


@query(
    "f13_handshake_teardown",
    """SELECT capture_id, frame_number, protocol = 'TCP' AND coalesce(tcp_flags & 2 <> 0, false) AS handshake,
  protocol = 'TCP' AND coalesce(tcp_flags & 5 <> 0, false) AS teardown FROM packets""",
)
def f13(spark, sf):
    return derived.packets(spark, sf).select(
        "capture_id",
        "frame_number",
        filters.in_handshake().alias("handshake"),
        filters.in_teardown().alias("teardown"),
    )


# ---------------------------------------------------------------- search records

_REC = (
    _A8
    + f""", seen AS (SELECT {_CONV}, bit_or(tcp_flags) AS fb, max(http_status) AS http_status, min(http_method) AS http_method,
   min(dns_query) AS dns_query, min(dns_response) AS dns_response FROM conv_packets GROUP BY {_CONV}),
rec AS (SELECT 'conversation' AS type, capture_id, client_ip AS src_ip, server_ip AS dst_ip, client_port AS src_port,
   server_port AS dst_port, CASE WHEN dns_query IS NOT NULL OR dns_response IS NOT NULL THEN 'DNS' ELSE protocol END AS protocol,
   packets AS packet_count, bytes AS byte_count, (end_us - start_us) / 1e6 AS duration,
   CASE WHEN end_us > start_us THEN packets * 1e6 / (end_us - start_us) ELSE 0 END AS pps,
   CASE WHEN end_us > start_us THEN bytes * 1e6 / (end_us - start_us) ELSE 0 END AS bps,
   make_timestamp(start_us) AS start_time, make_timestamp(end_us) AS end_time,
   CASE WHEN fb IS NOT NULL THEN array_to_string(list_filter([CASE WHEN fb & 1 <> 0 THEN 'FIN' END, CASE WHEN fb & 2 <> 0 THEN 'SYN' END,
     CASE WHEN fb & 4 <> 0 THEN 'RST' END, CASE WHEN fb & 8 <> 0 THEN 'PSH' END, CASE WHEN fb & 16 <> 0 THEN 'ACK' END],
     lambda x: x IS NOT NULL), ',') END AS tcp_flags,
   http_status, http_method, dns_query, dns_response, 'normal' AS threat_level, 'normal' AS security_category,
   0::DOUBLE AS anomaly_score, NULL::VARCHAR AS description FROM d JOIN seen USING ({_CONV})
 UNION ALL SELECT 'security_alert', capture_id, src_ip, dst_ip, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
   NULL, NULL, NULL, NULL, severity, type, CASE WHEN severity = 'high' THEN 0.8 ELSE 0.5 END, description FROM ({_TRIAGE})
 UNION ALL SELECT 'performance_issue', capture_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
   NULL, NULL, NULL, NULL, severity, 'performance', 0.3, description FROM ({_D8}))
"""
)


def _records(spark, sf):
    p = derived.packets(spark, sf)
    return search.search_records(p, detect.security_triage(p), detect.performance_issues(p))


def _conversations(spark, sf):
    return search.conversation_records(derived.packets(spark, sf))


_SHOWN = ["type", "capture_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_count", "byte_count"]
_SHOW = ", ".join(_SHOWN)


@query(
    "u1_search_records",
    _REC
    + f"""SELECT {_SHOW}, round(duration, 6) AS duration, round(pps, 6) AS pps, round(bps, 6) AS bps, tcp_flags, http_status,
  threat_level, security_category, anomaly_score, description FROM rec""",
)
def u1(spark, sf):
    return rounded(
        _records(spark, sf).select(
            *_SHOWN, "duration", "pps", "bps", "tcp_flags", "http_status", "threat_level",
            "security_category", "anomaly_score", "description",
        )
    )


# One criterion per operator; the second number is the SQL condition (NULL never matches).
_CRITERIA = {
    "eq": (Criterion("protocol", "eq", "tcp"), "protocol IS NOT NULL AND lower(protocol) = 'tcp'"),
    "ne": (Criterion("protocol", "ne", "tcp"), "protocol IS NOT NULL AND lower(protocol) <> 'tcp'"),
    "contains": (Criterion("tcp_flags", "contains", "fin"), "contains(lower(tcp_flags), 'fin')"),
    "not_contains": (Criterion("tcp_flags", "not_contains", "fin"), "NOT contains(lower(tcp_flags), 'fin')"),
    "gt": (Criterion("packet_count", "gt", 4), "packet_count > 4"),
    "lt": (Criterion("dst_port", "lt", "443"), "dst_port < 443"),
    "gte": (Criterion("byte_count", "gte", 2000), "byte_count >= 2000"),
    "lte": (Criterion("duration", "lte", 0.1), "duration <= 0.1"),
    "in": (Criterion("protocol", "in", ["icmp", "DNS"]), "lower(protocol) IN ('icmp', 'dns')"),
    "not_in": (Criterion("src_port", "not_in", [20001, 20002]), "src_port NOT IN (20001, 20002)"),
    "regex": (Criterion("dns_query", "regex", r"^WWW\d+"), r"regexp_matches(dns_query, '^www\d+', 'i')"),
    "between": (Criterion("dst_port", "between", [53, 443]), "dst_port BETWEEN 53 AND 443"),
    "eq_case": (Criterion("protocol", "eq", "tcp", True), "protocol = 'tcp'"),
    "any_ip": (Criterion("any_ip", "eq", "8.8.8.8"), "src_ip = '8.8.8.8' OR dst_ip = '8.8.8.8'"),
    "any_port": (Criterion("any_port", "in", [80, 20003]), "src_port IN (80, 20003) OR dst_port IN (80, 20003)"),
    "missing": (Criterion("custom", "ne", "x"), "false"),
}


@query(
    "f5_search_operators",
    _REC
    + " UNION ALL ".join(
        f"SELECT '{k}' AS operator, type, capture_id, count(*) AS matches FROM rec WHERE {sql} GROUP BY ALL"
        for k, (_, sql) in _CRITERIA.items()
    ),
)
def f5(spark, sf):
    records = _records(spark, sf)
    hits = F.array_compact(
        F.array(
            *[F.when(search.criterion_predicate(records, c), F.lit(k)) for k, (c, _) in _CRITERIA.items()]
        )
    )
    return (
        records.select("type", "capture_id", F.explode(hits).alias("operator"))
        .groupBy("operator", "type", "capture_id")
        .agg(F.count("*").alias("matches"))
    )


_TWO = (Criterion("protocol", "eq", "TCP"), Criterion("packet_count", "gte", 6))


@query(
    "f6_criteria_and_or",
    _REC
    + f"""SELECT 'AND' AS match, {_SHOW} FROM rec WHERE protocol = 'TCP' AND packet_count >= 6
UNION ALL SELECT 'OR', {_SHOW} FROM rec WHERE protocol = 'TCP' OR packet_count >= 6
UNION ALL SELECT 'NONE', {_SHOW} FROM rec""",
)
def f6(spark, sf):
    r = _records(spark, sf)
    marked = r.withColumn(
        "match",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(search.predicate(r, _TWO, "AND"), F.lit("AND")),
                    F.when(search.predicate(r, _TWO, "OR"), F.lit("OR")),
                    F.when(search.predicate(r, ()), F.lit("NONE")),
                )
            )
        ),
    )
    return marked.select("match", *_SHOWN)


_RULES_SQL = {
    "suspicious_ports": "dst_port IN (23, 135, 139, 445, 1433, 3389, 5900, 6667)",
    "high_volume_connections": "packet_count > 10000",
    "external_connections": "dst_ip IS NOT NULL AND NOT regexp_matches(dst_ip, '^(10[.]|172[.](1[6-9]|2[0-9]|3[01])[.]|192[.]168[.])')",
    "dns_tunneling": "protocol = 'DNS' AND packet_count > 100",
    "slow_connections": "duration > 30 AND pps < 10",
    "failed_connections": "contains(tcp_flags, 'RST')",
    "http_errors": "http_status >= 400",
    "large_downloads": "byte_count > 100000000",
}


@query(
    "f7_predefined_rules",
    _REC
    + " UNION ALL ".join(
        f"SELECT '{k}' AS rule, {_SHOW} FROM rec WHERE {v}" for k, v in _RULES_SQL.items()
    ),
)
def f7(spark, sf):
    records = _records(spark, sf)
    rules = RuleBook().rules
    hits = F.array_compact(
        F.array(
            *[
                F.when(search.predicate(records, r.query.criteria, r.query.match), F.lit(r.name))
                for r in rules
            ]
        )
    )
    return records.withColumn("rule", F.explode(hits)).select("rule", *_SHOWN)


@query(
    "f8_custom_rule",
    _REC + f"SELECT {_SHOW} FROM rec WHERE contains(lower(dns_query), 'pool') OR http_status = 404",
)
def f8(spark, sf):
    book = RuleBook()
    book.add(
        search.FilterRule(
            "pool_or_missing",
            "Pool names or missing pages",
            SearchQuery(
                (Criterion("dns_query", "contains", "POOL"), Criterion("http_status", "eq", 404)), match="OR"
            ),
        )
    )
    return book.apply(_records(spark, sf), "pool_or_missing").select(*_SHOWN)


@query(
    "f9_search_ip_range",
    _REC
    + f"""SELECT 'src' AS side, {_SHOW} FROM rec WHERE starts_with(src_ip, '93.184.') AND ({_OCT.format(c="src_ip", i=3)}) < 64
UNION ALL SELECT 'dst', {_SHOW} FROM rec WHERE starts_with(dst_ip, '93.184.') AND ({_OCT.format(c="dst_ip", i=3)}) < 64
UNION ALL SELECT 'any', {_SHOW} FROM rec WHERE (starts_with(src_ip, '93.184.') AND ({_OCT.format(c="src_ip", i=3)}) < 64)
  OR (starts_with(dst_ip, '93.184.') AND ({_OCT.format(c="dst_ip", i=3)}) < 64)""",
)
def f9(spark, sf):
    r = _conversations(spark, sf).unionByName(
        search.alert_records(detect.security_triage(derived.packets(spark, sf))), allowMissingColumns=True
    )
    # the three searches share one pass: what any side has holds what each has
    found = checkpointed(search.by_ip_range(r, "93.184.0.0/18"))
    parts = [
        search.by_ip_range(found, "93.184.0.0/18", side).select(F.lit(side).alias("side"), *_SHOWN)
        for side in ("src", "dst", "any")
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "f10_search_time_window",
    _REC
    + f"""SELECT {_SHOW} FROM rec WHERE start_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'""",
)
def f10(spark, sf):
    return search.by_time_window(
        _conversations(spark, sf), "2024-01-05 00:00:00", "2024-01-06 12:00:00"
    ).select(*_SHOWN)


@query(
    "f11_security_events",
    _REC
    + """SELECT 'all' AS level, type, capture_id, src_ip, security_category, threat_level, anomaly_score FROM rec
  WHERE security_category <> 'normal'
UNION ALL SELECT 'high', type, capture_id, src_ip, security_category, threat_level, anomaly_score FROM rec
  WHERE security_category <> 'normal' AND threat_level = 'high'""",
)
def f11(spark, sf):
    r = _records(spark, sf)
    cols = ["type", "capture_id", "src_ip", "security_category", "threat_level", "anomaly_score"]
    every = search.security_events(r).select(F.lit("all").alias("level"), *cols)
    high = search.security_events(r, "HIGH").select(F.lit("high").alias("level"), *cols)
    return every.union(high)


_TIES = ("capture_id", "src_ip", "src_port", "dst_ip", "dst_port")
_ORDER = "coalesce(byte_count, 0) DESC, capture_id, src_ip, src_port NULLS FIRST, dst_ip, dst_port NULLS FIRST"


@query(
    "t2_sorted_records",
    _REC
    + f"SELECT {_SHOW} FROM rec",
)
def t2(spark, sf):
    """All records, those without a byte count last."""
    q = SearchQuery((), sort_by="byte_count")
    return search.search(_records(spark, sf), q, _TIES).select(*_SHOWN)


@query(
    "t3_search_page",
    _REC
    + f"""SELECT {_SHOW} FROM (SELECT * FROM rec WHERE type = 'conversation' AND protocol = 'TCP'
  ORDER BY {_ORDER} LIMIT 50 OFFSET 100)""",
)
def t3(spark, sf):
    q = SearchQuery((Criterion("protocol", "eq", "TCP"),), sort_by="byte_count", offset=100, limit=50)
    return search.search(_conversations(spark, sf), q, _TIES).select(*_SHOWN)


@query(
    "t3_page_info",
    _REC
    + """SELECT count(*) AS total_count, least(greatest(count(*) - 100, 0), 50) AS filtered_count, count(*) > 150 AS has_more
FROM rec WHERE type = 'conversation' AND protocol = 'TCP'""",
)
def t3_info(spark, sf):
    q = SearchQuery((Criterion("protocol", "eq", "TCP"),), sort_by="byte_count", offset=100, limit=50)
    return search.page_info(_conversations(spark, sf), q)


@query(
    "t4_suggestions",
    _REC
    + """SELECT DISTINCT dns_query AS suggestion FROM rec WHERE contains(lower(dns_query), 'example.com')
ORDER BY 1 LIMIT 20""",
)
def t4(spark, sf):
    return search.suggestions(_conversations(spark, sf), "dns_query", "EXAMPLE.com")


@query(
    "a27_filter_statistics",
    _REC
    + """SELECT count(*) AS total_records, count(DISTINCT src_ip) AS unique_src, count(DISTINCT dst_ip) AS unique_dst,
  max(packet_count) AS max_packets, max(byte_count) AS max_bytes,
  round(avg(duration) FILTER (duration > 0), 4) AS avg_duration FROM rec""",
)
def a27(spark, sf):
    return rounded(search.statistics(_records(spark, sf)), 4)


def _top_sql(col, text):
    if text:
        src = f"SELECT coalesce({col}, 'unknown') AS value, count(*) AS records FROM rec GROUP BY 1"
    else:
        src = f"SELECT {col}::VARCHAR AS value, count(*) AS records FROM rec WHERE {col} <> 0 GROUP BY 1"
    return f"SELECT value, records, '{col}' AS field FROM ({src}) q_{col} ORDER BY records DESC, value LIMIT 10"


_TOPS = [("protocol", True), ("src_port", False), ("dst_port", False), ("threat_level", True), ("security_category", True)]


@query(
    "a27_filter_top_values",
    _REC + " UNION ALL ".join(f"SELECT * FROM ({_top_sql(c, t)})" for c, t in _TOPS),
)
def a27_tops(spark, sf):
    return search.top_values(_records(spark, sf), [c for c, _ in _TOPS])


@query(
    "a28_grouped_matches",
    _REC + "SELECT coalesce(protocol, 'unknown') AS protocol, count(*) AS matches FROM rec WHERE anomaly_score >= 0 GROUP BY 1",
)
def a28(spark, sf):
    q = SearchQuery((Criterion("anomaly_score", "gte", 0),), group_by="protocol", limit=5)
    return search.grouped(_records(spark, sf), q)
