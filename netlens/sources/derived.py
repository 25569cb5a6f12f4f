"""Packet, report and job tables derived from the driver's ``events`` and ``orders``.

Every event becomes one short session: a 24-row template keyed by event type is
joined to it (a broadcast of a fixed 24 rows).
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (event_type, step, dir, off_ms, proto, srv_port, flags, seq_rel, win,
# size, http_method, http_status, dns_kind).
TEMPLATE_ROWS = """
('view',1,'c',0,'TCP',80,2,0,64240,74,NULL,NULL,NULL),
('view',2,'s',40,'TCP',80,18,0,65535,74,NULL,NULL,NULL),
('view',3,'c',80,'TCP',80,16,1,64240,66,NULL,NULL,NULL),
('view',4,'c',90,'TCP',80,24,1,64240,420,'GET',NULL,NULL),
('view',5,'s',190,'TCP',80,24,1,65535,1480,NULL,200,NULL),
('click',1,'c',0,'TCP',8080,2,0,64240,74,NULL,NULL,NULL),
('click',2,'s',60,'TCP',8080,18,0,65535,74,NULL,NULL,NULL),
('click',3,'c',120,'TCP',8080,16,1,64240,66,NULL,NULL,NULL),
('click',4,'c',130,'TCP',8080,24,1,64240,690,'POST',NULL,NULL),
('click',5,'c',430,'TCP',8080,24,1,64240,690,NULL,NULL,NULL),
('click',6,'s',900,'TCP',8080,24,1,0,310,NULL,404,NULL),
('purchase',1,'c',0,'TCP',443,2,0,64240,74,NULL,NULL,NULL),
('purchase',2,'s',20,'TCP',443,18,0,65535,74,NULL,NULL,NULL),
('purchase',3,'c',45,'TCP',443,16,1,64240,66,NULL,NULL,NULL),
('purchase',4,'c',50,'TCP',443,24,601,64240,1500,NULL,NULL,NULL),
('purchase',5,'c',55,'TCP',443,24,1,64240,1500,NULL,NULL,NULL),
('purchase',6,'s',120,'TCP',443,17,1,65535,66,NULL,NULL,NULL),
('signup',1,'c',0,'UDP',53,NULL,NULL,NULL,78,NULL,NULL,'q'),
('signup',2,'s',35,'UDP',53,NULL,NULL,NULL,142,NULL,NULL,'r'),
('signup',3,'c',40,'UDP',53,NULL,NULL,NULL,78,NULL,NULL,'q'),
('signup',4,'c',45,'UDP',53,NULL,NULL,NULL,78,NULL,NULL,'q'),
('error',1,'c',0,'TCP',-1,2,0,1024,60,NULL,NULL,NULL),
('error',2,'s',5,'TCP',-1,20,0,0,54,NULL,NULL,NULL),
('error',3,'c',900,'ICMP',NULL,NULL,NULL,NULL,120,NULL,NULL,NULL)
""".strip()
TEMPLATE_COLUMNS = (
    "event_type, step, dir, off_ms, proto, srv_port, flags, seq_rel, win, size, "
    "t_method, t_status, dns_kind"
)


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _never_null(text: Column) -> Column:
    """Declare a text that is never NULL as such: grouping keys then need no IS NOT NULL
    filter, which the optimizer would inline into the join below with the whole formula."""
    return F.coalesce(text, F.lit(""))


#: Events of one task at most, about, so that what a task holds does not grow with the table.
TASK_EVENTS = 100_000


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Spread the rows over the session's cores, or more tasks if there are many, by a hash, which
    keeps a recomputed task's rows the same: the test tables are single files."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_EVENTS))
    return df.repartition(tasks, key)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    template = spark.sql(f"SELECT * FROM VALUES {TEMPLATE_ROWS} AS t({TEMPLATE_COLUMNS})")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type"
    )
    e = _spread(events, "event_id").join(F.broadcast(template), "event_type")

    eid, uid = F.col("event_id"), F.col("user_id")
    is_client = F.col("dir") == "c"
    is_udp, is_tcp, is_icmp = (F.col("proto") == p for p in ("UDP", "TCP", "ICMP"))
    is_request = F.col("t_method").isNotNull()
    is_query, is_answer = F.col("dns_kind") == "q", F.col("dns_kind") == "r"

    client_ip = F.when(uid % 10 == 0, _text("93.184.", uid % 200, ".34")).otherwise(
        _text("10.0.", uid % 7, ".", uid % 250 + 1)
    )
    server_ip = F.when(is_udp, F.lit("8.8.8.8")).otherwise(_text("192.168.1.", eid % 20 + 1))
    client_port = F.when(~is_icmp, 20000 + eid % 40000).cast("int")
    server_port = F.when(F.col("srv_port") == -1, 1 + eid % 1000).otherwise(F.col("srv_port")).cast("int")
    uri = (
        F.when(eid % 7 == 0, F.lit("/../../../etc/passwd"))
        .when(eid % 7 == 1, F.lit("/q?s=1 union select 2"))
        .when(eid % 7 == 2, F.lit("/c?t=<script>x</script>"))
        .otherwise(_text("/item/", eid % 50))
    )
    query_name = (
        F.when(eid % 6 == 0, _text("bcdfghjklmnp", eid, ".net"))
        .when(eid % 6 == 1, F.lit("a1b2c3d4e5f6a1b2c3d4e5f6a1b2c3d4.tk"))
        .when(eid % 6 == 2, F.lit("data" * 14 + ".example.com"))
        .when(eid % 6 == 3, _text("10-0-0-", eid % 255, ".pool.example.org"))
        .otherwise(_text("www", eid % 40, ".example.com"))
    )
    upload = (
        F.when(eid % 6 == 0, F.lit("user=a&password=hunter2"))
        .when(eid % 6 == 1, F.lit("data:base64," + "QUJD" * 30))
        .when(eid % 6 == 2, F.lit("x; DROP TABLE users"))
        .otherwise(_text("a=", eid))
    )
    payload = (
        F.when(is_request, _text(F.col("t_method"), " ", uri, " HTTP/1.1"))
        .when(F.col("t_status").isNotNull(), _text("HTTP/1.1 ", F.col("t_status"), " OK"))
        .when((F.col("event_type") == "click") & (F.col("step") == 5), upload)
    )
    seq_base = F.when(is_client, 1000).otherwise(5000)
    ack_base = F.when(is_client, 5001).otherwise(1001)
    micros = F.unix_micros(F.col("ts").cast("timestamp")) + F.col("off_ms") * 1000

    return e.select(
        _never_null(_text("cap", eid % 4)).alias("capture_id"),
        (eid * 10 + F.col("step")).cast("long").alias("frame_number"),
        F.timestamp_micros(micros).alias("ts"),
        F.col("size").cast("long").alias("packet_size"),
        _never_null(F.when(is_client, client_ip).otherwise(server_ip)).alias("src_ip"),
        _never_null(F.when(is_client, server_ip).otherwise(client_ip)).alias("dst_ip"),
        F.col("proto").alias("protocol"),
        F.when(is_tcp, 6).when(is_udp, 17).otherwise(1).alias("ip_proto"),
        F.when(is_client, client_port).otherwise(server_port).alias("src_port"),
        F.when(is_client, server_port).otherwise(client_port).alias("dst_port"),
        F.col("flags").alias("tcp_flags"),
        F.when(is_tcp, seq_base + eid % 500 + F.col("seq_rel")).cast("long").alias("tcp_seq"),
        F.when(F.col("flags") >= 16, ack_base + eid % 500)
        .when(is_tcp, F.lit(0))
        .cast("long")
        .alias("tcp_ack"),
        F.col("win").alias("tcp_window"),
        F.when(is_udp, F.col("size") - 34).alias("udp_length"),
        F.lit(None).cast("int").alias("icmp_type"),
        F.lit(None).cast("int").alias("icmp_code"),
        F.col("t_method").alias("http_method"),
        F.when(is_request, _text("site", eid % 30, ".example.com")).alias("http_host"),
        F.when(is_request, uri).alias("http_uri"),
        F.col("t_status").alias("http_status"),
        F.when(is_udp, (eid * 7 + F.when(F.col("step") >= 3, 1).otherwise(0)) % 65536)
        .cast("int")
        .alias("dns_id"),
        F.when(is_query, 0).when(is_answer, 1).alias("dns_qr"),
        F.when(is_query, query_name).alias("dns_query"),
        F.when(is_answer, F.lit("93.184.216.34")).alias("dns_response"),
        F.when(is_query, F.when(eid % 3 == 0, F.lit("AAAA")).otherwise("A")).alias("dns_type"),
        F.when(is_answer, F.when(eid % 5 == 0, 3).otherwise(0)).alias("dns_rcode"),
        F.when(
            (F.col("event_type") == "purchase") & (F.col("step") == 4),
            F.when(eid % 4 == 0, 769).otherwise(771),
        ).alias("tls_version"),
        F.lit(None).cast("int").alias("tls_cipher"),
        payload.alias("payload"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = F.col("o_orderkey")
    job = F.when(key % 20 < 4, key - key % 4).otherwise(key)
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit("completed"))
        .when(F.col("o_orderstatus") == "O", F.lit("processing"))
        .when(key % 3 == 0, F.lit("pending"))
        .when(key % 3 == 1, F.lit("failed"))
        .otherwise("cancelled")
    )
    return (
        spark.read.parquet(f"{sf_dir}/orders.parquet")
        .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
        .withColumn("status", status)
        .select(
            key.alias("report_id"),
            _text("job", job).alias("job_id"),
            _text("cap_", key, ".pcap").alias("original_filename"),
            _text("h", F.col("o_custkey")).alias("file_hash"),
            F.floor("o_totalprice").cast("long").alias("file_size"),
            "status",
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.when(F.col("status") == "completed", key % 300).alias("processing_time"),
            (key % 5000).alias("total_packets"),
        )
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("status") == "completed"
    running = F.col("status") == "processing"
    return (
        reports(spark, sf_dir)
        .where(F.col("report_id") % 10 != 0)
        .select(
            "report_id",
            "job_id",
            F.when(done, F.lit("success"))
            .when(running, F.lit("started"))
            .otherwise("failure")
            .alias("status"),
            F.when(done, 100).when(running, 50).otherwise(0).alias("progress"),
            F.col("created_at").alias("started_at"),
            F.timestamp_micros(
                F.unix_micros("created_at") + F.col("processing_time") * 1_000_000
            ).alias("completed_at"),
        )
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and page texts as file contents: (path, content BINARY)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        _text("doc/", F.col("doc_id")).alias("path"), F.col("text").cast("binary").alias("content")
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        _text("page/", F.col("page_id")).alias("path"), F.col("html").cast("binary").alias("content")
    )
    return docs.unionByName(pages)
