"""Requests and responses paired on a stream, and a connection table whose state falls back.

Both keep Python state per group (``transformWithStateInPandas``), which needs the RocksDB store:
``stateful_session`` gives a session with it. Messages wait until the watermark has passed them and
are then taken in order of time and frame, so results do not depend on how a feed was cut into
micro-batches; what is later than the watermark is dropped and counted (``live.LateRows``). Every
entry has an event-time timer that takes it out again. A call into the state costs far more than a
row, so pairing keeps its state per bucket of connections, not per connection."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from netlens.functions import net
from netlens.operators import dns, http
from netlens.streaming.live import LATENESS

TIMEOUT_US = 30_000_000
TTL_US = 300_000_000

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Connections are dealt over so many groups of state, and messages are kept in parts of so many.
BUCKETS, _PART = 512, 1 << 14
_TABLE = "messages binary"
#: Stands for a missing port or frame number inside the processors.
_NONE = -1
_KEY = "capture_id string, client_ip string, client_port int, server_ip string, server_port int"
_PAIR = "first_frame bigint, first_us bigint, first string, second_frame bigint, second_us bigint, second string"
_CONNECTION = [c.split()[0] for c in _KEY.split(", ")]
_OUT = [c.split()[0] for c in f"{_KEY}, {_PAIR}".split(", ")]
_MESSAGE = [*_CONNECTION, "frame_number", "us", "opens", "detail"]
_TYPES = {"client_port": "int32", "server_port": "int32", "frame_number": "int64", "us": "int64", "opens": "bool"}
_ARROW = pa.schema(
    [(c, {"int32": pa.int32(), "int64": pa.int64(), "bool": pa.bool_()}.get(_TYPES.get(c), pa.string())) for c in _MESSAGE]
)


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB."""
    session = spark.newSession()
    session.conf.set(_PROVIDER, _ROCKSDB)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return session


class Pairing(StatefulProcessor):
    """Pairs of the connections of a bucket: a closing message belongs to the opening message right
    before it on its connection.

    A newer opening message replaces an unanswered one, and a second closing message finds none. An
    opening message unanswered for ``timeout_us`` leaves; with ``report`` it then comes out alone.

    A bucket's messages are paired as columns, and its state is two tables: parts of what waits for
    the watermark, and the opening messages left unanswered. One timer stands for the first of them
    that comes due; it sets the next one."""

    def __init__(self, timeout_us: int, report: bool):
        self.timeout_us, self.report = timeout_us, report

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _TABLE)
        self.unanswered = handle.getValueState("unanswered", _TABLE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part[_MESSAGE].astype(_TYPES)
            self.waiting.appendList([(_packed(part.iloc[lo : lo + _PART]),) for lo in range(0, len(part), _PART)])
            first = min(part["us"].min(), first if first is not None else part["us"].min())
        self.handle.registerTimer(int(first) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [_unpacked(p[0]) for p in self.waiting.get()]
        waiting = pd.concat(parts, ignore_index=True) if parts else _unpacked(None)
        due = waiting["us"] < passed_us
        later = waiting[~due]
        if due.any():
            self.waiting.clear()
            if len(later):
                self.waiting.put([(_packed(later.iloc[lo : lo + _PART]),) for lo in range(0, len(later), _PART)])
        before = _unpacked(self.unanswered.get()[0] if self.unanswered.exists() else None)
        out, pending = self._paired(before, waiting[due], passed_us)
        if len(pending):
            self.unanswered.update((_packed(pending),))
        elif len(before):
            self.unanswered.clear()
        ends = [int(later["us"].min()) // 1000 + 1] if len(later) else []
        ends += [(int(pending["us"].min()) + self.timeout_us) // 1000 + 2] if len(pending) else []
        if ends:
            self.handle.registerTimer(min(ends))
        if len(out):
            yield out

    def _paired(self, before: pd.DataFrame, due: pd.DataFrame, passed_us: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Pairs, and the opening messages that are still unanswered; ``before`` has those of earlier
        times, one at most of each connection."""
        now = pd.concat([before.assign(new=False), due.assign(new=True)], ignore_index=True)
        conn = now.groupby(_CONNECTION, dropna=False, sort=False).ngroup().to_numpy()
        order = np.lexsort((now["frame_number"].to_numpy(), now["us"].to_numpy(), now["new"].to_numpy(), conn))
        now, conn = now.iloc[order].reset_index(drop=True), conn[order]
        us, opens = now["us"].to_numpy(), now["opens"].to_numpy(bool)
        ends = np.append(conn[1:] != conn[:-1], True) if len(now) else np.zeros(0, bool)
        after = np.append(us[1:], 0) if len(now) else us
        late = opens & (np.where(ends, passed_us, after) - us > self.timeout_us)
        met = np.flatnonzero(opens & ~ends & ~late & ~np.append(opens[1:], True)) if len(now) else np.zeros(0, np.int64)
        alone = np.flatnonzero(late) if self.report else np.zeros(0, np.int64)
        second = now.iloc[met + 1].reset_index(drop=True)
        first = now.iloc[np.concatenate([met, alone])].reset_index(drop=True)
        out = first[_CONNECTION].copy()
        for name, column in (("frame", "frame_number"), ("us", "us")):
            out[f"first_{name}"] = first[column]
            out[f"second_{name}"] = second[column].astype("Int64").reindex(first.index)
        out["first"], out["second"] = first["detail"], second["detail"].reindex(first.index)
        out["second"] = out["second"].where(out["second"].notna(), None)
        return out[_OUT], now[opens & ends & ~late][_MESSAGE]

    def close(self) -> None:
        pass


def _packed(messages: pd.DataFrame) -> bytes:
    """The messages as one Arrow record batch."""
    batch = pa.RecordBatch.from_arrays([pa.array(messages[f.name], f.type, from_pandas=True) for f in _ARROW], schema=_ARROW)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ARROW) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes | None) -> pd.DataFrame:
    table = _ARROW.empty_table() if packed is None else pa.ipc.open_stream(bytes(packed)).read_all()
    return table.to_pandas().astype(_TYPES)


def _pairs(messages: DataFrame, opens: str, detail: list[str], lateness: str, timeout_us: int, report: bool) -> DataFrame:
    """Pairs of a stream of ``http.messages`` or ``dns.messages``; details travel as JSON, so that
    nulls of any type survive pandas. Messages without a time are left out."""
    known = lambda c: F.coalesce(F.col(c), F.lit(_NONE)).alias(c)
    keyed = messages.where("us IS NOT NULL").select(
        "capture_id", "client_ip", known("client_port"), "server_ip", known("server_port"), known("frame_number"), "us",
        F.col(opens).alias("opens"), F.to_json(F.struct(*detail)).alias("detail"), F.timestamp_micros("us").alias("ts"),
    ).withWatermark("ts", lateness)
    bucket = F.pmod(F.xxhash64(*http.CONNECTION), F.lit(BUCKETS)).cast("int")
    paired = keyed.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(Pairing(timeout_us, report), f"{_KEY}, {_PAIR}", "Append", "EventTime")
    schema = messages.select(*detail).schema
    numbers = {c: F.nullif(F.col(c), F.lit(_NONE)) for c in ("client_port", "server_port", "first_frame", "second_frame")}
    timed = paired.withColumn("answered", F.col("second_us").isNotNull())
    return timed.withColumns(numbers | {"first": F.from_json("first", schema), "second": F.from_json("second", schema)})


def http_transactions(packets: DataFrame, lateness: str = LATENESS, timeout_us: int = TIMEOUT_US) -> DataFrame:
    """``http.transactions`` of a stream of packets: requests with the response that follows within
    the timeout. A bucket's messages of the lateness have to fit a task's memory."""
    detail = ["packet_size", "http_method", "http_host", "http_uri", "http_status"]
    return _pairs(http.messages(packets), "is_request", detail, lateness, timeout_us, False).select(
        *http.CONNECTION,
        F.col("first_frame").alias("request_frame"),
        F.col("second_frame").alias("response_frame"),
        F.col("first.http_method").alias("method"),
        F.col("first.http_host").alias("host"),
        F.col("first.http_uri").alias("uri"),
        F.col("second.http_status").alias("status"),
        F.col("first.packet_size").alias("request_size"),
        F.col("second.packet_size").alias("response_size"),
        (F.col("second_us") - F.col("first_us")).alias("response_us"),
    )


def dns_transactions(packets: DataFrame, lateness: str = LATENESS, timeout_us: int = TIMEOUT_US) -> DataFrame:
    """``dns.transactions`` of a stream of packets: answered queries, and TIMEOUT for a query that
    nothing followed within the timeout."""
    detail = ["dns_query", "dns_type", "dns_response", "dns_rcode"]
    return _pairs(dns.messages(packets), "is_query", detail, lateness, timeout_us, True).select(
        *dns.CONNECTION,
        F.col("first_frame").alias("query_frame"),
        F.col("first_us").alias("query_us"),
        F.col("first.dns_query").alias("domain"),
        F.col("first.dns_type").alias("query_type"),
        F.col("second.dns_response").alias("answer"),
        F.col("second.dns_rcode").alias("rcode"),
        F.when(F.col("answered"), "NOERROR").otherwise("TIMEOUT").alias("outcome"),
        (F.col("second_us") - F.col("first_us")).alias("response_us"),
    )


class Connections(StatefulProcessor):
    """First seen, last seen, packets and bytes of a pair, until it has been silent for the TTL."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first_us bigint, last_us bigint, packets bigint, bytes bigint")

    def _row(self, key, now: tuple, closed: bool) -> pd.DataFrame:
        return pd.DataFrame([(*key, *now, closed)], columns=["feed", "src_ip", "dst_ip", "first_seen_us", "last_seen_us", "packets", "bytes", "closed"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.seen.get()) if self.seen.exists() else None
        parts = [(p["us"].to_numpy(), p["size"].fillna(0).to_numpy(np.int64)) for p in rows]
        us, size = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(us, kind="stable")
        us, size = us[order], size[order]
        now = before
        cuts = np.flatnonzero(np.diff(us) > self.ttl_us) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(us)], strict=True):
            made = (int(us[lo]), int(us[hi - 1]), int(hi - lo), int(size[lo:hi].sum()))
            if now is not None and made[0] - now[1] > self.ttl_us:
                yield self._row(key, now, True)
                now = None
            now = made if now is None else (min(now[0], made[0]), max(now[1], made[1]), now[2] + made[2], now[3] + made[3])
        self.seen.update(now)
        if before is None or now[1] > before[1]:
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            self.handle.registerTimer(self._ends(now))
        yield self._row(key, now, False)

    def _ends(self, now: tuple) -> int:
        return (now[1] + self.ttl_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            now = tuple(self.seen.get())
            self.seen.clear()
            yield self._row(key, now, True)

    def close(self) -> None:
        pass


def connections(feed: DataFrame, ttl_us: int = TTL_US) -> DataFrame:
    """The live connection table of a feed with event time and watermark (``live.with_event_time``),
    in update mode: a row for every pair that a batch changes, and a last one (``closed``) when the
    watermark finds the pair silent for the TTL, which takes it out of the state, or when it comes
    back after a longer silence and starts anew."""
    keyed = feed.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("feed", "src_ip", "dst_ip")], "ts", net.us("ts").alias("us"), "size")
    schema = "feed string, src_ip string, dst_ip string, first_seen_us bigint, last_seen_us bigint, packets bigint, bytes bigint, closed boolean"
    table = keyed.groupBy("feed", "src_ip", "dst_ip").transformWithStateInPandas(Connections(ttl_us), schema, "Update", "EventTime")
    return table.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("feed", "src_ip", "dst_ip")})
