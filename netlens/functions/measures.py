"""Rates, ratings and labels computed from already aggregated numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity order and risk weight.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITY_SCORE = {"low": 0.1, "medium": 0.2, "high": 0.3, "critical": 0.4}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(n, d, default: float = 0.0) -> Column:
    """n / d, or the default where d is not positive."""
    return F.when(_col(d) > 0, _col(n) / _col(d)).otherwise(F.lit(default))


def seconds(us) -> Column:
    return _col(us) / F.lit(1e6)


def per_second(n, us) -> Column:
    """A count over a span in microseconds; 0 when the span is 0."""
    return F.when(_col(us) > 0, _col(n) * F.lit(1e6) / _col(us)).otherwise(F.lit(0.0))


def asymmetry(client_bytes, total_bytes) -> Column:
    return ratio(client_bytes, total_bytes, 0.5)


def interactive(packets, forward, backward) -> Column:
    return (_col(packets) >= 4) & (_col(forward) > 0) & (_col(backward) > 0)


def tcp_state(syn, syn_ack, ack, rst, fin) -> Column:
    syn, syn_ack, ack, rst, fin = map(_col, (syn, syn_ack, ack, rst, fin))
    return (
        F.when((syn > 0) & (syn_ack > 0) & (ack > 0), F.lit("established"))
        .when((syn > 0) & (syn_ack == 0), F.lit("syn_sent"))
        .when(rst > 0, F.lit("reset"))
        .when(fin > 0, F.lit("closed"))
        .otherwise("unknown")
    )


def quality_score(retransmission_rate, avg_rtt, out_of_order, zero_window) -> Column:
    rate, rtt = _col(retransmission_rate), F.coalesce(_col(avg_rtt), F.lit(0.0))
    loss = F.when(rate > 0.05, 30).when(rate > 0.01, 15).otherwise(0)
    delay = F.when(rtt > 0.5, 25).when(rtt > 0.1, 10).otherwise(0)
    disorder = F.least(F.lit(20), _col(out_of_order) * 2)
    stalls = F.least(F.lit(15), _col(zero_window) * 3)
    return (F.lit(100) - loss - delay - disorder - stalls).cast("long")


def quality_label(score) -> Column:
    score = _col(score)
    return (
        F.when(score >= 90, F.lit("excellent"))
        .when(score >= 75, F.lit("good"))
        .when(score >= 60, F.lit("fair"))
        .otherwise("poor")
    )


def congested(retransmission_rate, zero_window, out_of_order, packets) -> Column:
    return (
        (_col(retransmission_rate) > 0.02)
        | (_col(zero_window) > 0)
        | (_col(out_of_order) * 100 > _col(packets))
    )


def _lookup(table: dict, key, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(_col(key))), F.lit(default))


def severity_rank(severity) -> Column:
    return _lookup(SEVERITY_RANK, severity, 0)


def severity_score(severity) -> Column:
    return _lookup(SEVERITY_SCORE, severity, 0.0)


def severity_of_rank(rank) -> Column:
    names = {v: k for k, v in SEVERITY_RANK.items()}
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.try_element_at(pairs, _col(rank))


def _tenths(scaled: Column, unit: Column, half_even: bool) -> Column:
    """scaled / unit as text with one decimal, in exact integer arithmetic."""
    q = F.floor(scaled * 10 / unit)
    q = q - F.when(q * unit > scaled * 10, 1).otherwise(0)
    r2 = (scaled * 10 - q * unit) * 2
    tie = (q % 2 == 1) if half_even else F.lit(True)
    up = (r2 > unit) | ((r2 == unit) & tie)
    t = (q + F.when(up, 1).otherwise(0)).cast("long")
    return F.concat_ws(".", F.floor(t / 10).cast("string"), (t % 10).cast("string"))


def human_size(n) -> Column:
    """Bytes as text with one decimal, in the largest of B, KB, MB, GB, TB below 1024."""
    n = _col(n).cast("long")
    out = None
    for power, unit in enumerate(("B", "KB", "MB", "GB")):
        text = F.concat_ws(" ", _tenths(n, F.lit(1024**power), True), F.lit(unit))
        limit = n < 1024 ** (power + 1)
        out = F.when(limit, text) if out is None else out.when(limit, text)
    return out.otherwise(F.concat_ws(" ", _tenths(n, F.lit(1024**4), True), F.lit("TB")))


def human_duration(ms) -> Column:
    """Milliseconds as ``x.y seconds``, ``minutes`` or ``hours``."""
    ms = _col(ms).cast("long")
    return (
        F.when(ms < 60_000, F.concat_ws(" ", _tenths(ms, F.lit(1000), False), F.lit("seconds")))
        .when(
            ms < 3_600_000, F.concat_ws(" ", _tenths(ms, F.lit(60_000), False), F.lit("minutes"))
        )
        .otherwise(F.concat_ws(" ", _tenths(ms, F.lit(3_600_000), False), F.lit("hours")))
    )
