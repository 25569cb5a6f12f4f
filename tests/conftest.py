import datetime
import itertools

import pytest

from netlens.schema import PACKETS
from tests.session import make_session

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


@pytest.fixture(scope="session")
def spark():
    return make_session()


@pytest.fixture
def packets(spark):
    """Build a packets table from short dicts; `at` is seconds after T0."""

    def build(*rows):
        number = itertools.count(1)
        full = []
        for r in rows:
            r = dict(r)
            at = r.pop("at", 0.0)
            base = {f.name: None for f in PACKETS.fields} | {
                "capture_id": "c",
                "frame_number": next(number),
                "ts": T0 + datetime.timedelta(microseconds=round(at * 1e6)),
                "packet_size": 60,
                "src_ip": "10.0.0.1",
                "dst_ip": "10.0.0.2",
                "protocol": "TCP",
                "ip_proto": 6,
            }
            if isinstance(r.get("payload"), str):
                r["payload"] = r["payload"].encode()
            full.append(base | r)
        return spark.createDataFrame([tuple(r[f.name] for f in PACKETS.fields) for r in full], PACKETS)

    return build


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict(recursive=True)
