import datetime as dt
import random

import duckdb
import pandas as pd
import pytest

from reqwatch.plans.registry import ORACLES, QUERIES
from reqwatch.sources import adapters
from reqwatch.streaming import state

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    found = duck.execute(ORACLES[name])
    own = [d[0] for d in found.description]
    assert sorted(own) == names
    assert got == sorted(repr([plain(row[own.index(n)]) for n in names]) for row in found.fetchall())


def test_stream_equals_batch(spark, sf_dir):
    """The same address, label and second of each window."""
    logs = adapters.threat_logs(spark, sf_dir).selectExpr("id", "unix_timestamp(created_at) AS sec")
    seconds = lambda df: sorted(map(tuple, df.join(logs, "id").select("ip_address", "type", "sec").collect()))
    assert seconds(QUERIES["stream_dedup"](spark, sf_dir)) == seconds(QUERIES["dedup_window"](spark, sf_dir))


@pytest.mark.parametrize("name", ["normalize_pages", "request_pipeline", "request_alerts"])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_stream_rows_and_sink(spark, sf_dir):
    out = QUERIES["stream_dedup"](spark, sf_dir)
    assert all("/rows/" in f for f in out.inputFiles()) and out.inputFiles()  # written, not held on the driver
    got, batch = {(r.ip_address, r.type, r.created_at.replace(microsecond=0)) for r in out.collect()}, QUERIES["dedup_window"](spark, sf_dir)
    assert len(got) == batch.count()


def test_first_row_of_each_second():
    at = pd.to_datetime(["2024-01-01 00:00:01.5", "2024-01-01 00:00:00.9", "2024-01-01 00:00:00.2", "2024-01-01 00:00:01.5", "2024-01-01 00:00:00.2"])
    pdf = pd.DataFrame({"id": [9, 1, 5, 3, 4], "type": "x", "micros": at.astype("datetime64[us]").astype("int64")})
    assert state.firsts(pdf)["id"].tolist() == [4, 3]
    parts = state.firsts(pd.concat([state.firsts(pdf[:3]), state.firsts(pdf[3:])]))
    assert parts["id"].tolist() == [4, 3]
    assert state.firsts(pdf.assign(type=["x", "x", "y", "y", "x"]))["id"].tolist() == [4, 5, 3, 9]


class Store:
    """A map state and timers that count what is asked of them."""

    def __init__(self):
        self.held, self.timers, self.asked = {}, set(), 0

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.asked += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.asked += 1
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def iterator(self):
        return iter(self.held.items())

    def registerTimer(self, at):
        self.asked += 1
        self.timers.add(at)


class Watermark:
    def __init__(self, seconds):
        self.seconds = seconds

    def getCurrentWatermarkInMs(self):
        return self.seconds * 1000


def test_marks_are_asked_for_by_address_and_not_by_row():
    rows = random.Random(4)
    made = [(k, f"10.0.0.{rows.randrange(9)}", rows.choice("xyz"), rows.randrange(4000) * 1_000_000 + k) for k in range(3000)]
    pdf = pd.DataFrame(made, columns=["id", "ip_address", "type", "micros"])
    store, own = Store(), state.Marks(60, ("id",), ["id", "micros"])
    own.init(store)
    kept = []
    for low in (0, 1000, 2000, 3000):
        part = pdf[(pdf["micros"] // 1_000_000).between(low, low + 999)]
        kept += [i for out in own.handleInputRows((0,), iter([part[:70], part[:0], part[70:]]), Watermark(low)) for i in out["id"]]
        assert list(own.handleInputRows((0,), iter([part[:0]]), Watermark(low))) == []
    want, last = [], {}
    for k, ip, kind, micros in sorted(made, key=lambda r: (r[3] // 1_000_000, r[3])):
        if micros // 1_000_000 >= last.get((ip, kind), -60) + 60:
            last[ip, kind] = micros // 1_000_000
            want.append(k)
    assert sorted(kept) == sorted(want) and len(kept) > 1000
    assert store.asked <= 4 * (2 * 9 + 1)  # once for each row kept before
    assert {(ip, kind): sec for (ip,), held in store.held.items() for kind, sec in zip(*held, strict=True)} == last
    assert max(store.timers) >= (max(last.values()) + 60) * 1000
    own.handleExpiredTimer((0,), Watermark(sorted(last.values())[5] + 60), None)
    assert sum(len(kinds) for kinds, _ in store.held.values()) == len([s for s in last.values() if s > sorted(last.values())[5]])
    own.handleExpiredTimer((0,), Watermark(max(store.timers) // 1000), None)
    assert store.held == {}


def test_events_of_each_second():
    at = pd.to_datetime(["2024-01-01 00:00:01.5", "2024-01-01 00:00:00.9", "2024-01-01 00:00:01.0"])
    micros = at.astype("datetime64[us]").astype("int64")
    n = state.per_second(pd.DataFrame({"micros": micros}))
    n = state.per_second(pd.DataFrame({"micros": micros[:1]}), n).sort_index()
    assert n.tolist() == [1, 3] and n.index.tolist() == [1704067200, 1704067201]


def stream_of(spark, folder, rows):
    """rows in files of their own, one micro-batch each."""
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "id long, ip_address string, type string, created_at timestamp").coalesce(1).write.parquet(f"{folder}/in/part={k}")
    kind = "id long, ip_address string, type string, created_at timestamp, part int"
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").drop("part")


def landed(stream, folder, name):
    stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")


def test_windows_over_micro_batches(spark, tmp_path):
    """State carries a window from one micro-batch to the next; rows without a time or a key are in no window."""
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    rows = [(1, "a", "x", at(0)), (2, "a", "x", at(10)), (3, "a", "x", at(59)), (4, "a", "x", at(61)), (5, None, "x", at(62)), (6, "a", "x", None), (7, "a", None, at(63)), (8, "b", "x", at(64)), (9, "a", "x", at(122))]
    stream = stream_of(spark, tmp_path, rows)
    assert sorted(r.id for r in landed(state.deduplicated(stream, 60, "1 hour"), tmp_path, "kept").collect()) == [1, 4, 8, 9]
    floods = landed(state.flood_alerts(stream, 2, 60, "1 hour"), tmp_path, "floods").collect()
    assert [(r.ip_address, r.started.second, r.requests) for r in floods] == [("a", 0, 3)]


def test_log_sink(spark, tmp_path):
    """Every micro-batch is in the log once, and the callback gets its rows; a batch that comes again replaces itself."""
    rows, got = [(k, "a", "x", dt.datetime(2024, 1, 1, 0, k)) for k in range(3)], []
    out = state.to_log(stream_of(spark, tmp_path, rows), f"{tmp_path}/log", f"{tmp_path}/state", lambda batch, number: got.append((number, [r.id for r in batch.collect()])))
    out.trigger(availableNow=True).start().awaitTermination()
    assert sorted(i for _, ids in got for i in ids) == [0, 1, 2] and [n for n, _ in got] == [0, 1, 2]
    for _ in range(2):
        state.append(spark.createDataFrame([(9, "a")], "id long, ip_address string"), f"{tmp_path}/log", 3)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [0, 1, 2, 9]
