"""The log's windows over streams: event-time de-duplication and flood counting with per-key state.

State per key is two numbers, or a number for each type of an address, and it expires by event time once its window is
over, so it does not grow with the stream.  State functions see times as microseconds since 1970 in UTC, whatever zone
the session has.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.suppress import windowed

FLOOD_SCHEMA = "ip_address string, started long, requests long"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def firsts(pdf: pd.DataFrame, order: tuple[str, ...] = ("id",), keys: tuple[str, ...] = ("type",)) -> pd.DataFrame:
    """The first row of each second of the keys, in order of time, with sec.  micros: microseconds since 1970."""
    return pdf.assign(sec=pdf["micros"] // 1_000_000).sort_values(["micros", *order]).drop_duplicates([*keys, "sec"])


def per_second(pdf: pd.DataFrame, held: pd.Series | None = None) -> pd.Series:
    """Events of each second, added to those held."""
    n = (pdf["micros"] // 1_000_000).value_counts()
    return n if held is None else held.add(n, fill_value=0)


KEYS = ("ip_address", "type")


class Marks(StatefulProcessor):
    """Of a part of the addresses: the second at which each type of an address was last let through.

    An address's marks are read and written once a micro-batch, and all of a part's rows go through the windows at once, so
    the work in Python is by address and part, not by row.  A timer takes a part's marks away once their windows are over.
    A mark is part of its micro-batch: a batch whose write fails is run again from the marks that held before it, so what
    was not written mutes nothing.
    """

    def __init__(self, window_s: int, order: tuple[str, ...], columns: list[str]):
        self.window_s, self.order, self.columns = window_s, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.marks = handle, handle.getMapState("marks", "ip_address string", "types array<string>, secs array<long>")

    def live(self, held: tuple | None, over: int) -> dict[str, int]:
        """Marks whose window is not over."""
        return {kind: sec for kind, sec in zip(*(held or ((), ())), strict=True) if (sec + self.window_s) * 1000 > over}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf, over = None, timerValues.getCurrentWatermarkInMs()
        for batch in rows:  # one row a type and second is held, so a hot address grows with its seconds and not with its rows
            if len(batch):
                pdf = firsts(batch if pdf is None else pd.concat([pdf, batch]), self.order, KEYS)
        if pdf is None:
            return
        held = {ip: self.live(self.marks.getValue((ip,)), over) for ip in pdf["ip_address"].unique()}
        free = [sec >= held[ip].get(kind, sec - self.window_s) + self.window_s for ip, kind, sec in zip(pdf["ip_address"], pdf["type"], pdf["sec"], strict=True)]
        pdf = pdf[free].sort_values([*KEYS, "sec"])
        if pdf.empty:
            return
        kept = pd.concat(windowed(iter([pdf.assign(n=1)]), [*KEYS], self.window_s)).query("opened")
        changed = set()
        for ip, kind, sec in zip(kept["ip_address"], kept["type"], kept["sec"].tolist(), strict=True):  # in order: the last one stands
            held[ip][kind] = sec
            changed.add(ip)
        for ip in changed:
            self.marks.updateValue((ip,), ([*held[ip]], [*held[ip].values()]))
        # at a multiple of the window, so a part has few timers
        self.handle.registerTimer(max((int(kept["sec"].max()) // self.window_s + 2) * self.window_s * 1000, over + 1))
        yield kept[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = timerValues.getCurrentWatermarkInMs()
        for (ip,), held in list(self.marks.iterator()):
            left = self.live(held, over)
            if not left:
                self.marks.removeKey((ip,))
            elif len(left) < len(held[0]):
                self.marks.updateValue((ip,), ([*left], [*left.values()]))
        return iter([])

    def close(self) -> None:
        pass


def deduplicated(rows: DataFrame, window_s: int = 300, watermark: str = "10 minutes", order: tuple[str, ...] = ("id",), parts: int = 4096) -> DataFrame:
    """The stream's rows (ip_address, type, created_at, ...) that are first in their key's anchored window.

    Of an address's and type's rows in one second the first by time and order stands.  Rows without a time or without a
    part of the key go, as in suppress.first_in_window.  Addresses are dealt to so many parts by hash, the groups that the
    state functions see; a part's rows of a micro-batch are held at once, one row a second and key.  The state has maps
    and timers, which only the RocksDB store offers: the session is set to it.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    timed = rows.dropna(subset=[*KEYS, "created_at"]).withColumn("micros", F.unix_micros("created_at")).withWatermark("created_at", watermark)
    out = T.StructType([*(f for f in rows.schema if f.name != "created_at"), T.StructField("micros", T.LongType())])
    dealt = timed.withColumn("address_part", F.pmod(F.xxhash64("ip_address"), F.lit(parts)))
    kept = dealt.groupBy("address_part").transformWithStateInPandas(Marks(window_s, order, out.names), out, "Append", "EventTime")
    return kept.withColumn("created_at", F.timestamp_micros("micros")).select(rows.columns)


def flood_alerts(rows: DataFrame, threshold: int = 300, window_s: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """(ip_address, started, requests) once for each window of an address that goes beyond the threshold.

    requests: the count that does so.  Rows without a time or an address are in no window.  A batch's rows are counted by
    second as they come, so a hot address grows with its seconds and not with its requests.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        seconds = None
        for batch in batches:
            seconds = per_second(batch, seconds)
        out = []
        for sec, more in seconds.sort_index().astype("int64").items():
            if start is None or sec >= start + window_s:
                start, n = int(sec), 0
            if n <= threshold < n + more:
                out.append((key[0], start, threshold + 1))
            n += int(more)
        state.update((int(start), int(n)))
        state.setTimeoutTimestamp(max((start + window_s) * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["ip_address", "started", "requests"])

    timed = rows.select("ip_address", "created_at", F.unix_micros("created_at").alias("micros")).dropna().withWatermark("created_at", watermark)
    out = timed.groupBy("ip_address").applyInPandasWithState(step, FLOOD_SCHEMA, "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("started", F.timestamp_seconds("started"))


def windowed_counts(rows: DataFrame, width: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Log rows per event-time window and level, once the watermark has passed the window's end.  Rows without a time go."""
    window = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    out = rows.withWatermark("created_at", watermark).groupBy(window.alias("w"), "threat_level").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "threat_level", "n")


def append(batch: DataFrame, path: str, number: int) -> None:
    """Writes a batch's rows to the log at path, under its number: all of them or none, and a repeated batch replaces itself."""
    batch.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={number}")


def with_tries(write, waits: tuple[float, ...] = (10, 30), sleep=time.sleep) -> Exception | None:
    """Calls write until it does not fail, once more after each of the waits (seconds); the last failure, if all failed."""
    for wait in (*waits, None):
        try:
            write()
        except Exception as error:  # whatever the store said: the next try may be luckier
            if wait is None:
                return error
            sleep(wait)
        else:
            return None
    return None


def to_log(stream: DataFrame, path: str, checkpoint: str, callback=None, write=append, waits: tuple[float, ...] = (10, 30), failed: str | None = None, sleep=time.sleep):
    """Appends each micro-batch to the log at path, then gives it to callback(batch, number), such as an alert sender.

    A write that fails is tried again after each of the waits.  If it fails for good, the batch's rows go to the table
    at `failed`, by number and with what was said, no callback hears of them and the stream goes on; without such a
    table the stream stops there, and runs the batch again when it is started anew.  The callback gets what was written,
    read back, so the stream's work is done once.  The log has a column batch.
    """
    kind = stream.drop("batch").schema

    def sink(batch: DataFrame, number: int) -> None:
        error = with_tries(lambda: write(batch, path, number), waits, sleep)
        if error is not None:
            if failed is None:
                raise error
            append(batch.withColumn("error", F.lit(str(error)[:500])), failed, number)
        elif callback is not None:
            callback(batch.sparkSession.read.schema(kind).parquet(f"{path}/batch={number}"), number)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append")
