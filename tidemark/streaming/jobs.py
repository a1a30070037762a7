"""Structured Streaming jobs around the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.graph import upsert_edges

#: What makes an edge one edge, and into how many parts each relation of the sink is cut by it.
EDGE, PARTS = ["source_kind", "source_key", "relation", "target_kind", "target_key"], 64


def usage_windows(log: DataFrame, size: str, limit: int, late: str | None = None) -> DataFrame:
    """(key, start, n, over): calls of (key, ts) by tumbling window, batch or stream (STR-03)."""
    source = log.withWatermark("ts", late) if late else log
    n = source.groupBy("key", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"))
    return n.select("key", F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("over"))


def _there(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def touched(sink: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of the sink in the partitions that a batch has rows for: at most relations times ``PARTS`` of them, named in the filter, so that no other is read."""
    named = batch.select("relation", "part").distinct().collect()
    by: dict[str, list[int]] = {}
    for r in named:
        by.setdefault(r.relation, []).append(r.part)
    condition = F.lit(False)
    for relation, parts in sorted(by.items()):
        condition = condition | ((F.col("relation") == relation) & F.col("part").isin(sorted(parts)))
    return sink.where(condition)


def add_edges(batch: DataFrame, path: str, number: int, parts: int = PARTS) -> int:
    """Adds the edges that aren't there to the sink under ``path``; gives how many partitions it compared with, -1 for a batch that the ledger has (STR-01).

    The sink is partitioned by relation and by a hash of the edge's identity. A batch number goes into the ledger once it is written; a batch
    that broke off before that is written anew, without what it left behind.
    """
    spark, ledger = batch.sparkSession, f"{path}/_ledger/{number}"
    if _there(spark, ledger):
        return -1
    new = batch.withColumn("part", F.pmod(F.xxhash64(*EDGE), F.lit(parts)).cast("int")).persist()
    try:
        compared, rows = 0, new
        if _there(spark, f"{path}/_SUCCESS"):
            there = touched(spark.read.parquet(path), new)
            compared = new.select("relation", "part").distinct().count()
            rows = new.join(there.select(*EDGE), EDGE, "left_anti")
        rows.write.mode("append").partitionBy("relation", "part").parquet(path)
    finally:
        new.unpersist()
    p = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    return compared


def ingest(documents: DataFrame, path: str, project: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """New documents to edges under ``path``, idempotent by edge identity (STR-01). Other partitions than those of a batch's edges are never read."""

    def each(batch: DataFrame, number: int) -> None:
        add_edges(upsert_edges(project(batch.dropDuplicates(["canonical_id"]))), path, number)

    return documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stateful(rows: DataFrame) -> None:
    """State with timers asks for this store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class Once(StatefulProcessor):
    """The first row of each id; the id is forgotten ``keep`` milliseconds of event time after its last row."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "company", "statement"], kind="stable")
        last = _ms(frame["ts"].iloc[-1]) + self.keep
        known = self.until.get()[0] if self.until.exists() else None
        if known is None or last > known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(last)
            self.until.update((last,))
        if known is None:
            yield frame.iloc[:1]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter([])

    def close(self) -> None:
        pass


def once(changes: DataFrame, late: str, keep: str) -> DataFrame:
    """Changes (id, ts, company, statement), each id once, however often and in whatever order it comes within ``keep`` of event time (STR-02)."""
    _stateful(changes)
    rows = changes.select("id", "ts", "company", "statement").withWatermark("ts", late)
    span = int(pd.Timedelta(keep).total_seconds() * 1000)
    return rows.groupBy("id").transformWithStateInPandas(Once(span), "id long, ts timestamp, company string, statement string", "append", "eventTime")


def alerts(changes: DataFrame, items: DataFrame, path: str, checkpoint: str, late: str = "1 day", keep: str = "30 days") -> StreamingQuery:
    """Changes against watched companies, each id once (STR-02).

    The state holds one number for each id of the last ``keep``; nothing written is read again. The file sink writes each batch once, restarts included.
    """
    hits = once(changes, late, keep).join(items, "company")
    return hits.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class Latest(StatefulProcessor):
    """The newest price of a symbol, given whenever it changes, and once more as stale after ``keep`` milliseconds without a newer one."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.quote = handle.getValueState("quote", "ts long, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "price"])
        ts, price = _ms(frame["ts"].iloc[-1]), float(frame["price"].iloc[-1])
        old = self.quote.get() if self.quote.exists() else None
        if old is None or (ts, price) > (old[0], old[1]):
            if old is not None:
                self.handle.deleteTimer(old[0] + self.keep)
            self.handle.registerTimer(ts + self.keep)
            self.quote.update((ts, price))
            yield self._row(key, ts, price, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.quote.exists():
            ts, price = self.quote.get()
            self.quote.clear()
            yield self._row(key, ts, price, False)

    @staticmethod
    def _row(key, ts: int, price: float, fresh: bool) -> pd.DataFrame:
        return pd.DataFrame({"symbol": [key[0]], "ts": pd.to_datetime([ts], unit="ms"), "price": [price], "fresh": [fresh]})

    def close(self) -> None:
        pass


def latest(quotes: DataFrame, late: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """(symbol, ts, price, fresh): the last value of each key of a stream in update mode; a key without a newer value for ``keep`` is given as stale and forgotten (STR-04)."""
    _stateful(quotes)
    rows = quotes.select("symbol", "ts", "price").where("symbol is not null and ts is not null and price is not null").withWatermark("ts", late)
    span = int(pd.Timedelta(keep).total_seconds() * 1000)
    return rows.groupBy("symbol").transformWithStateInPandas(Latest(span), "symbol string, ts timestamp, price double, fresh boolean", "update", "eventTime")
