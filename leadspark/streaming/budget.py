"""The budget ledger over a stream of reserve and settle events."""

from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import fixed as V
from ..operators.ledger import STEP_SCHEMA, Carry, played, with_calendar
from ..sources.stage import fresh_path

DELAY = "1 day"
#: Rows of a finished table that one trigger takes.
ROWS_PER_TRIGGER = 2_000_000
#: Rows of an account that are packed at a time.
PACKED = 100_000
_DAY = 86_400_000_000
#: Times are microseconds here, whatever the session's time zone is.
_EVENT = pa.schema(
    [(c, pa.int64()) for c in ("event_id", "ts", "want", "reserved", "actual")] + [(c, pa.string()) for c in ("kind", "month", "day")]
)
_STATE = "month string, day string, over boolean, used long, day_used long"
_OUT = f"{STEP_SCHEMA}, late boolean"
_OUT_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LedgerProcessor(StatefulProcessor):
    """State of an account: the ledger up to the watermark, and the events beyond it.

    Events wait until the watermark has passed them, then a timer takes all that it has
    passed in order of time. One that comes behind the watermark, or has no time, cannot be
    put in order and is returned as `late`, having changed nothing. Waiting events are kept
    by day of their time, many to a value, and taken a day at a time.
    """

    def __init__(self, month_cap: int, day_cap: int):
        self.caps = month_cap, day_cap

    def init(self, handle) -> None:
        self.handle = handle
        self.ledger = handle.getValueState("ledger", _STATE)
        self.parts = handle.getValueState("parts", "n long")
        # `first` is the earliest time in the value, so that days not due yet are not read
        self.waiting = handle.getMapState("waiting", "epoch_day long, first long, part long", "events binary")

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held, first = [], []
        for pdf in rows:
            behind = ~(pdf["ts"] >= mark)
            late = pdf[behind]
            if len(late):
                yield _shaped(late.assign(late=True, granted=None, limited_by=None, used=None, day_used=None))
            held.append(pdf[~behind])
            if sum(map(len, held)) >= PACKED:
                first += self._keep(pd.concat(held))
                held = []
        first += self._keep(pd.concat(held)) if held else []
        self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        keys = pd.DataFrame([tuple(k) for k in self.waiting.keys()], columns=["epoch_day", "first", "part"])
        due = keys["epoch_day"][keys["first"] < mark].unique()
        if not len(due):
            return
        carry = Carry(*self.ledger.get()) if self.ledger.exists() else None
        first = keys["first"][~keys["epoch_day"].isin(due)].tolist()
        for day in sorted(due):
            at = [tuple(map(int, k)) for k in keys[keys["epoch_day"] == day].itertuples(index=False)]
            held = pd.concat([_unpacked(self.waiting.getValue(k)[0]) for k in at])
            for k in at:
                self.waiting.removeKey(k)
            passed = held["ts"] < mark
            ready = held[passed].sort_values(["ts", "event_id"], kind="stable").reset_index(drop=True)
            ready.insert(0, "account", key[0])
            steps, carry = played(ready, *self.caps, carry)
            yield _shaped(steps.assign(late=False))
            first += self._keep(held[~passed])
        self.ledger.update((carry.month, carry.day, carry.over, carry.used, carry.day_used))
        self._wake(first)

    def _keep(self, events: pd.DataFrame) -> list[int]:
        """Put events into the state; the earliest time of each value written."""
        first, part = [], self.parts.get()[0] if self.parts.exists() else 0
        for day, rows in events.groupby(events["ts"] // _DAY):
            first.append(int(rows["ts"].min()))
            self.waiting.updateValue((int(day), first[-1], part), (_packed(rows),))
        if first:
            self.parts.update((part + 1,))
        return first

    def _wake(self, first: list[int]) -> None:
        if first:
            self.handle.registerTimer(min(first) // 1000 + 1)

    def close(self) -> None:
        pass


def _packed(events: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _EVENT, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_pandas(events[_EVENT.names], schema=_EVENT, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def _shaped(rows: pd.DataFrame) -> pd.DataFrame:
    return rows[_OUT_COLUMNS].astype({"ts": "Int64", "granted": "Int64", "used": "Int64", "day_used": "Int64"})


def ledger_steps(
    events: DataFrame, month_cap: int = V.MONTH_CAP, day_cap: int = V.DAY_CAP, delay: str = DELAY
) -> DataFrame:
    """Streaming ledger: a step per event once the watermark has passed it, and late events.

    Events may come out of order, across triggers too, by up to `delay`; the steps are then
    those of the batch ledger. Where an event is `late` its other results are NULL. An
    account's state is its calendar labels, two counts and the events of the last `delay`,
    packed; a task holds the account's events of one day. The source's own limits (such as
    maxFilesPerTrigger) keep a trigger small. The session needs the RocksDB state
    store (`rocksdb`) while the query starts.
    """
    numbers = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("want", "reserved", "actual")]
    dated = with_calendar(events.withWatermark("ts", delay))
    # The computed time carries no watermark, so late rows reach the processor.
    plain = F.unix_micros("ts").alias("ts")
    rows = dated.select("account", F.col("event_id").cast("long").alias("event_id"), plain, "kind", *numbers, "month", "day")
    steps = rows.groupBy("account").transformWithStateInPandas(
        statefulProcessor=LedgerProcessor(month_cap, day_cap), outputStructType=_OUT.replace("ts timestamp", "ts long"),
        outputMode="Append", timeMode="EventTime",
    )
    return steps.withColumn("ts", F.timestamp_micros("ts"))


def budget_stream(
    events: DataFrame, month_cap: int = V.MONTH_CAP, day_cap: int = V.DAY_CAP, delay: str = "40 days", triggers: int = 3
) -> DataFrame:
    """Run a finished table of events through the streaming ledger; (steps, late) in one table.

    Events arrive out of order, each by less than `delay` after its time, so none is late
    however long the table is. They land as one file per trigger in the order in which they
    arrive: `triggers` files, or more where those would be of over ROWS_PER_TRIGGER rows. A
    last file closes the stream: its one row, of no account and no id, lies so far ahead
    that the watermark passes every event.
    """
    spark = events.sparkSession
    landing, sink, progress = (fresh_path(spark, f"budget-{n}") for n in ("in", "out", "state"))
    land_in_turn(events, landing, delay, triggers)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    steps = ledger_steps(source, month_cap, day_cap, delay)
    run_to_end(steps, sink, progress)
    close_stream(events, landing, delay)
    run_to_end(steps, sink, progress)
    return spark.read.schema(steps.schema).parquet(sink).filter("account IS NOT NULL OR event_id IS NOT NULL")


def land_in_turn(events: DataFrame, landing: str, delay: str, triggers: int) -> None:
    """Write events as files in the order in which they arrive, one after the other."""
    spark = events.sparkSession
    files = max(triggers, -(-events.count() // ROWS_PER_TRIGGER))
    ranges = fresh_path(spark, "budget-ranges")
    time = F.unix_micros("ts")
    span = F.unix_micros(F.col("ts") + F.expr(f"INTERVAL {delay}")) - time
    arrival = time + F.pmod(F.xxhash64("event_id"), F.greatest(span, F.lit(1)))
    cut = events.repartitionByRange(files, F.coalesce(arrival, F.lit(0))).withColumn("_file", F.spark_partition_id())
    cut.write.partitionBy("_file").parquet(ranges)
    kind = StructType([*events.schema.fields, StructField("_file", IntegerType())])
    whole = spark.read.schema(kind).parquet(ranges)
    # the source takes files by their time of writing, so each is a job of its own
    for k in sorted(r[0] for r in whole.select("_file").distinct().collect()):
        whole.filter(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(landing)


def close_stream(events: DataFrame, landing: str, delay: str) -> None:
    """Land a row beyond the last event and the delay, so that nothing waits any longer."""
    end = events.agg((F.max("ts") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    last = end.select(*[F.col("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes])
    last.filter("ts IS NOT NULL").select(*events.columns).coalesce(1).write.mode("append").parquet(landing)


@contextmanager
def rocksdb(spark: SparkSession):
    """The session with the state store that stateful processors need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def run_to_end(steps: DataFrame, sink: str, progress: str) -> None:
    """Process everything that has arrived, then stop; `progress` keeps the state."""
    with rocksdb(steps.sparkSession):
        run = (
            steps.writeStream.format("parquet")
            .option("path", sink)
            .option("checkpointLocation", progress)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
