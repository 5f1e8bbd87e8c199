"""Review actions as a stream: held until their target is quiet, then applied exactly once.

Of several actions on one target the last decides, so a target's actions are
applied together.  A stateful processor keyed by target holds them and sets a timer;
when no more have arrived for a while they come out, in the order of their ids.
Time is the arrival of the actions (the time of their file), which only goes
forward: an action that was made long ago is never dropped as late.  If its target
is resolved by then, it is refused as any other, with an outcome.

Each micro-batch is one commit of the store: the tables, the log, the outcomes, the
progress and the number of the batch are published together.  A batch that runs
again after a crash finds its number there and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import review
from ..sources.shared import dropped, stored

ACTION = "id long, target_table string, target_id long, action string, reassign_to string, reclassify_to string, reviewer string, client_action_id string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_arriving(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The action files of a folder, with ``arrived``: when their file was written."""
    raw = spark.readStream.schema(ACTION).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("arrived", F.col("_metadata.file_modification_time"))


class UntilQuiet(StatefulProcessor):
    """Holds a target's actions until none has arrived for ``quiet`` milliseconds."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle):
        self.handle, self.open = handle, handle.getListState("open", ACTION)

    def handleInputRows(self, key, rows, timerValues):
        last = 0
        for r in rows:
            self.open.appendValue(tuple(r[c] for c in r.__fields__ if c != "arrived"))
            last = max(last, int(r["arrived"].timestamp() * 1000))
        until = max([last + self.quiet, *self.handle.listTimers()])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(until)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        names = [c.split()[0] for c in ACTION.split(", ")]
        held = sorted(self.open.get(), key=lambda r: r[0])
        self.open.clear()
        for r in held:
            yield Row(**dict(zip(names, r)))

    def close(self):
        pass


def settled(actions: DataFrame, quiet: int = 60) -> DataFrame:
    """The actions, all of a target once nothing has arrived for it for ``quiet`` seconds of the stream's time."""
    cols = [c.split()[0] for c in ACTION.split(", ")]
    timed = actions.select(*cols, "arrived").withWatermark("arrived", "0 seconds")
    return timed.groupBy("target_table", "target_id").transformWithState(UntilQuiet(quiet * 1000), ACTION, "Append", "EventTime")


def apply_once(store, name: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that applies each micro-batch to the store once, whatever is run again."""

    def apply(batch: DataFrame, epoch: int) -> None:
        new = stored(batch, "epoch")  # read to its end, so that the state of every partition is committed
        if epoch > store.done(name) and not new.isEmpty():
            publish(new, epoch)
        dropped(new)

    def publish(new: DataFrame, epoch: int) -> None:
        queue, outcome = review.enqueue(store.read("review_actions"), new.withColumn("applied_at", F.lit(None).cast("string")))
        queue = stored(queue, "queue")
        plan = review.apply_batch(store, F.concat(F.lit(f"{name}#"), F.lit(epoch)), queue=queue)
        refused = plan["errors"].join(new.select("id", "client_action_id").distinct(), "id").select("client_action_id", "error")
        said = outcome.join(refused, "client_action_id", "left").withColumn("outcome", F.when(F.col("outcome") == "queued", F.coalesce("error", "outcome")).otherwise(F.col("outcome"))).withColumn("epoch", F.lit(epoch).cast("long"))
        said = stored(said.select("epoch", "client_action_id", "outcome"), "outcomes")
        count = said.groupBy("epoch").agg(F.count("*").alias("actions"), F.count_if(F.col("outcome") == "queued").alias("applied")).withColumn("job", F.lit(name)).select("job", "epoch", "actions", "applied")
        store.commit(plan["tables"], {"review_outcomes": said, "stream_progress": count}, step=(name, epoch))
        dropped(said)
        dropped(queue)

    return apply


def run(actions: DataFrame, store, checkpoint: str, name: str = "review", quiet: int = 60, every: str | None = None) -> StreamingQuery:
    """Start the application of a stream of actions: every ``every`` (as '10 seconds'), or once over what is there."""
    actions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = settled(actions, quiet).writeStream.foreachBatch(apply_once(store, name)).option("checkpointLocation", checkpoint).queryName(name)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def poll(spark: SparkSession, store, tables: list[str], checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Every ``every``, the published versions and row counts of tables go to the store's ``table_stats``, with the poll's number."""

    def count(_: DataFrame, epoch: int) -> None:
        now = store.published()
        parts = [store.read(t).agg(F.lit(epoch).cast("long").alias("poll"), F.lit(t).alias("table"), F.lit(now[t]).alias("version"), F.count("*").alias("rows")) for t in tables if t in now]
        if parts:
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            store.commit({}, {"table_stats": rows}, step=("poll", epoch))

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
