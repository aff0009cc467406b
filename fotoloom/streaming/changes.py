"""Change journals, uploads and sessions as streams. Each function takes a streaming or a static DataFrame alike where Spark allows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fotoloom.session import Scratch

#: Reasons of a journal record; renames carry no reason of their own.
DELETE, CREATE, MODIFY = "DELETE", "CREATE", "MODIFY"


def _step(state: str | None, reason: str) -> str:
    """Net change of a file after one more record."""
    if reason == DELETE:
        return "deleted"
    if reason == CREATE:
        return "added"
    return "added" if state == "added" else "modified"


def fold_changes(log: DataFrame, key: str = "file_key", order: str = "usn", reason: str = "reason", after: int | None = None) -> DataFrame:
    """(key, change, last_usn): the net change of every file after a journal position, as a batch.

    A deletion clears what came before, a creation clears a deletion, a modification counts unless the
    file was added. Only what follows a file's last deletion or creation can matter, which two
    aggregates show; no list of records is collected.
    """
    rows = log if after is None else log.filter(F.col(order) > after)
    rows = rows.filter(F.col(key).isNotNull() & F.col(order).isNotNull())
    hard = F.when(F.col(reason).isin(DELETE, CREATE), F.col(order))
    got = rows.groupBy(key).agg(
        F.max(order).alias("last_usn"), F.max(hard).alias("hard_usn"), F.max_by(F.when(F.col(reason).isin(DELETE, CREATE), F.col(reason)), hard).alias("hard"),
    )
    later = F.col("last_usn") > F.col("hard_usn")
    change = F.when(F.col("hard").isNull(), "modified").when(F.col("hard") == CREATE, "added").when(later, "modified").otherwise("deleted")
    return got.select(key, change.alias("change"), "last_usn")


def stream_changes(log: DataFrame, key: str = "file_key", order: str = "usn", reason: str = "reason") -> DataFrame:
    """The same fold over a stream: after each micro-batch the net change of every file in it."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        change, last = state.get if state.exists else (None, -1)
        rows = pd.concat(list(batches)).sort_values(order)
        for usn, why in zip(rows[order], rows[reason]):
            if usn > last:
                change, last = _step(change, why), int(usn)
        state.update((change, last))
        yield pd.DataFrame({key: [k[0]], "change": [change], "last_usn": [last]})

    kind = log.schema[key].dataType.simpleString()
    out, keep = f"{key} {kind}, change string, last_usn bigint", "change string, last bigint"
    return log.groupBy(key).applyInPandasWithState(update, out, keep, "update", GroupStateTimeout.NoTimeout)


def high_water(uploads: DataFrame, user: str = "user_id", at: str = "ts") -> DataFrame:
    """(user, last_sync): latest time per user; late rows never lower it."""
    return uploads.filter(F.col(user).isNotNull()).groupBy(user).agg(F.max(at).alias("last_sync"))


def sessions(touches: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user, start, end, touches) of runs of activity without a pause of ``gap``."""
    rows = touches.withWatermark(at, late) if late else touches
    return rows.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("touches")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "touches")


def read_change_log(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    """A folder of JSON change records as a stream; the query's checkpoint remembers what was read."""
    schema = "file_key string, usn bigint, reason string, file_name string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def index_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], done_path: str, checkpoint: str, key: str = "file_path"):
    """Run ``work`` on the rows of each micro-batch whose key is not done yet, and append its result.

    A batch run again after a failure finds its own rows done and adds nothing. Stop the returned query
    between batches with ``stop()``; ``lastProgress`` shows speed and position.
    """

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        todo = batch.dropDuplicates([key])
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(done_path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            todo = todo.join(spark.read.parquet(done_path).select(key), key, "left_anti")
        work(todo).write.mode("append").parquet(done_path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def changes_since(log: DataFrame, after: int, old: DataFrame, new: DataFrame, key: str = "file_key", order: str = "usn") -> tuple[DataFrame, int | None]:
    """((key, change), next position) after a journal position.

    If the journal no longer holds the records right after it (it has wrapped over), the changes come from
    comparing an old and a new scan of (key, size) instead, and the position stays as it is: None.
    """
    from fotoloom.sources.files import snapshot_diff

    first, last = log.agg(F.min(order), F.max(order)).first()
    if first is not None and first > after + 1:
        return snapshot_diff(old, new, key, ["size"]), None
    return fold_changes(log, key, order, after=after).select(key, "change"), after if last is None else max(after, last)


def index_all(spark: SparkSession, scan: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, int]:
    """Rows that each step made of one scan of the files, in the order given; the scan is done once and written.

    A step that fails stops the queue; the steps before it have been counted in the error's ``done``.
    """
    s, done = Scratch(spark), {}
    files = s.cut(scan)
    for name, step in steps.items():
        try:
            done[name] = step(files).count()
        except Exception as e:
            e.done = done
            raise
    s.free(files)
    return done
