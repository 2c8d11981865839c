"""Chat history as a stream: the reference keeps the last 20 messages in a
bounded deque and appends every message to a table.  Here messages arrive
as files (json lines) and a stateful streaming operator keeps, per
conversation, only the last ``n`` messages (state is bounded by n per key,
whatever the conversation length); the full log is appended by the sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tablelens.operators.chat import MAX_HISTORY

MESSAGE_SCHEMA = "conv_id long, id long, role string, content string, timestamp timestamp_ntz"
WINDOW_SCHEMA = "conv_id long, position int, id long, role string, content string, timestamp timestamp_ntz"
STATE_SCHEMA = "ids array<long>, roles array<string>, contents array<string>, stamps array<timestamp_ntz>"


def _last_n(n: int):
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            ids, roles, contents, stamps = state.get
            old = pd.DataFrame({"id": list(ids), "role": list(roles), "content": list(contents),
                                "timestamp": list(stamps)})
        else:
            old = pd.DataFrame(columns=["id", "role", "content", "timestamp"])
        cur = old
        for batch in batches:  # n messages and one Arrow batch at a time, however long the conversation's part is
            frames = [f for f in (cur, batch[["id", "role", "content", "timestamp"]]) if not f.empty]
            if frames:
                cur = pd.concat(frames, ignore_index=True).sort_values(["timestamp", "id"], kind="stable").tail(n)
        state.update((cur["id"].astype("int64").tolist(), cur["role"].tolist(), cur["content"].tolist(),
                      cur["timestamp"].tolist()))
        out = cur.copy()
        out.insert(0, "conv_id", int(key[0]))
        out.insert(1, "position", range(1, len(out) + 1))
        yield out.astype({"position": "int32", "id": "int64"})
    return update


def history_window_stream(messages: DataFrame, n: int = MAX_HISTORY) -> DataFrame:
    """Streaming frame of the current last-``n`` window of every
    conversation touched by a micro-batch (output mode ``update``)."""
    from tablelens.session import ship_package
    ship_package(messages.sparkSession)
    return messages.groupBy("conv_id").applyInPandasWithState(
        _last_n(n), WINDOW_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(MESSAGE_SCHEMA).json(folder)


def run_history(spark: SparkSession, inbox: str, log_path: str, window_path: str, checkpoint: str,
                n: int = MAX_HISTORY, available_now: bool = True):
    """Append every message to ``log_path`` and rewrite the per-conversation
    windows into ``window_path`` (replaced per conversation each batch)."""
    msgs = read_messages(spark, inbox)
    log_q = (msgs.writeStream.format("parquet").option("path", log_path)
             .option("checkpointLocation", f"{checkpoint}/log"))
    win = history_window_stream(msgs, n)

    def sink(batch: DataFrame, epoch: int) -> None:
        # one folder per epoch, overwritten: a replayed micro-batch rewrites
        # its own output instead of appending a second copy
        batch.write.mode("overwrite").parquet(f"{window_path}/epoch={epoch}")

    win_q = win.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{checkpoint}/win")
    if available_now:
        log_q, win_q = log_q.trigger(availableNow=True), win_q.trigger(availableNow=True)
    return log_q.start(), win_q.start()


def latest_windows(spark: SparkSession, window_path: str) -> DataFrame:
    """Current window per conversation: rows of each conversation's most
    recent epoch in the window table."""
    w = spark.read.parquet(window_path)
    last = w.groupBy("conv_id").agg(F.max("epoch").alias("epoch"))
    return w.join(last, ["conv_id", "epoch"]).drop("epoch")
