"""What a conversation remembers, turn by turn: over a table by windows, over a stream by state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quaestor.memory import MAX_MINUTES, MAX_TURNS

REMEMBERED = "conv_id long, turn long, at timestamp, remembered array<long>"
_STATE = "held string"


def _named(turns: DataFrame, conversation: str, turn: str, time: str) -> DataFrame:
    return turns.select(F.col(conversation).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(time).cast("timestamp").alias("at")).filter("conv_id is not null and turn is not null and at is not null")


def remembered(turns: DataFrame, max_turns: int = MAX_TURNS, max_minutes: float = MAX_MINUTES, conversation: str = "conv_id", turn: str = "turn", time: str = "ts") -> DataFrame:
    """conv_id, turn, at, remembered of each turn of a table: the turns that a memory of max_turns and max_minutes holds once it has come, oldest first.

    Turns come in the order of (time, turn). Rows without conversation, turn or time are no turns. A frame holds max_turns rows, so that a busy conversation costs no more for each turn.
    """
    rows = _named(turns, conversation, turn, time)
    last = Window.partitionBy("conv_id").orderBy("at", "turn").rowsBetween(1 - max_turns, Window.currentRow)
    held = F.collect_list(F.struct("turn", "at")).over(last)
    oldest = F.unix_micros("at") - F.lit(int(max_minutes * 60_000_000))
    young = F.transform(F.filter("held", lambda x: F.unix_micros(x["at"]) >= F.col("oldest")), lambda x: x["turn"])
    return rows.withColumns({"held": held, "oldest": oldest}).select("conv_id", "turn", "at", young.alias("remembered"))


def remembered_stream(
    turns: DataFrame, max_turns: int = MAX_TURNS, max_minutes: float = MAX_MINUTES, late: str = "10 minutes", conversation: str = "conv_id", turn: str = "turn", time: str = "ts",
) -> DataFrame:
    """The same of a stream, for turns that come in the order of their times but for those within one batch. State is at most max_turns numbers for each conversation, and goes
    once the stream's watermark (``late`` behind its latest time) has passed the time to live of its last turn. Turns later than the watermark are dropped."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "turn"], kind="stable")
        out = []
        for number, at in zip(rows["turn"], rows["at"]):
            now = at.value // 1000
            held = [h for h in [*held, [int(number), now]] if now - h[1] <= max_minutes * 60_000_000][-max_turns:]
            out.append((key[0], int(number), at, [n for n, _ in held]))
        state.update((json.dumps(held),))
        ends = int(held[-1][1] // 1000 + max_minutes * 60_000) + 1
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "at", "remembered"])

    rows = _named(turns, conversation, turn, time).withWatermark("at", late)
    return rows.groupBy("conv_id").applyInPandasWithState(run, REMEMBERED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def append_history(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends a stream to a Parquet table; started again with the same checkpoint, it goes on where it ended, each row once."""
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)
