"""Chat memory on a stream: each conversation's turns, tokens, and when a summary is due, kept as state with a time to live.

Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider. With an availableNow trigger also set
spark.sql.streaming.noDataMicroBatches.enabled = false, as a time to live asks for batches without data for ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Turns after which a summary is due, and again after as many.
SUMMARY_TURNS = 6
#: How long a conversation is remembered after its last turn.
TTL_MS = 7 * 24 * 3600 * 1000
MEMORY = "conv_id bigint, turn bigint, turns bigint, used bigint, in_budget boolean, summary_due boolean"


class Memory(StatefulProcessor):
    """Counts a conversation's turns and tokens; rows of one batch are taken in order of their turn."""

    def __init__(self, budget: int, ttl_ms: int = TTL_MS):
        self.budget, self.ttl_ms = budget, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("memory", "turns bigint, used bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        turns, used = self.state.get() if self.state.exists() else (0, 0)
        # a conversation's rows of one batch; they carry numbers, no texts
        batch = pd.concat(list(rows)).sort_values("turn", kind="stable")
        out = []
        for turn, tokens in zip(batch["turn"], batch["tokens"], strict=True):
            turns, used = turns + 1, used + int(tokens)
            out.append((key[0], turn, turns, used, used <= self.budget, turns >= SUMMARY_TURNS))
        self.state.update((turns, used))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in MEMORY.split(", ")])

    def close(self) -> None:
        pass


def remembered(turns: DataFrame, budget: int, ttl_ms: int = TTL_MS) -> DataFrame:
    """Each turn of a stream (conv_id, turn, text) with what its conversation has come to: turns, tokens, whether it is within the budget, whether a summary is due.

    Only numbers go to the state; a turn's tokens are a fourth of its characters, one at least.
    """
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("bigint")
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce(tokens, F.lit(1)).alias("tokens"))
    return rows.groupBy("conv_id").transformWithStateInPandas(Memory(budget, ttl_ms), MEMORY, "Append", "ProcessingTime")
