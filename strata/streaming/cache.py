"""A bounded cache for each lineage, kept as the state of a stream: least recently used first out, with timers for lineages that fall silent."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session must state: timers and typed state need it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STATE = "keys array<string>, sizes array<bigint>, uses bigint"
_OUT = "lineage {kind}, seq {order}, key string, hit boolean, evicted array<string>, version bigint"


class _Recent(StatefulProcessor):
    """Entries from the least to the most recently used, at most ``entries`` of them and of ``room`` together."""

    def __init__(self, entries: int, room: int, idle: int | None):
        self.entries, self.room, self.idle = entries, room, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        keys, sizes, uses = self.held.get() if self.held.exists() else ([], [], 0)
        cache = dict(zip(keys, sizes, strict=True))
        for r in sorted(rows, key=lambda r: r.seq):
            hit = r.key in cache
            cache.pop(r.key, None)
            if r.size <= self.room:
                cache[r.key] = r.size
            gone = []
            while len(cache) > self.entries or sum(cache.values()) > self.room:
                gone.append(next(iter(cache)))
                del cache[gone[-1]]
            uses += 1
            yield Row(lineage=key[0], seq=r.seq, key=r.key, hit=hit, evicted=gone, version=uses)
        self.held.update((list(cache), list(cache.values()), uses))
        if self.idle is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.idle)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """A lineage that fell silent gives up its entries; its version goes on."""
        keys, _, uses = self.held.get()
        self.held.update(([], [], uses))
        yield Row(lineage=key[0], seq=None, key=None, hit=None, evicted=list(keys), version=uses)

    def close(self) -> None:
        pass


def cached(requests: DataFrame, entries: int, room: int = 1 << 62, idle: int | None = None) -> DataFrame:
    """(lineage, seq, key, hit, evicted, version) for a stream of requests (lineage, key, size, seq), and for every lineage that falls silent.

    Each lineage has a cache of ``entries`` keys and ``room`` in size together; a request that finds its key there hits. Requests of a micro-batch go by ``seq``. What must
    make room is listed in ``evicted``; a key larger than the room isn't kept. ``version`` counts a lineage's requests, over restarts too. With ``idle`` (milliseconds; the stream needs a
    watermark) a lineage without requests for that long gives up all its entries (seq and key are null). State is the entries alone, whatever number of requests came.
    """
    kind = requests.schema["lineage"].dataType.simpleString()
    order = requests.schema["seq"].dataType.simpleString()
    mode = "none" if idle is None else "eventTime"
    return requests.groupBy("lineage").transformWithState(_Recent(entries, room, idle), _OUT.format(kind=kind, order=order), "append", mode)


def with_store(spark: SparkSession) -> None:
    """States the store that ``cached`` needs, for the queries started from now on."""
    spark.conf.set(*STORE)
