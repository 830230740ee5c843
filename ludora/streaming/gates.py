"""Results that come once, when their client is complete: keyed state with ``transformWithState``.

A stream of messages has client_id, sender_id, message_id, messages_sent and columns of partial sums. A row with
``messages_sent`` is a sender's end marker (how many messages it sent), one with ``deleted`` true ends the client, any other is a message. Rows come
in any order and may repeat. Per client the state holds the sums, the ids of messages seen and the markers; when all
markers came and as many distinct messages as they announce, the sums are emitted and all of that goes, but for one flag, by
which later repeats are known. A deleted client emits nothing, and its state goes likewise.

Only messages reach the state, each the partial sums of many rows (A1), not the rows themselves; a client with a third of all
rows has a third of the messages. Each call to the state goes from Python to the JVM and back, so ids are kept in ``BUCKETS`` lists by their hash, and a batch
asks for a list once for up to ``HELD`` messages, not once for each message.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Lists of the ids seen, by their hash; a checkpoint holds for one number of them. Messages held before the state is asked.
BUCKETS = 1024
HELD = 200_000


class GatedSums(StatefulProcessor):
    """Sums of ``columns`` of each client, emitted once when ``markers`` senders are complete."""

    def __init__(self, columns: tuple[str, ...], markers: int) -> None:
        self.columns, self.markers = columns, markers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", ", ".join(f"{c} long" for c in self.columns))
        self.seen = handle.getMapState("seen", "bucket int", "ids array<string>")
        self.count = handle.getValueState("count", "n long")
        self.marks = handle.getMapState("marks", "sender_id string", "sent long")
        self.closed = handle.getValueState("closed", "there boolean")

    def forget(self) -> None:
        for state in (self.sums, self.seen, self.count, self.marks):
            state.clear()
        self.closed.update((True,))

    def unseen(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        """The messages that are new, once each; their ids are kept."""
        rows = pd.concat(parts, ignore_index=True)
        senders = rows["sender_id"].map(str)
        rows["id"] = senders.map(len).map(str) + ":" + senders + rows["message_id"].map(str)
        rows = rows.drop_duplicates("id")
        new = []
        for bucket, ids in rows["id"].groupby(rows["id"].map(lambda x: zlib.crc32(x.encode()) % BUCKETS)):
            key = (int(bucket),)
            old = list(self.seen.getValue(key)[0]) if self.seen.containsKey(key) else []
            fresh = ids[~ids.isin(old)] if old else ids
            if len(fresh):
                self.seen.updateValue(key, (old + fresh.tolist(),))
                new.append(fresh)
        return rows.loc[pd.concat(new).index] if new else rows.iloc[:0]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.closed.exists():
            for _ in rows:
                pass
            return
        sums = list(self.sums.get()) if self.sums.exists() else [0] * len(self.columns)
        count = self.count.get()[0] if self.count.exists() else 0
        deleted = False

        def add(parts: list[pd.DataFrame]) -> None:
            nonlocal count, sums
            fresh = self.unseen(parts)
            count += len(fresh)
            sums = [a + int(fresh[c].fillna(0).sum()) for a, c in zip(sums, self.columns, strict=True)]

        held, n = [], 0
        for part in rows:
            deleted |= bool(part["deleted"].fillna(False).astype(bool).any())
            ends = part["messages_sent"].notna()
            for sender, sent in part.loc[ends, ["sender_id", "messages_sent"]].drop_duplicates().itertuples(index=False):
                self.marks.updateValue((str(sender),), (int(sent),))
            own = part.loc[~ends & part["message_id"].notna(), ["sender_id", "message_id", *self.columns]]
            if len(own):
                held.append(own)
                n += len(own)
            if n >= HELD:
                add(held)
                held, n = [], 0
        if held and not deleted:
            add(held)
        if deleted:
            self.forget()
            return
        sent = [v[0] for _, v in self.marks.iterator()]
        if len(sent) >= self.markers and sum(sent) == count:
            self.forget()
            yield pd.DataFrame({"client_id": [key[0]], **{c: [v] for c, v in zip(self.columns, sums, strict=True)}, "messages": [count]})
        else:
            self.sums.update(tuple(sums))
            self.count.update((count,))


def gated(messages: DataFrame, columns: tuple[str, ...], markers: int = 1) -> DataFrame:
    """client_id, ``columns`` and messages of each client, in the batch that completes it, once. Run it within ``keyed_state``."""
    kept = messages.selectExpr("client_id", "cast(sender_id as string) as sender_id", "cast(message_id as string) as message_id", "messages_sent", "deleted", *columns)
    client = dict(messages.dtypes)["client_id"]
    shape = f"client_id {client}, {', '.join(f'{c} long' for c in columns)}, messages long"
    return kept.groupBy("client_id").transformWithStateInPandas(GatedSums(tuple(columns), markers), shape, "append", "none")


def keyed_state(spark: SparkSession, run: Callable[[], None]) -> None:
    """Run a stream with the state store that keyed state needs; the session's own setting comes back after it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        run()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
