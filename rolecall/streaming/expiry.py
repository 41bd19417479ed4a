"""Listings that nobody confirms any more, as timers of a stream.

A listing's next deadline is UNCONFIRMED_DAYS after its last confirmation, when it is
taken down, or LISTING_DAYS after it was posted, when it goes for good. The clock is
the watermark of the confirmations' own time, so a replay fires the same changes. What
is due by the watermark is settled before a new confirmation counts, and a late or
repeated confirmation never moves a deadline back: the changes do not depend on how
rows fall into batches of one watermark.

State is kept for BUCKETS buckets of listings, by a hash of the id, each one value with
columns and one timer at the first deadline in it. A call from Spark into Python costs
about as much for one listing as for thousands, whose columns are worked on together.

A watermark of `as_of` leaves the listings that `sync.purge_old` and
`sync.expire_unconfirmed` leave at `as_of`, to the millisecond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rolecall.operators.filters import LISTING_DAYS, listing_cutoff
from rolecall.plans.sync import UNCONFIRMED_DAYS

#: A checkpoint is bound to this number.
BUCKETS = 512

_DAY = 24 * 60 * 60 * 1000
_STATE = "timer long, listings binary"
_CHANGES = "id string, status string, at_ms long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTS = "spark.sql.shuffle.partitions"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for no posted_at and no deadline, far enough from the end to add days to it.
_NEVER = 2**62


class Listings:
    """The listings of one bucket as columns: id, posted, verified (ms), manual, expired and, within a batch, gone."""

    def __init__(self, ids, posted, verified, manual, expired):
        self.ids, self.posted, self.verified, self.manual, self.expired = ids, posted, verified, manual, expired
        self.gone = np.zeros(len(ids), bool)

    @classmethod
    def read(cls, held: bytes | None) -> Listings:
        if held is None:
            none = np.zeros(0, np.int64)
            return cls(none.astype(object), none, none, none.astype(bool), none.astype(bool))
        with pa.ipc.open_stream(held) as stream:
            table = stream.read_all()
        return cls(*[table.column(i).to_numpy() for i in range(5)])

    def written(self) -> bytes:
        left = ~self.gone
        columns = [pa.array(self.ids[left], pa.string())] + [pa.array(c[left]) for c in (self.posted, self.verified, self.manual, self.expired)]
        batch = pa.record_batch(columns, ["id", "posted", "verified", "manual", "expired"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def add(self, rows: pd.DataFrame) -> None:
        """New listings, one row each."""
        fresh = Listings(
            rows["id"].to_numpy(object), rows["posted"].to_numpy(np.int64), rows["verified"].to_numpy(np.int64),
            (rows["source"] == "MANUAL").to_numpy(bool), np.zeros(len(rows), bool),
        )
        for name, column in vars(fresh).items():
            setattr(self, name, np.concatenate([getattr(self, name), column]))

    def _stale(self, at) -> np.ndarray:
        takes_down = ~self.expired[at] & ~self.manual[at]
        return np.where(takes_down, self.verified[at] + UNCONFIRMED_DAYS * _DAY, _NEVER)

    def _over(self, at) -> np.ndarray:
        return np.where(self.posted[at] == _NEVER, _NEVER, self.posted[at] + LISTING_DAYS * _DAY)

    def due(self, at: np.ndarray, now: int) -> list[tuple]:
        """Settles what the clock has passed for the listings at these places: (ids, status, times)."""
        at = at[~self.gone[at]]
        stale, over = self._stale(at), self._over(at)
        down, out = (stale < now) & (stale < over), over < now
        self.expired[at[down]] = True
        self.gone[at[out]] = True
        return [(self.ids[at[down]], "EXPIRED", stale[down]), (self.ids[at[out]], "DELETED", over[out])]

    def confirm(self, at: np.ndarray, verified: np.ndarray) -> list[tuple]:
        """One confirmation for each listing at these places."""
        later = ~self.gone[at] & (verified > self.verified[at])
        at, verified = at[later], verified[later]
        again = self.expired[at]
        self.verified[at] = verified
        self.expired[at] = False
        return [(self.ids[at[again]], "ACTIVE", verified[again])]

    def next_timer(self) -> int:
        """Deadlines are strict, so a timer stands one millisecond behind the first one; 0 for none."""
        at = np.flatnonzero(~self.gone)
        first = min(self._stale(at).min(initial=_NEVER), self._over(at).min(initial=_NEVER))
        return 0 if first == _NEVER else int(first) + 1


class ExpiryTimers(StatefulProcessor):
    """State of one bucket of listings."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("listings", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        timer, listings = self._read()
        order = ["id", "verified", "posted", "source"]
        seen = pd.concat([part.drop_duplicates() for part in rows], ignore_index=True).sort_values(order, ignore_index=True)
        # Repeats of a time change nothing, and the first row of a listing says when and where it was posted.
        seen = seen.drop_duplicates(["id", "verified"], ignore_index=True)
        firsts = seen.drop_duplicates("id")
        listings.add(firsts[~firsts["id"].isin(listings.ids)])
        places = pd.Index(listings.ids).get_indexer(seen["id"])
        turn = seen.groupby("id", sort=False).cumcount().to_numpy()
        verified = seen["verified"].to_numpy(np.int64)
        changes = listings.due(np.arange(len(listings.ids)), now)
        by_turn = np.argsort(turn, kind="stable")
        for rows_of_turn in np.split(by_turn, np.flatnonzero(np.diff(turn[by_turn])) + 1):
            at = places[rows_of_turn]
            changes += listings.confirm(at, verified[rows_of_turn])
            changes += listings.due(at, now)
        return self._settled(listings, timer, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, listings = self._read()
        return self._settled(listings, 0, listings.due(np.arange(len(listings.ids)), timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass

    def _read(self) -> tuple[int, Listings]:
        timer, held = self.bucket.get() or (0, None)
        return timer, Listings.read(held)

    def _settled(self, listings: Listings, timer: int, changes: list[tuple]) -> Iterator[pd.DataFrame]:
        ahead = listings.next_timer()
        if timer and timer != ahead:
            self.handle.deleteTimer(timer)
        if ahead and timer != ahead:
            self.handle.registerTimer(ahead)
        if listings.gone.all():
            self.bucket.clear()
        else:
            self.bucket.update((ahead, listings.written()))
        told = [pd.DataFrame({"id": ids, "status": status, "at_ms": at}) for ids, status, at in changes if len(ids)]
        return iter([pd.concat(told)] if told else [])


def expiry_changes(confirmations: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(id, status, at): when a listing was taken down (EXPIRED), confirmed again (ACTIVE) or went for good (DELETED).

    `confirmations` is a stream of id, source, posted_at and verified_at, one row
    whenever a listing is posted or confirmed; the first row's posted_at counts.
    Roles posted by hand (MANUAL) are never taken down. A row without id or
    verified_at, or of a role that was over age by then, is no confirmation; without
    posted_at a listing never goes for good. A row that comes after its listing went
    says DELETED again.
    """
    fresh = F.col("posted_at").isNull() | (F.col("posted_at") >= listing_cutoff(F.col("verified_at")))
    rows = confirmations.filter("id IS NOT NULL AND verified_at IS NOT NULL").filter(fresh).withWatermark("verified_at", delay)
    rows = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket"),
        "id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.unix_millis("posted_at"), F.lit(_NEVER)).alias("posted"),
        F.unix_millis("verified_at").alias("verified"),
        "verified_at",
    )
    changes = rows.groupBy("bucket").transformWithStateInPandas(ExpiryTimers(), _CHANGES, "Append", "EventTime")
    return changes.select("id", "status", F.timestamp_millis("at_ms").alias("at"))


def write_changes(changes: DataFrame, path: str, checkpoint: str):
    """Append the changes that landed files bring; timers need the RocksDB state store.

    A batch opens and saves every part of the state, which costs about a second a part however little it
    holds: a new checkpoint has two parts a core at most (an old one keeps the number that it has).
    """
    session = changes.sparkSession
    before = {key: session.conf.get(key) for key in (_PROVIDER, _PARTS)}
    used = {_PROVIDER: _ROCKSDB, _PARTS: str(min(int(before[_PARTS]), 2 * session.sparkContext.defaultParallelism))}
    for key, value in used.items():
        session.conf.set(key, value)
    try:
        writer = changes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start(path)
    finally:
        for key, value in before.items():
            session.conf.set(key, value)


def listings_left(confirmed: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, status) of the listings ever confirmed after all changes; the deleted ones are gone."""
    # Changes of one moment never meet: a deadline and a confirmation at it leave the listing active.
    last = changes.groupBy("id").agg(F.max_by("status", F.struct("at", F.col("status") == "DELETED")).alias("_last"))
    left = confirmed.select("id").distinct().join(last, "id", "left").select("id", F.coalesce("_last", F.lit("ACTIVE")).alias("status"))
    return left.filter("status <> 'DELETED'")
