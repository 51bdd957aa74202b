"""Streaming: interactions audited, chained and sealed as they arrive.

State is kept for each log, in parts that change at their own pace: the chain's head (a value), the open segment's
leaves (a list that is only added to until the segment closes), where the last segment ended (a value), and a timer.
A segment closes when it has `size` entries, `interval` seconds after the last seal, or when a row asks for it.
"""

from __future__ import annotations

import datetime
import hashlib
import sys
import time
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sealwright.config import AUDIT_GENESIS, SEGMENT_GENESIS
from sealwright.functions.hashing import CHAIN_FIELDS, EMPTY_ROOT, entry_leaf
from sealwright.model import SEGMENT_SCHEMA
from sealwright.operators.chain import heads
from sealwright.operators.merkle import ordered
from sealwright.operators.segments import sealed_so_far, unsealed

SEALED = "log_id string, kind string, seq long, prev_hash string, chain_hash string, schema string, segment_id long, first_seq long, last_seq long, entry_count long, merkle_root string, prev_merkle_root string, prev_segment_chain_hash string, segment_chain_hash string, head_chain_hash_at_close string, sealed_at string"
_NAMES = [x.split()[0] for x in SEALED.split(", ")]
ARRIVE = 1 << 19  # rows of a file of arrivals
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sha(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


def fold_root(leaves: list[bytes]) -> str:
    """Root of leaf hashes: neighbours are paired level by level, an odd last one goes up unchanged."""
    if not leaves:
        return EMPTY_ROOT
    while len(leaves) > 1:
        up = [_sha(b"\x01", a, b) for a, b in zip(leaves[::2], leaves[1::2])]
        leaves = up + leaves[len(up) * 2 :]
    return leaves[0].hex()


class LogState:
    """One log's state: what comes in is chained, what is full is sealed.

    values: as values() gives them. Leaves that lie in a store needn't be in them: `stored` tells their number and `load` fetches
    them, which only a seal does.
    """

    def __init__(self, log_id: str, values: tuple | None, size: int, sealed_at: str, now_ms: int, genesis=(AUDIT_GENESIS, SEGMENT_GENESIS), stored: int = 0, load: Callable[[], list[bytes]] | None = None):
        self.log_id, self.size, self.sealed_at = log_id, size, sealed_at
        self.head, self.seq, leaves, self.segment_id, self.root, self.chain, self.sealed_ms = values or (genesis[0], 0, [], 0, EMPTY_ROOT, genesis[1], now_ms)
        self.leaves, self.stored, self.load = list(leaves), stored, load
        self.rows: list[dict] = []

    def values(self) -> tuple:
        return (self.head, self.seq, list(self.leaves), self.segment_id, self.root, self.chain, self.sealed_ms)

    @property
    def open(self) -> int:
        """Entries of the open segment."""
        return self.stored + len(self.leaves)

    def append(self, fields: dict, now_ms: int) -> None:
        """Chains an entry; a segment that then has `size` entries or more (as after a start with a long tail) closes whole."""
        prev, seq = self.head, self.seq
        parts = [fields[f] for f in (*CHAIN_FIELDS, "timestamp")]
        if any(p is None for p in parts):
            raise ValueError(f"entry {seq} of log {self.log_id} has a null field")
        text = "|".join([prev, *map(str, parts[:-1]), str(seq), str(parts[-1])])
        self.head = hashlib.sha256(text.encode()).hexdigest()
        self.seq += 1
        self.leaves.append(_sha(b"\x00", bytes.fromhex(self.head)))
        self.rows.append({"log_id": self.log_id, "kind": "entry", "seq": seq, "prev_hash": prev, "chain_hash": self.head})
        if self.size and self.open >= self.size:
            self.seal(now_ms)

    def seal(self, now_ms: int) -> None:
        """Closes the open segment, if it has entries."""
        if not self.open:
            return
        leaves = [*(self.load() if self.stored else ()), *self.leaves]
        first, last = self.seq - len(leaves), self.seq - 1
        root = fold_root(leaves)
        at = self.sealed_at or datetime.datetime.fromtimestamp(now_ms / 1000, datetime.timezone.utc).isoformat()
        chain = hashlib.sha256("|".join([self.chain, root, str(first), str(last), at]).encode()).hexdigest()
        self.segment_id += 1
        self.rows.append(
            {"log_id": self.log_id, "kind": "manifest", "schema": SEGMENT_SCHEMA, "segment_id": self.segment_id, "first_seq": first, "last_seq": last, "entry_count": len(leaves), "merkle_root": root}
            | {"prev_merkle_root": self.root, "prev_segment_chain_hash": self.chain, "segment_chain_hash": chain, "head_chain_hash_at_close": self.head, "sealed_at": at}
        )
        self.root, self.chain, self.leaves, self.stored, self.sealed_ms = root, chain, [], 0, now_ms


class Sealer(StatefulProcessor):
    """Holds each log's LogState in Spark's state store. interval_ms of 0: no timer."""

    def __init__(self, size: int, interval_ms: int, sealed_at: str):
        self.size, self.interval_ms, self.sealed_at = size, interval_ms, sealed_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "chain_hash string, next_seq long, open_leaves long")
        self.leaves = handle.getListState("leaves", "leaf binary")
        self.last = handle.getValueState("last", "segment_id long, merkle_root string, segment_chain_hash string, sealed_ms long")

    def _take(self, log_id: str, now: int) -> LogState:
        head = self.head.get() if self.head.exists() else None
        if head is None:
            return LogState(log_id, None, self.size, self.sealed_at, now)
        return LogState(log_id, (head[0], head[1], [], *self.last.get()), self.size, self.sealed_at, now, stored=head[2], load=lambda: [bytes(x[0]) for x in self.leaves.get()])

    def _put(self, log: LogState, before: int, now: int) -> None:
        """before: how many leaves the store had; fewer now means that they were sealed."""
        if log.stored < before:
            self.leaves.clear()
        if log.leaves:
            self.leaves.appendList([(x,) for x in log.leaves])
        self.head.update((log.head, log.seq, log.open))
        self.last.update((log.segment_id, log.root, log.chain, log.sealed_ms))
        if self.interval_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if log.open:
                self.handle.registerTimer(max(now + 1, log.sealed_ms + self.interval_ms))

    def _rows(self, log: LogState) -> Iterator[Row]:
        for r in log.rows:
            yield Row(**{n: r.get(n) for n in _NAMES})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.interval_ms else 0
        log = self._take(key[0], now)
        before, entries, flush = log.stored, [], False
        for r in rows:
            if "flush" in r and r["flush"]:
                flush = True
            else:
                entries.append(r)
        for r in sorted(entries, key=lambda r: r["order_key"]):
            log.append(r, now)
        if flush or (self.interval_ms and log.open and now - log.sealed_ms >= self.interval_ms):
            log.seal(now)
        self._put(log, before, now)
        return self._rows(log)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        log = self._take(key[0], now)
        before = log.stored
        log.seal(now)
        self._put(log, before, now)
        return self._rows(log)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A log taken up from log and manifests; its interval begins anew."""
        now = timerValues.getCurrentProcessingTimeInMs() if self.interval_ms else 0
        s = initialState
        leaves = [bytes(x) for x in s["leaves"]]
        log = LogState(key[0], (s["chain_hash"], s["next_seq"], leaves, s["segment_id"], s["merkle_root"], s["segment_chain_hash"], now), self.size, self.sealed_at, now)
        self._put(log, 0, now)

    def close(self) -> None:
        pass


def resume_state(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Where each log's sealing goes on, from its entries (log_id, seq, chain_hash) and manifests alone: initialState of seal_stream.

    The leaves of entries that no manifest holds come back as the open segment. Logs without manifests start from the first
    link of the segment chain.
    """
    last = sealed_so_far(found).select("log_id", F.col("last_id").alias("segment_id"), F.col("last_root").alias("merkle_root"), F.col("last_chain").alias("segment_chain_hash"))
    tail = unsealed(entries.select("log_id", "seq", "chain_hash"), found).groupBy("log_id").agg(ordered(entry_leaf(F.col("chain_hash")), F.col("seq")).alias("leaves"))
    both = heads(entries, pos="seq").join(last, "log_id", "left").join(tail, "log_id", "left")
    or_else = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return both.select("log_id", "chain_hash", "next_seq", or_else("segment_id", 0).cast("long").alias("segment_id"), or_else("merkle_root", EMPTY_ROOT), or_else("segment_chain_hash", SEGMENT_GENESIS), F.coalesce("leaves", F.array().cast("array<binary>")).alias("leaves"))


def write_arrivals(rows: DataFrame, path: str, order: list[str], most: int = ARRIVE) -> int:
    """Writes rows as files of about `most` rows, which arrive in the given order; the number of files that were asked for.

    A stream with maxFilesPerTrigger of 1 takes them up in that order, one batch for each: a task then holds one log's rows of one file.
    """
    spark = rows.sparkSession
    files = max(1, -(-rows.count() // most))
    rows.repartitionByRange(files, *order).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda x: x.getName())
    start = int(time.time() - len(found)) * 1000  # a stream goes by the files' times
    for i, file in enumerate(found):
        store.setTimes(file, start + i * 1000, -1)
    return files


def seal_stream(entries: DataFrame, size: int = 1000, interval_seconds: int = 0, sealed_at: str = "", initial: DataFrame | None = None) -> DataFrame:
    """Entries (log_id, order_key, timestamp and the chain's fields) of a stream as chained entries and sealed manifests.

    Rows have kind `entry` or `manifest`. Inside a batch, a log's entries follow order_key; over batches,
    their arrival. size or interval_seconds of 0 turns that trigger off. sealed_at: a fixed time for
    repeatable runs, else the clock's, which only runs with interval_seconds.

    A task holds what one log has in one batch, so a source with a large backlog should be read with a limit (maxFilesPerTrigger or
    maxBytesPerTrigger); see write_arrivals.

    A row whose boolean column `flush` is true isn't an entry: it closes its log's open segment once the batch's
    entries are in. Send one for each log before a stream is shut down for good.

    initial: rows of resume_state. A new checkpoint then goes on where a lost or stopped sealer's log and manifests end; a tail
    of `size` entries or more closes as one segment with the next entry.

    The session keeps state in RocksDB from now on, which this kind of state needs.
    """
    if not sealed_at and not interval_seconds:
        raise ValueError("manifests need a time: set sealed_at, or interval_seconds for the clock's")
    # the worker that sets up the state gets none of the session's files: the processor travels with its code
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    entries.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    state = None if initial is None else initial.groupBy("log_id")
    mode = "ProcessingTime" if interval_seconds else "None"
    return entries.groupBy("log_id").transformWithState(Sealer(size, interval_seconds * 1000, sealed_at), SEALED, "append", mode, state)
