"""A folder of logs as a data source with commits: an append is there as a whole or not at all, and can't fork a chain.

    <folder>/<log>/<first seq>-<id>.jsonl    entries, one JSON object a line
    <folder>/_commits/<version>.json         the files an append has added, and the heads of the logs it touched

Tasks write files that nobody sees yet. The commit checks on the driver that every log's new entries link up, from the head that the log
has at that moment, and then creates the next version's file, which must not exist: of two writers with the same head one
fails. What isn't named by a commit is never read. The folder has to be on a file system that all machines mount.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from sealwright.config import AUDIT_GENESIS
from sealwright.errors import LogHalted
from sealwright.model import ENTRY
from sealwright.operators.chain import append_chain
from sealwright.sources.logs import parse_entries

FORMAT = "sealwright_log"
_COMMITS = "_commits"
_FIELDS = [f.name for f in ENTRY]


@dataclass
class Run:
    """Entries of one log that follow each other in one file."""

    log_id: str
    file: str
    first_seq: int
    last_seq: int
    prev_hash: str
    chain_hash: str


@dataclass
class Staged(WriterCommitMessage):
    runs: list[Run] = field(default_factory=list)


def _versions(folder: str) -> list[str]:
    at = os.path.join(folder, _COMMITS)
    return sorted(n for n in os.listdir(at) if n.endswith(".json")) if os.path.isdir(at) else []


def _head_of(folder: str, versions: list[str], wanted: set[str]) -> dict[str, tuple[int, str]]:
    """Heads of the wanted logs: the latest commits that touched them."""
    found: dict[str, tuple[int, str]] = {}
    for name in reversed(versions):
        if len(found) == len(wanted):
            break
        with open(os.path.join(folder, _COMMITS, name)) as f:
            heads = json.load(f)["heads"]
        for log in wanted - found.keys():
            if log in heads:
                found[log] = (heads[log]["next_seq"], heads[log]["chain_hash"])
    return found


def _dump(value):
    return value.asDict(recursive=True) if isinstance(value, Row) else [_dump(v) for v in value] if isinstance(value, list) else value


class LogDataWriter(DataSourceWriter):
    """Stages rows (log_id and an entry's fields, sorted by log and seq inside a task) and commits them."""

    def __init__(self, folder: str, genesis: str):
        self.folder, self.genesis = folder, genesis

    def write(self, iterator: Iterator[Row]) -> Staged:
        out, stream = Staged(), None
        try:
            for row in iterator:
                row = row.asDict()  # a Row looks each name up in a list
                if None in row.values() and (lost := [n for n in ("log_id", *_FIELDS) if row[n] is None]):
                    raise ValueError(f"an entry lacks {', '.join(lost)}: {row}")
                run = out.runs[-1] if out.runs else None
                if run is None or run.log_id != row["log_id"] or row["seq"] != run.last_seq + 1:
                    if stream:
                        self._close(stream)
                    home = os.path.join(self.folder, quote(row["log_id"], safe=""))
                    os.makedirs(home, exist_ok=True)
                    run = Run(row["log_id"], os.path.join(home, f"{row['seq']:020d}-{uuid.uuid4().hex}.jsonl"), row["seq"], row["seq"], row["prev_hash"], row["chain_hash"])
                    out.runs.append(run)
                    stream = open(run.file, "w", encoding="utf-8")
                elif row["prev_hash"] != run.chain_hash:
                    raise ValueError(f"entry {row['seq']} of log {row['log_id']} doesn't link to the one before it")
                stream.write(json.dumps({n: _dump(row[n]) for n in _FIELDS}, ensure_ascii=False) + "\n")
                run.last_seq, run.chain_hash = row["seq"], row["chain_hash"]
            if stream:
                self._close(stream)
                stream = None
        except BaseException:
            if stream:
                stream.close()
            self.abort([out])
            raise
        return out

    @staticmethod
    def _close(stream) -> None:
        stream.flush()
        os.fsync(stream.fileno())
        stream.close()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Publishes all or nothing. Another writer's commit in between is no harm unless it touched one of these logs."""
        runs = sorted((r for m in messages if m for r in m.runs), key=lambda r: (r.log_id, r.first_seq, r.last_seq))
        if not runs:
            return
        try:
            os.makedirs(os.path.join(self.folder, _COMMITS), exist_ok=True)
            while True:
                versions = _versions(self.folder)
                heads = _head_of(self.folder, versions, {r.log_id for r in runs})
                for r in runs:
                    seq, chain = heads.get(r.log_id, (0, self.genesis))
                    if (r.first_seq, r.prev_hash) != (seq, chain):
                        raise LogHalted(f"log {r.log_id} goes on with entry {seq} after {chain}, not with entry {r.first_seq} after {r.prev_hash}")
                    heads[r.log_id] = (r.last_seq + 1, r.chain_hash)
                body = {"files": [os.path.relpath(r.file, self.folder) for r in runs], "heads": {k: {"next_seq": s, "chain_hash": c} for k, (s, c) in heads.items()}}
                number = int(versions[-1].split(".")[0]) + 1 if versions else 0
                if self._create(number, json.dumps(body)):
                    return
        except BaseException:
            self.abort(messages)
            raise

    def _create(self, number: int, body: str) -> bool:
        """The version's file, unless there is one. It gets its name only when it is whole: a link fails where the name is taken."""
        name = os.path.join(self.folder, _COMMITS, f"{number:020d}.json")
        part = f"{name}.{uuid.uuid4().hex}.part"
        with open(part, "w") as f:
            f.write(body)
            self._sync(f)
        try:
            os.link(part, name)
        except FileExistsError:
            return False
        finally:
            os.remove(part)
        return True

    @staticmethod
    def _sync(f) -> None:
        f.flush()
        os.fsync(f.fileno())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What lost tasks have left stays invisible; what is known goes."""
        for r in (r for m in messages if m for r in m.runs):
            if os.path.exists(r.file):
                os.remove(r.file)


class LogSource(DataSource):
    """spark.dataSource.register(LogSource), then df.write.format(FORMAT).mode("append").option("path", folder).save()."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType([*StructType.fromDDL("log_id string"), *ENTRY])

    def writer(self, schema: StructType, overwrite: bool) -> LogDataWriter:
        if overwrite:
            raise ValueError("logs are only appended to")
        missing = {"log_id", *_FIELDS} - set(schema.names)
        if missing:
            raise ValueError(f"entries lack {', '.join(sorted(missing))}")
        return LogDataWriter(self.options["path"], self.options.get("genesis", AUDIT_GENESIS))


class AuditLogs:
    """A folder of logs: opened by its commits, read as they say, and appended to from the heads they leave."""

    def __init__(self, spark: SparkSession, folder: str, genesis: str = AUDIT_GENESIS):
        plain = re.sub("^file:(//)?(?=/)", "", folder)
        if "://" in plain:
            raise ValueError(f"logs need a mounted folder, not {folder}")
        self.spark, self.folder, self.genesis = spark, os.path.abspath(plain), genesis
        spark.dataSource.register(LogSource)

    def _commits(self) -> DataFrame | None:
        return self.spark.read.option("wholetext", True).text(f"file://{self.folder}/{_COMMITS}/*.json").select(F.col("value"), F.col("_metadata.file_name").alias("version")) if _versions(self.folder) else None

    def heads(self) -> DataFrame:
        """(log_id, next_seq, chain_hash) of every log: where it goes on. No entry is read."""
        commits = self._commits()
        if commits is None:
            return self.spark.createDataFrame([], "log_id string, next_seq long, chain_hash string")
        rows = commits.select("version", F.explode(F.from_json(F.get_json_object("value", "$.heads"), "map<string, struct<next_seq: long, chain_hash: string>>")).alias("log_id", "h"))
        return rows.groupBy("log_id").agg(F.max_by("h", "version").alias("h")).select("log_id", "h.next_seq", "h.chain_hash")

    def read(self, strict: bool = True) -> DataFrame:
        """All committed entries with log_id and pos. The order of a log is its files' names, then lines; pos is seq, which commits have checked."""
        commits = self._commits()
        if commits is None:
            return self.spark.createDataFrame([], StructType([*StructType.fromDDL("log_id string, file string"), *ENTRY, *StructType.fromDDL("pos long")]))
        named = commits.select(F.explode(F.from_json(F.get_json_object("value", "$.files"), "array<string>")).alias("name")).select(F.substring_index("name", "/", 1).alias("home"), F.substring_index("name", "/", -1).alias("base"))
        lines = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(f"file://{self.folder}").select("value", F.col("_metadata.file_name").alias("base"))
        met = lines.join(named, "base").where(F.trim("value") != "").select(F.url_decode("home").alias("log_id"), F.col("base").alias("file"), F.lit(None).cast("long").alias("line"), "value")
        return parse_entries(met, strict, keep=["log_id"]).drop("line").withColumn("pos", F.col("seq"))

    def append(self, rows: DataFrame, order: list[str]) -> None:
        """Opens, numbers, chains, writes and commits in one call: rows have log_id and an entry's fields but seq and the two hashes.

        A log's rows get the next numbers in the given order. If another writer has added to one of these logs since it was
        opened, LogHalted's message comes back as an error and nothing is written: open again and append again.
        """
        self._commit(append_chain(rows, order, genesis=self.genesis, heads=self.heads()))  # comes log by log, in order

    def write(self, linked: DataFrame) -> None:
        """Commits entries that are numbered and chained already."""
        self._commit(linked.repartition("log_id").sortWithinPartitions("log_id", "seq"))

    def _commit(self, sorted_: DataFrame) -> None:
        sorted_.select("log_id", *_FIELDS).write.format(FORMAT).mode("append").option("path", self.folder).option("genesis", self.genesis).save()

