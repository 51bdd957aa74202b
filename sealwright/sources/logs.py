"""Logs as JSON lines, segment manifests and time-stamp responses as files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwright.errors import LogHalted, LogParseError
from sealwright.model import ENTRY, ENTRY_REQUIRED, MANIFEST


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their position: value, file, line (from 1 in its file).

    A line's number is its place in its piece of the file plus the lines of the pieces before;
    only one count for each piece of a file is gathered.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    from pyspark.sql import Window

    pieces = raw.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return raw.join(pieces.select("file", "start", "low", "before"), ["file", "start"]).select("value", "file", (F.col("before") + F.col("id") - F.col("low") + 1).alias("line"))


def parse_entries(lines: DataFrame, strict: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Lines (value, file, line and the columns to keep) as entries.

    Unknown fields are ignored. A line that isn't JSON, or lacks a field, is an error that names the
    first such line; with strict=False such lines come back with a problem instead.
    """
    own = [*(keep or []), "file", "line"]
    rows = lines.select(*own, F.from_json("value", _with_corrupt(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"), "value")
    lost = [F.when(F.col(f"e.{c}").isNull(), F.lit(c)) for c in ENTRY_REQUIRED]
    missing = F.array_compact(F.array(*lost))
    problem = F.when(F.col("e._corrupt").isNotNull() | F.col("e").isNull(), "not JSON").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    rows = rows.select(*own, "e.*", problem.alias("problem")).drop("_corrupt")
    if strict:
        bad = rows.where("problem IS NOT NULL").orderBy("file", "line").limit(1).collect()
        if bad:
            raise LogParseError(f"{bad[0]['file']}, line {bad[0]['line']}: {bad[0]['problem']}")
        rows = rows.drop("problem")
    return rows


def read_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Entries of a JSON-lines log with file, line (from 1) and pos (from 0, blank lines skipped), file by file; see parse_entries."""
    from pyspark.sql import Window

    rows = parse_entries(read_lines(spark, path).where(F.trim("value") != ""), strict)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1)


def _with_corrupt():
    from pyspark.sql import types as T

    return T.StructType([*ENTRY.fields, T.StructField("_corrupt", T.StringType())])


def append_log(entries: DataFrame, path: str) -> None:
    """Adds entries as JSON lines, in order of seq inside each new file. A failed write raises: nothing is skipped."""
    names = [f.name for f in ENTRY]
    ordered = entries.repartitionByRange("seq").sortWithinPartitions("seq")
    ordered.select(F.to_json(F.struct(*names)).alias("value")).write.mode("append").text(path)


class LogWriter:
    """Appends to one log, and takes no more once an append has failed: what came after it would hide the gap."""

    def __init__(self, path: str):
        self.path, self.halted = path, False

    def append(self, entries: DataFrame) -> None:
        if self.halted:
            raise LogHalted(f"{self.path} takes no more entries: an append failed")
        try:
            append_log(entries, self.path)
        except Exception:
            self.halted = True
            raise


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of a folder in order of segment_id; a folder that isn't there has none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.manifest.json").json(path).orderBy("segment_id")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def manifest_name(segment_id: int) -> str:
    return f"{segment_id:06d}.manifest.json"


def stamp_name(segment_id: int) -> str:
    return f"{segment_id:06d}.tsr"


def publish(folder: str, name: str, data: bytes) -> str:
    """Writes a file at once: to a temporary name, to disk, then renamed."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path + ".tmp", "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".tmp", path)
    return path


def write_manifest(folder: str, manifest: dict) -> str:
    """One manifest as a file of its own."""
    return publish(folder, manifest_name(manifest["segment_id"]), json.dumps({f.name: manifest.get(f.name) for f in MANIFEST}, indent=2).encode())


def read_stamps(spark: SparkSession, path: str) -> DataFrame:
    """Time-stamp responses NNNNNN.tsr: segment_id, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tsr").load(path)
    return files.select(F.regexp_extract("path", r"(\d{6})\.tsr$", 1).cast("long").alias("segment_id"), "content")


def submit_stamps(manifests: DataFrame, folder: str, send) -> tuple[int, int]:
    """Asks a time-stamp authority about each manifest: send(request bytes) -> response bytes.

    Failures don't stop the run. Returns (stored, failed); only answers with the digest are stored.
    """
    from sealwright.functions.hashing import IMPRINT_TAG, stamp_imprint, stamp_request

    ok = failed = 0
    rows = manifests.select("segment_id", stamp_imprint(F.col("segment_chain_hash")).alias("digest"))
    for r in rows.select("segment_id", "digest", stamp_request(F.col("digest")).alias("request")).toLocalIterator():
        try:
            answer = send(bytes(r["request"]))
            if IMPRINT_TAG + bytes(r["digest"]) not in answer:
                raise ValueError("the answer is for another digest")
            publish(folder, stamp_name(r["segment_id"]), answer)
            ok += 1
        except Exception:
            failed += 1
    return ok, failed


def http_sender(url: str, timeout: float = 10.0):
    """A send function for submit_stamps that posts to a time-stamp authority."""
    import urllib.request

    def send(request: bytes) -> bytes:
        ask = urllib.request.Request(url, data=request, headers={"Content-Type": "application/timestamp-query"})
        with urllib.request.urlopen(ask, timeout=timeout) as r:
            return r.read()

    return send
