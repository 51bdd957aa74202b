"""Time stamps beside a stream of manifests: asked for in tasks, stored once, and never in the way of sealing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sealwright.functions.hashing import IMPRINT_TAG, stamp_imprint, stamp_request
from sealwright.streaming.counters import Counters, observe_stamps

ANSWERS = "log_id string, segment_id long, status string, error string, content binary"
_KEYS = ["log_id", "segment_id"]


def ask(manifests: DataFrame, send: Callable[[bytes], bytes]) -> DataFrame:
    """(log_id, segment_id, status, error, content): each manifest's answer from send(request), asked for where the row lies.

    status: stored, or failed if send raises or answers for another digest; then error says why and content is null. One failure
    doesn't touch the others. send goes to the executors; see sources.logs.http_sender.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for log_id, segment_id, digest, request in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    answer = send(request)
                    if IMPRINT_TAG + digest not in answer:
                        raise ValueError("the answer is for another digest")
                    rows.append((log_id, segment_id, "stored", None, answer))
                except Exception as e:  # fail-open: the manifest stays valid without a stamp
                    rows.append((log_id, segment_id, "failed", f"{type(e).__name__}: {e}"[:500], None))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in ANSWERS.split(", ")])

    digest = stamp_imprint(F.col("segment_chain_hash"))
    return manifests.select("log_id", "segment_id", digest.alias("digest"), stamp_request(digest).alias("request")).mapInArrow(run, ANSWERS)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """All answers of a folder with their batch; none if nothing has been asked."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], f"{ANSWERS}, batch long")
    return spark.read.schema(f"{ANSWERS}, batch long").parquet(folder)


def stored_stamps(spark: SparkSession, folder: str) -> DataFrame:
    """(log_id, segment_id, content) of stored answers, as operators.evidence.verify_stamps takes them."""
    return answers(spark, folder).where("status = 'stored'").select("log_id", "segment_id", "content")


class StampSink:
    """What foreachBatch calls: a batch's manifests are asked about and stored under the batch's id.

    A batch that is run again finds its folder complete and does nothing, or replaces what a lost run has left. A segment that an earlier
    batch has stored isn't asked about again; one that failed is, once it comes again. The folder belongs to one checkpoint.
    """

    def __init__(self, folder: str, send: Callable[[bytes], bytes], counters: Counters | None = None):
        self.folder, self.send, self.counters = folder.rstrip("/"), send, counters

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = f"{self.folder}/batch={batch_id}"
        if _exists(spark, f"{path}/_SUCCESS"):
            return
        done = answers(spark, self.folder).where((F.col("status") == "stored") & (F.col("batch") != batch_id)).select(*_KEYS).distinct()
        once = Window.partitionBy(*_KEYS).orderBy("segment_chain_hash")
        fresh = batch.select(*_KEYS, "segment_chain_hash").where("segment_chain_hash IS NOT NULL").withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
        if self.counters is None:
            ask(fresh.join(done, _KEYS, "left_anti"), self.send).write.mode("overwrite").parquet(path)
            return
        from pyspark.sql import Observation

        seen = Observation()
        observe_stamps(ask(fresh.join(done, _KEYS, "left_anti"), self.send), seen).write.mode("overwrite").parquet(path)
        self.counters.count("stamps", **seen.get)


def stamp_stream(manifests: DataFrame, send: Callable[[bytes], bytes], folder: str, checkpoint: str, counters: Counters | None = None, **trigger) -> StreamingQuery:
    """Starts stamping a stream of manifests (log_id, segment_id, segment_chain_hash); trigger: as DataStreamWriter.trigger's."""
    w = manifests.writeStream.foreachBatch(StampSink(folder, send, counters)).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()
