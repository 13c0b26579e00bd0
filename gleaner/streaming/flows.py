"""Streaming forms: stateless stages run on streams as they are; keep-first dedup goes through micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.model import core_text
from gleaner.operators.stages import exact_dedup
from gleaner.operators.state import State


def dedup_batch(state: State, on_result: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: exact dedup of a micro-batch against all accepted fingerprints. A batch that is run
    again first forgets its own earlier fingerprints, so results are the same however often it is retried."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = f"{state.root}/fingerprints"
        try:
            history = spark.read.schema("hash string, sample_id string, batch_id int").parquet(folder).filter(F.col("batch_id") != batch_id)
            history.limit(0).count()
        except Exception as error:  # nothing accepted yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            history = spark.createDataFrame([], "hash string, sample_id string, batch_id int")
        from gleaner.session import cut

        done = cut(exact_dedup(history.select("hash"))(batch))
        kept = done.filter("drop_stage is null")
        state.append("fingerprints", kept.select(T.fingerprint(core_text(kept)).alias("hash"), F.col("id").alias("sample_id")), batch_id)
        if on_result:
            on_result(done, batch_id)

    return run


def stream_dedup(samples: DataFrame, state: State, checkpoint: str, on_result: Callable[[DataFrame, int], None] | None = None, available_now: bool = True):
    """Start exact dedup over a stream of canonical samples; the query's own checkpoint resumes it."""
    writer = samples.writeStream.foreachBatch(dedup_batch(state, on_result)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Files of a folder as a stream with bounded micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
