"""Lemma and event counts over a stream of corpus files, by the row-local operators of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventweave.functions.labels import Labels
from eventweave.functions.sets import explode_subsets
from eventweave.operators.counting import GROUP_LIMIT, event_freqs, lemma_freqs, merge_freqs
from eventweave.operators.dependencies import build_dependencies, build_groups, keep_lemmas
from eventweave.operators.sentences import text_sentences
from eventweave.sources.conll import split_blocks


def stream_sentences(spark: SparkSession, folder: str, delimiter: str = " ", files_per_trigger: int = 1000) -> DataFrame:
    """(tokens) of the sentences of files as they arrive in a folder; a sentence with a line that isn't six fields is dropped.

    Files are divided at empty lines and then at lines of white space; a file with carriage returns throughout is one row.
    """
    texts = spark.readStream.option("lineSep", "\n\n").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return text_sentences(split_blocks(texts), "value", delimiter, strict=False)


def stream_lemma_freqs(sentences: DataFrame, labels: Labels = Labels()) -> DataFrame:
    """(lemma, pos, freq) so far; the state is one counter a lemma, and counts have no window, so no watermark either."""
    return lemma_freqs(build_dependencies(sentences, labels))


def stream_event_freqs(sentences: DataFrame, labels: Labels = Labels(), limit: int = GROUP_LIMIT) -> DataFrame:
    """(event, freq) so far, of all lemmas."""
    groups = build_groups(build_dependencies(sentences, labels)).filter(F.size("members") < limit)
    events = explode_subsets(groups.select("members"), "members", "event")
    return events.groupBy(F.array_join("event", " ").alias("event")).agg(F.count(F.lit(1)).alias("freq"))


def run_to_folder(counts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Work off all files that are there and write the counts so far to `folder`, replaced as a whole by each batch; a restart goes on from the checkpoint."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_events(sentences: DataFrame, folder: str, checkpoint: str, labels: Labels = Labels(), accepted: DataFrame | None = None) -> DataFrame:
    """(event, freq) of all files that are there, only of lemmas in the static table `accepted` (lemma, pos).

    Each batch meets the table in the batch operators' semi join and is merged into the counts of the batch before. A batch writes a folder of its own
    number, so one that is repeated after a failure writes the same again.
    """
    spark = sentences.sparkSession
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        groups = build_groups(build_dependencies(batch, labels)).withColumn("uid", F.monotonically_increasing_id())
        new = event_freqs(keep_lemmas(groups.select("uid", "members"), ["uid"], accepted))
        if number:
            new = merge_freqs([spark.read.parquet(f"{folder}/batch={number - 1}"), new], ["event"])
        new.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        done.append(number)

    query = sentences.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    last = done[-1] if done else (query.lastProgress or {"batchId": 0})["batchId"]
    return spark.read.parquet(f"{folder}/batch={last}")
