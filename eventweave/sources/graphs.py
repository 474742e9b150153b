"""The graph as tables and as tab-separated files with typed headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.operators.graph import Graph, import_graph

#: The headers of the files, in the order of their columns.
WORDS = {"wordId:ID(word-ID)": "word_id bigint", "form": "form string", "POS": "pos string", "freq:int": "freq bigint", "prob:float": "prob double"}
EVENTS = {"eventId:ID(event-ID)": "event_id bigint", "form": "form string", "freq:int": "freq bigint", "prob:float": "prob double", "deg:int": "deg int"}
EDGES = {":START_ID(event-ID)": "event_id bigint", "freq:int": "freq bigint", "prob:float": "prob double", "pmi:float": "pmi double", "degree:int": "degree int", "role": "role string", ":END_ID(word-ID)": "word_id bigint"}
FILES = {"words": ("words_nodes.csv", WORDS), "events": ("events_nodes.csv", EVENTS), "args": ("event-word_edges.csv", EDGES)}


def _names(columns: dict[str, str]) -> list[str]:
    return [x.split(" ")[0] for x in columns.values()]


def write_graph_files(graph: Graph, folder: str, head: str = "HEAD") -> None:
    """Three folders of tab-separated files, each with its header; a null role is written as `head`."""
    for part, (name, columns) in FILES.items():
        df = getattr(graph, part).select(*_names(columns))
        if part == "args":
            df = df.withColumn("role", F.coalesce("role", F.lit(head)))
        df.toDF(*columns).write.mode("overwrite").csv(f"{folder}/{name}", sep="\t", header=True, quote="", escapeQuotes=False, emptyValue="")


def read_graph_files(spark: SparkSession, folder: str, head: str | None = "HEAD") -> Graph:
    """The graph of such files, as an import takes it: ids once, only edges with both ends. Roles equal to `head` become null."""
    got = {}
    for part, (name, columns) in FILES.items():
        got[part] = spark.read.csv(f"{folder}/{name}", sep="\t", header=True, quote="", schema=", ".join(columns.values()), enforceSchema=True)
    if head is not None:
        got["args"] = got["args"].withColumn("role", F.when(F.col("role") != head, F.col("role")))
    return import_graph(**got)


def save_graph(graph: Graph, folder: str, buckets: int | None = None, database: str | None = None) -> None:
    """Parquet tables words, events, args (and asso). With a database they are saved as tables, `args` in `buckets` by event, so hops need no shuffle of it."""
    for part in ("words", "events", "args", "asso"):
        df: DataFrame | None = getattr(graph, part)
        if df is None:
            continue
        writer = df.write.mode("overwrite").format("parquet")
        if database:
            key = {"words": "word_id", "events": "event_id", "args": "event_id", "asso": "word_id"}[part]
            writer = writer.bucketBy(buckets, key).sortBy(key) if buckets else writer
            writer.saveAsTable(f"{database}.{part}")
        else:
            writer.save(f"{folder}/{part}")


def load_graph(spark: SparkSession, folder: str | None = None, database: str | None = None) -> Graph:
    """The saved graph: what a connection to a graph server is elsewhere."""
    read = (lambda x: spark.table(f"{database}.{x}")) if database else (lambda x: spark.read.parquet(f"{folder}/{x}"))
    return Graph(read("words"), read("events"), read("args"))


def write_relation_list(roles: DataFrame, path: str) -> None:
    """One role a line."""
    roles.select("role").orderBy("role").write.mode("overwrite").text(path)
