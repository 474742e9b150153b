"""Command line: `python -m eventweave.cli COMMAND`. Runs in the session that spark-submit brings, or a local one."""

from __future__ import annotations

import argparse
import logging
import os
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.functions.vectors import REPRESENTATIONS, WEIGHTS
from eventweave.operators import counting, evaluate, graph
from eventweave.operators.dependencies import build_dependencies, build_groups, keep_lemmas
from eventweave.operators.ordering import spearman, spearman_p
from eventweave.operators.prepare import EXPERIMENTS, ORDERS, PREPARE, pair_mapping, prepare_analogies, prepare_fit, prepare_pairs
from eventweave.operators.representation import Settings, represent, steps_of, trace
from eventweave.session import local_session, materialize, scratch_dir
from eventweave.sources import conll, datasets, files, freqs, graphs, vectors
from eventweave.streaming import counts

#: Options of batches and workers elsewhere.
BATCHING = ("--workers", "--batch-sizes", "--batch-size-stats", "--batch-size-events", "--batch-size-input", "--batch-size-merge")

log = logging.getLogger(__name__)


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or local_session()


def _name(path: str) -> str:
    return os.path.basename(path.rstrip("/"))


def _log_rows(spark: SparkSession, path: str) -> None:
    log.info("%s: %d rows", path, spark.read.text(path).count())


def extraction(a: argparse.Namespace, compression: str, thresholds: bool) -> None:
    """Lemma and/or event frequencies of parsed corpora. Events need lemma counts for their threshold; without a file of them they are counted.

    `stream` works the folders off as streams of files, by the same operators; its results are the batch's.
    """
    spark = _session()
    labels = files.read_labels(spark, a.labels)
    both = not a.s and not a.e
    suffix = "gz" if compression == "gzip" else "txt"
    streamed = a.pipeline == "stream"
    folder = f"{scratch_dir(spark)}/extraction-{uuid.uuid4().hex}"
    if streamed:
        sentences = lambda: reduce(DataFrame.unionByName, [counts.stream_sentences(spark, d, a.delimiter) for d in a.input_dirs])

        def count_lemmas() -> DataFrame:
            counts.run_to_folder(counts.stream_lemma_freqs(sentences(), labels), f"{folder}/lemmas", f"{folder}/lemmas-checkpoint")
            return spark.read.parquet(f"{folder}/lemmas")
    else:
        built = build_dependencies(conll.read_conll(spark, a.input_dirs, a.delimiter), labels)
        if both or (a.e and not a.lemmas_freqs_filepath):
            built = materialize(built, "dependencies")  # read twice

        def count_lemmas() -> DataFrame:
            return counting.lemma_freqs(built)

    from_file = a.e and a.lemmas_freqs_filepath and not both
    lemmas = None if from_file else count_lemmas()
    if a.s or both:
        rows = counting.above(lemmas, a.word_thresh) if thresholds else lemmas
        path = f"{a.output_dir}/lemma-freqs.{suffix}"
        freqs.write_freqs(rows, ["lemma", "pos"], path, compression)
        _log_rows(spark, path)
    if a.e or both:
        accepted = freqs.read_lemma_freqs(spark, a.lemmas_freqs_filepath, a.word_thresh) if a.lemmas_freqs_filepath else counting.above(lemmas, a.word_thresh)
        if streamed:
            events = counts.run_events(sentences(), f"{folder}/events", f"{folder}/events-checkpoint", labels, accepted)
        else:
            groups = build_groups(built).withColumn("uid", F.monotonically_increasing_id()).select("uid", "members")
            events = counting.event_freqs(keep_lemmas(groups, ["uid"], accepted))
        path = f"{a.output_dir}/events-freqs.{suffix}"
        freqs.write_freqs(counting.above(events, a.event_thresh if thresholds else None), ["event"], path, compression)
        _log_rows(spark, path)


def build_graph(a: argparse.Namespace) -> None:
    spark = _session()
    lemmas, events = freqs.read_lemma_freqs(spark, a.lemmas_f), freqs.read_event_freqs(spark, a.events_f)
    bad = {path: freqs.rejected_freqs(spark, path).count() for path in (a.lemmas_f, a.events_f)}
    for path, n in bad.items():
        if n:
            log.warning("%s: %d lines are no item and frequency and were left out", path, n)
    graphs.write_graph_files(graph.build_graph(lemmas, events, a.weights), a.output_dir)
    for name, _ in graphs.FILES.values():
        log.info("%s: %d rows", name, spark.read.csv(f"{a.output_dir}/{name}", sep="\t", header=True, quote="").count())
    missing = graph.orphans(lemmas, events).agg(F.sum("edges")).first()[0]
    if missing:
        log.warning("%d edges to words without a frequency were left out", missing)


def import_graph(a: argparse.Namespace) -> None:
    graphs.save_graph(graphs.read_graph_files(_session(), a.data), a.store)


def possible_relations(a: argparse.Namespace) -> None:
    graphs.write_relation_list(graph.relation_list(graphs.load_graph(_session(), a.store).args), f"{a.output_dir}/relations_list.txt")


def prepare(a: argparse.Namespace) -> None:
    spark = _session()
    for path in a.data:
        stem = _name(path).split(".")[0]
        out = f"{a.output_dir}/{stem}.{a.sequence_order}"
        if a.type == "ks":
            pairs = datasets.read_gold(spark, path)
            datasets.write_items(prepare_pairs(pairs, a.sequence_order), out)
            datasets.write_mapping(pair_mapping(pairs), f"{a.output_dir}/{stem}-mapping.csv")
        elif a.type == "dtfit":
            experiment = stem.split("_")[1] if "_" in stem else ""
            if experiment not in EXPERIMENTS:
                raise ValueError(f"{path}: the name has none of the experiments {', '.join(EXPERIMENTS)}")
            datasets.write_items(prepare_fit(datasets.read_gold(spark, path), experiment, a.sequence_order), out)
        else:
            datasets.write_items(prepare_analogies(datasets.read_gold(spark, path, header=False)), out)


def representations(a: argparse.Namespace) -> None:
    spark = _session()
    g = graphs.load_graph(spark, a.store)
    space = materialize(vectors.read_vectors(spark, a.vectors, length=a.reduced_vec_len), "vectors")
    relations = files.read_relations(spark, a.relations)
    s = Settings(a.N_from_graph, a.M_build_rep, a.rank_forward, a.rank_backward, a.include_same_relations, a.weight_from_graph, a.weight_function, a.representation_function, a.vectors_with_PoS)
    for path in a.data:
        items = datasets.read_items(spark, path)
        datasets.write_results(represent(items, g, space, relations, s), f"{a.output_dir}/{_name(path)}.out")
        if a.trace:
            datasets.write_trace(trace(steps_of(items, g, space, relations, s)[1], s), f"{a.output_dir}/{_name(path)}.log")


def evaluation(a: argparse.Namespace) -> None:
    spark = _session()
    if a.type == "tfit_mit":
        print("there is no score for this type")
        return
    gold, results = datasets.read_gold(spark, a.data), datasets.read_results(spark, a.generated_data)
    if a.type == "ks":
        sims, score = evaluate.pair_similarity(datasets.read_mapping(spark, a.map), results, gold), "score"
    else:
        sims, score = evaluate.filler_similarity(results, gold, vectors.read_vectors(spark, a.vectors)), "mean_rat"
    sims = materialize(sims, "sims")
    n, rho = spearman(sims, score, "sims").first()
    print(f"Spearman's correlation over {n} rows: {rho}, p-value {spearman_p(n, rho)}")
    datasets.write_sims(sims, f"{a.output_dir}/{_name(a.data)}.sims")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="eventweave")
    sub = top.add_subparsers(required=True)

    def command(name: str, run, about: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        p.add_argument("-o", "--output-dir", default="data/results")
        p.set_defaults(run=run)
        return p

    for name, compression, thresholds in (("sequential-extraction", "gzip", False), ("pipeline-extraction", "none", True)):
        p = command(name, lambda a, c=compression, t=thresholds: extraction(a, c, t), "lemma and event frequencies of parsed corpora")
        p.add_argument("-i", "--input-dirs", "--input_dirs", nargs="+", required=True)
        p.add_argument("--delimiter", default=" ")
        p.add_argument("--labels", required=True, help="accepted tags (line 1) and relation prefixes (line 2)")
        p.add_argument("--word-thresh", type=float, default=500)
        p.add_argument("--event-thresh", type=float, default=50)
        p.add_argument("--lemmas-freqs-filepath")
        p.add_argument("-s", action="store_true", help="lemma frequencies only")
        p.add_argument("-e", action="store_true", help="event frequencies only")
        p.add_argument("-p", "--pipeline", choices=["conll", "stream"], default="conll", help="all files at once, or as a stream of files")
        for flag in BATCHING:  # Spark divides the work; command lines that have them go on working
            p.add_argument(flag, nargs="+", type=int, help="has no effect")
    p = command("build-graph", build_graph, "node and edge files of two frequency tables")
    p.add_argument("-l", "--lemmas-f", required=True)
    p.add_argument("-e", "--events-f", required=True)
    p.add_argument("--weights", choices=["zero", "pmi"], default="zero")
    p = command("import-graph", import_graph, "graph files into a table store")
    p.add_argument("-d", "--data", required=True)
    p.add_argument("-n", "--store", "--neo", required=True, help="folder of the table store")
    p.add_argument("--copy", help="has no effect")
    p = command("extract-possible-relations", possible_relations, "roles of the graph's edges")
    p.add_argument("-g", "--store", required=True)
    p = command("prepare-input", prepare, "items of an original dataset")
    p.add_argument("-d", "--data", nargs="+", required=True)
    p.add_argument("-t", "--type", required=True, choices=list(PREPARE))
    p.add_argument("--sequence-order", choices=list(ORDERS), default="head_verbs_args")
    p = command("build-representations", representations, "vectors of items")
    p.add_argument("-g", "--store", required=True)
    p.add_argument("-r", "--relations", required=True)
    p.add_argument("-d", "--data", nargs="+", required=True)
    p.add_argument("-v", "--vectors", required=True)
    p.add_argument("--weight-function", choices=list(WEIGHTS), default="cosine")
    p.add_argument("--not-rank-forward", dest="rank_forward", action="store_false")
    p.add_argument("--not-rank-backward", dest="rank_backward", action="store_false")
    p.add_argument("-N", "--N-from-graph", type=int, default=50)
    p.add_argument("-M", "--M-build-rep", type=int, default=20)
    p.add_argument("--representation-function", choices=list(REPRESENTATIONS), default="centroid")
    p.add_argument("--include-same-relations", action="store_true")
    p.add_argument("--weight-from-graph", choices=["pmi", "lmi"], default="pmi")
    p.add_argument("--reduced-vec-len", type=int, default=-1)
    p.add_argument("--vectors_with_PoS", action="store_true")
    p.add_argument("--trace", action="store_true", help="write the labels of the active context after each step")
    p = command("compute-evaluation", evaluation, "scores of representations")
    p.add_argument("-d", "--data", required=True)
    p.add_argument("-g", "--generated_data", required=True)
    p.add_argument("-m", "--map")
    p.add_argument("-t", "--type", required=True, choices=list(PREPARE))
    p.add_argument("-v", "--vectors")
    return top


def main(argv: Sequence[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    a = parser().parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
