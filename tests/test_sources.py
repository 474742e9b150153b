import numpy as np
import pytest
from test_corpus import CORPUS, rows

from eventweave import cli
from eventweave.functions.labels import Labels
from eventweave.operators import counting
from eventweave.operators.dependencies import build_dependencies, build_groups
from eventweave.sources import conll, datasets, files, freqs, graphs, vectors
from eventweave.streaming import counts

ACCEPTED = "V N\nnsubj dobj iobj nmod obl xcomp\n"


def test_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("4 2\ndog 1 2\nnew york 3 4\ncat 5 x\ndog 7 8\nshort 1\n")
    p = str(tmp_path / "v.txt")
    assert {x.form: x.vec for x in vectors.read_vectors(spark, p).collect()} == {"dog": [7.0, 8.0], "new york": [3.0, 4.0]}
    assert {x.form: x.vec for x in vectors.read_vectors(spark, p, length=1).collect()}["dog"] == [8.0]
    only = spark.createDataFrame([("dog",)], "w string")
    assert [x.form for x in vectors.read_vectors(spark, p, only).collect()] == ["dog"]
    np.save(tmp_path / "m.npy", np.array([[1, 2], [3, 4], [5, 6]], np.float32))
    (tmp_path / "m.vocab").write_text("a b\nc d\n")
    assert {x.form: x.vec for x in vectors.read_vectors(spark, str(tmp_path / "m.npy"), length=1).collect()} == {"a": [1.0], "b": [3.0], "c": [5.0]}
    assert [(x.form, x.vec) for x in vectors.read_matrix_vectors(spark, f"file://{tmp_path}/m.npy", spark.createDataFrame([("b",)], "w string")).collect()] == [("b", [3.0, 4.0])]
    np.save(tmp_path / "wrong.npy", np.arange(3))
    with pytest.raises(ValueError):
        vectors.read_vectors(spark, str(tmp_path / "wrong.npy"))


def test_matrix_in_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 7)
    m = np.random.default_rng(1).normal(size=(100, 3))
    np.save(tmp_path / "m.npy", m)
    (tmp_path / "m.vocab").write_text("\n".join(f"w{i % 90}" for i in range(100)))
    got = {x.form: x.vec for x in vectors.read_vectors(spark, str(tmp_path / "m.npy")).collect()}
    assert got == {f"w{i % 90}": m[i].tolist() for i in range(100)}


def test_lists(spark, tmp_path):
    (tmp_path / "l").write_text(ACCEPTED)
    assert files.read_labels(spark, str(tmp_path / "l")) == Labels()
    (tmp_path / "l2").write_text("V\n\n")
    assert files.read_labels(spark, str(tmp_path / "l2")) == Labels(("V",), None)
    (tmp_path / "r").write_text("SBJ nsubj nsubjpass\nTIME nmod:during,nmod:before\nROOT    None\n")
    assert files.read_relations(spark, str(tmp_path / "r")) == {"SBJ": ["nsubj"], "TIME": ["nmod:during", "nmod:before"], "ROOT": ["None"]}
    (tmp_path / "w").write_text("b a\n\nc\n")
    assert [tuple(x) for x in files.read_vocabulary(spark, str(tmp_path / "w")).orderBy("at").collect()] == [(0, "b"), (1, "a"), (2, "c")]
    (tmp_path / "s").write_text(" a\na\nb\n")
    assert rows(files.read_set(spark, str(tmp_path / "s"))) == [("a",), ("b",)]
    c = files.load_config("a:\n  b: 1\n  c: [x, 2]\nd: true\n")
    assert (c.a.b, c.a.c, c.d) == (1, ("x", 2), True)
    with pytest.raises(AttributeError):
        c.a.b = 2


def test_freqs(spark, tmp_path):
    df = spark.createDataFrame([("dog", "N", 3), ("a", "V", 12)], "lemma string, pos string, freq long")
    for compression in ("gzip", "none"):
        freqs.write_freqs(df, ["lemma", "pos"], str(tmp_path / compression), compression)
        assert rows(freqs.read_lemma_freqs(spark, str(tmp_path / compression))) == [("a", "V", 12), ("dog", "N", 3)]
    (tmp_path / "f").write_text("a b@N\t12.0\na b@N\t12.0\nx y\t3\nbad\n")
    assert rows(freqs.read_freqs(spark, str(tmp_path / "f"))) == [("a b@N", 12), ("x y", 3)]
    assert rows(freqs.read_lemma_freqs(spark, str(tmp_path / "f"), 3)) == [("a", "b@N", 12)]
    (tmp_path / "g").write_text("a b\t12\nbad\nc d\tmany\ne f\t1\t2\ng h\tNaN\n")
    assert rows(freqs.read_freqs(spark, str(tmp_path / "g"))) == [("a b", 12)]
    assert rows(freqs.rejected_freqs(spark, str(tmp_path / "g"))) == [("bad", "columns"), ("c d\tmany", "freq"), ("e f\t1\t2", "columns"), ("g h\tNaN", "freq")]


def test_items_and_results(spark, tmp_path):
    for name in ("target-relation", "target_relation"):
        (tmp_path / "i").write_text(f"item\t{name}\na@N@SBJ b@V@ROOT  c@N@OBJ\tSENTENCE\nd@N@SBJ\tOBJ\n")
        got = datasets.read_items(spark, str(tmp_path / "i")).orderBy("item_id").collect()
        assert [(x.item_id, [e.rel for e in x.elements], x.relations) for x in got] == [(0, ["SBJ", "ROOT", "OBJ"], ["OBJ", "ROOT", "SBJ"]), (1, ["SBJ"], ["OBJ", "SBJ"])]
    (tmp_path / "bad").write_text("x\ty\n")
    with pytest.raises(ValueError):
        datasets.read_items(spark, str(tmp_path / "bad"))
    res = spark.createDataFrame([(1, "b", "OBJ", None, [0.12345, 1.0]), (0, "a", "OBJ", [1.0], None)], "item_id long, item string, target string, lc array<double>, ac array<double>")
    datasets.write_results(res, str(tmp_path / "o"))
    assert [tuple(x) for x in datasets.read_results(spark, str(tmp_path / "o")).orderBy("item_id").collect()] == [(0, "a", "OBJ", [1.0], None), (1, "b", "OBJ", None, [0.123, 1.0])]


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.conll").write_text(CORPUS)
    (src / "broken").write_text("1 a\n")
    batch = build_dependencies(conll.read_conll(spark, [str(src)], strict=False))
    s = lambda: counts.stream_sentences(spark, str(src), files_per_trigger=2)
    counts.run_to_folder(counts.stream_lemma_freqs(s()), str(tmp_path / "l"), str(tmp_path / "c1"))
    assert rows(spark.read.parquet(str(tmp_path / "l"))) == rows(counting.lemma_freqs(batch))
    counts.run_to_folder(counts.stream_event_freqs(s()), str(tmp_path / "e"), str(tmp_path / "c2"))
    assert rows(spark.read.parquet(str(tmp_path / "e"))) == rows(counting.event_freqs(build_groups(batch)))
    accepted = spark.createDataFrame([("read", "V"), ("book", "N")], "lemma string, pos string")
    got = counts.run_events(s(), str(tmp_path / "a"), str(tmp_path / "c3"), accepted=accepted)
    assert rows(got) == [("book@N@dobj read@V@HEAD", 6)]
    (src / "odd").write_bytes(CORPUS.replace("\n\n", "\n \t\n").replace("\n", "\r\n").encode())
    counts.run_to_folder(counts.stream_lemma_freqs(s()), str(tmp_path / "l"), str(tmp_path / "c1"))
    assert {r.freq for r in spark.read.parquet(str(tmp_path / "l")).filter("lemma = 'dog'").collect()} == {4}


def test_stream_of_the_command_line(spark, tmp_path):
    t = str(tmp_path)
    for d in ("one", "two"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "a").write_text(CORPUS)
    (tmp_path / "labels").write_text(ACCEPTED)
    out = {}
    for kind in ("conll", "stream"):
        cli.main(["pipeline-extraction", "-p", kind, "-i", f"{t}/one", f"{t}/two", "-o", f"{t}/{kind}", "--labels", f"{t}/labels", "--word-thresh", "0", "--event-thresh", "0", "--workers", "1", "1", "--batch-sizes", "1", "10", "--batch-size-stats", "5"])
        out[kind] = [rows(freqs.read_freqs(spark, f"{t}/{kind}/{x}")) for x in ("lemma-freqs.txt", "events-freqs.txt")]
    assert out["conll"] == out["stream"] and len(out["conll"][1]) == 19
    cli.main(["sequential-extraction", "-e", "-i", f"{t}/one", "-o", f"{t}/few", "--labels", f"{t}/labels", "--lemmas-freqs-filepath", f"{t}/conll/lemma-freqs.txt", "--word-thresh", "2", "--batch-size-merge", "9"])
    assert rows(freqs.read_freqs(spark, f"{t}/few/events-freqs.gz")) == [("book@N@dobj read@V@HEAD", 2)]


def test_saved_tables(spark, tmp_path):
    g = graphs.Graph(spark.createDataFrame([(1, "a")], "word_id long, form string"), spark.createDataFrame([(5, "a@N@x")], "event_id long, form string"), spark.createDataFrame([(5, 1, "x")], "event_id long, word_id long, role string"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS saved LOCATION '{tmp_path}/saved'")
    graphs.save_graph(g, "", buckets=2, database="saved")
    back = graphs.load_graph(spark, database="saved")
    assert [rows(getattr(back, x)) for x in ("words", "events", "args")] == [[(1, "a")], [(5, "a@N@x")], [(5, 1, "x")]]
    spark.sql("DROP DATABASE saved CASCADE")


def test_prepared_items(spark, tmp_path):
    """Rows of the public rating sets in their published form."""
    t = str(tmp_path)
    (tmp_path / "Ratings_Recipient.txt").write_text("SUBJECT\tVERB\tOBJECT\tRECIPIENT\ttypicality\tmean_rat\tstd_rat\nvolunteer\tbring\tfood\trefugee\tT\t5.5\t1.53\n")
    (tmp_path / "Ratings_Triples.txt").write_text("SUBJECT\tVERB\tOBJECT\ttypicality\tmean_rat\tstd_rat\nwoman\tpaint\ttoenail\tT\t6.1\t1.51\n")
    (tmp_path / "Pairs.csv").write_text("subject1\tverb1\tobject1\tsubject2\tverb2\tobject2\tscore\tst_dev\nagent\tsell\tproperty\tfamily\tbuy\thome\t3.125\t1.5\n")
    (tmp_path / "analogies.txt").write_text("eat-v_obj\tapple-n\ndog-n_sbj\tbark-v\n")
    cli.main(["prepare-input", "-t", "dtfit", "-o", t, "-d", f"{t}/Ratings_Recipient.txt", f"{t}/Ratings_Triples.txt"])
    cli.main(["prepare-input", "-t", "ks", "-o", t, "-d", f"{t}/Pairs.csv"])
    cli.main(["prepare-input", "-t", "tfit_mit", "-o", t, "-d", f"{t}/analogies.txt"])
    text = lambda x: [r[0] for r in spark.read.text(f"{t}/{x}").collect()]
    head = "item\ttarget-relation"
    assert text("Ratings_Recipient.head_verbs_args") == [head, "volunteer@N@SBJ bring@V@ROOT  food@N@OBJ\tRECIPIENT"]
    assert text("Ratings_Triples.head_verbs_args") == [head, "woman@N@SBJ paint@V@ROOT\tOBJ"]
    assert text("Pairs.head_verbs_args") == [head, "agent@N@SBJ sell@V@ROOT property@N@OBJ\tSENTENCE", "family@N@SBJ buy@V@ROOT home@N@OBJ\tSENTENCE"]
    assert text("analogies.head_verbs_args") == [head, "eat@V@ROOT\tOBJ", "dog@N@SBJ\tSBJ"] and text("Pairs-mapping.csv") == ["0\t0\t1"]


def test_scratch_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from eventweave import session

    assert session.scratch_dir(spark).startswith("file:")
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        unset.sparkContext.master = master
        with pytest.raises(ValueError):
            session.scratch_dir(unset)
    unset.sparkContext.master = "local[4]"
    assert session.scratch_dir(unset) == session.scratch_dir(unset)
    df = session.materialize(spark.range(10), "x", bucket_by="id")
    plan = df.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10 and "Exchange" not in plan
    session.release(df)
    with pytest.raises(Exception):
        spark.table(df._eventweave_files[1]).count()


def test_command_line(spark, tmp_path):
    t = str(tmp_path)
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a").write_text(CORPUS)
    (tmp_path / "labels").write_text(ACCEPTED)
    for command, suffix in (("sequential-extraction", "gz"), ("pipeline-extraction", "txt")):
        cli.main([command, "-i", f"{t}/corpus", "-o", t, "--labels", f"{t}/labels", "--word-thresh", "0", "--event-thresh", "0"])
        cli.main(["build-graph", "-l", f"{t}/lemma-freqs.{suffix}", "-e", f"{t}/events-freqs.{suffix}", "-o", f"{t}/graph", "--weights", "pmi"])
        cli.main(["import-graph", "-d", f"{t}/graph", "--neo", f"{t}/store", "--copy", "no"])
        g = graphs.load_graph(spark, f"{t}/store")
        assert (g.words.count(), g.events.count(), g.args.count()) == (8, 19, 46) and g.args.filter("role IS NULL").count() > 0
    cli.main(["extract-possible-relations", "-g", f"{t}/store", "-o", t])
    assert [x[0] for x in spark.read.text(f"{t}/relations_list.txt").collect()] == ["dobj", "nmod:in", "nmod:of", "nsubj", "xcomp"]
    (tmp_path / "KS.csv").write_text("subject1\tverb1\tobject1\tsubject2\tverb2\tobject2\tscore\tst_dev\ndog\tchase\tLOCATION\tstudent\tread\tbook\t1.5\t0.1\nstudent\tread\tbook\tdog\tchase\tpark\t3\t0.1\n")
    cli.main(["prepare-input", "-d", f"{t}/KS.csv", "-t", "ks", "-o", t])
    (tmp_path / "rel").write_text("SBJ nsubj\nOBJ dobj\nROOT None\n")
    words = ["dog", "chase", "student", "read", "book", "park"]
    (tmp_path / "vec").write_text("6 2\n" + "".join(f"{w} {i} {6 - i}\n" for i, w in enumerate(words)))
    cli.main(["build-representations", "-g", f"{t}/store", "-r", f"{t}/rel", "-d", f"{t}/KS.head_verbs_args", "-v", f"{t}/vec", "-o", t, "--trace"])
    assert spark.read.csv(f"{t}/KS.head_verbs_args.log", sep="\t", header=True).filter("step = 3").count() > 0
    assert datasets.read_results(spark, f"{t}/KS.head_verbs_args.out").filter("ac IS NOT NULL").count() == 4
    cli.main(["compute-evaluation", "-d", f"{t}/KS.csv", "-g", f"{t}/KS.head_verbs_args.out", "-m", f"{t}/KS-mapping.csv", "-t", "ks", "-o", t])
    assert spark.read.csv(f"{t}/KS.csv.sims", header=True).filter("sims IS NOT NULL").count() == 2
    with pytest.raises(ValueError):
        (tmp_path / "TypicalityRatings_Pairs.txt").write_text("SUBJECT\tVERB\tmean_rat\n")
        cli.main(["prepare-input", "-d", f"{t}/TypicalityRatings_Pairs.txt", "-t", "dtfit", "-o", t])
