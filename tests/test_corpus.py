import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventweave.functions.labels import Labels, accepted_lemma, standard_pos, standard_role
from eventweave.operators import counting, graph
from eventweave.operators.dependencies import build_dependencies, build_groups, keep_lemmas
from eventweave.operators.sentences import line_sentences, text_sentences
from eventweave.plans import corpus
from eventweave.sources import conll

CORPUS = """1 Dogs dog NNS O nsubj=2
2 chased chase VBD O ROOT=0
3 Rome Rome NNP LOCATION dobj=2
4 in in IN O case=5
5 park park NN O nmod:in=2

1 The the DT O det=2
2 book book NN O nsubjpass=3
3 read read VBN O ROOT=0
4 students student NNS O nmod:agent=3

1 They they PRP O nsubj=2
2 want want VBP O ROOT=0
3 read read VB O xcomp=2
4 books book NNS O dobj=3,nmod:of=2
"""


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.conll").write_text(CORPUS)
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.conll").write_text(CORPUS)
    return str(tmp_path)


@pytest.fixture()
def built(spark, folder):
    return build_dependencies(conll.read_conll(spark, [folder]))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_lemma_counts(built):
    got = rows(counting.lemma_freqs(built))
    assert got == [("LOCATION", "N", 1), ("book", "N", 2), ("chase", "V", 1), ("dog", "N", 1), ("park", "N", 1), ("read", "V", 2), ("student", "N", 1), ("want", "V", 1)]
    assert counting.total_freq(counting.lemma_freqs(built)).first()[0] == 10
    assert rows(counting.lemma_freqs(built, 1)) == [("book", "N", 2), ("read", "V", 2)]


def test_groups_and_events(built):
    groups = {" ".join(r.members) for r in build_groups(built).collect()}
    assert groups == {"LOCATION@N@dobj chase@V@HEAD dog@N@nsubj park@N@nmod:in", "book@N@dobj read@V@HEAD student@N@nsubj", "book@N@nmod:of read@V@xcomp want@V@HEAD", "book@N@dobj read@V@HEAD"}
    events = counting.event_freqs(build_groups(built))
    freq = dict(rows(events))
    assert len(freq) == 19 and sum(freq.values()) == 20 and freq["book@N@dobj read@V@HEAD"] == 2
    assert rows(counting.arity_freqs(events)) == [(2, 13), (3, 6), (4, 1)]
    small = counting.event_freqs(build_groups(built), limit=4)
    assert (small.count(), small.agg(F.sum("freq")).first()[0]) == (8, 9)
    assert rows(counting.event_freqs(build_groups(built), 1)) == [("book@N@dobj read@V@HEAD", 2)]


def test_graph(built):
    lemmas, events = counting.lemma_freqs(built), counting.event_freqs(build_groups(built))
    g = graph.build_graph(lemmas, events)
    assert (g.words.count(), g.events.count(), g.args.count()) == (8, 19, 46)
    assert g.words.filter("form = 'book'").first().prob == pytest.approx(0.2)
    assert g.events.filter("form = 'book@N@dobj,read@V@HEAD'").first().prob == pytest.approx(2 / 13)
    assert g.args.filter("role IS NULL").count() > 0 and g.args.filter("role = 'HEAD'").count() == 0
    assert graph.build_graph(lemmas, events, null_head=False).args.filter("role IS NULL").count() == 0
    few = lemmas.filter("freq > 1")
    assert graph.orphans(few, events).agg(F.sum("edges")).first()[0] + graph.build_graph(few, events).args.count() == 46
    e = graph.build_graph(lemmas, events, "pmi").args.groupBy("event_id").agg(F.countDistinct("pmi").alias("n"))
    assert e.filter("n <> 1").count() == 0


def test_accepted_lemmas(spark, built):
    groups = build_groups(built).withColumn("uid", F.monotonically_increasing_id())
    accepted = spark.createDataFrame([("read", "V"), ("book", "N")], "lemma string, pos string")
    kept = keep_lemmas(groups, ["uid"], accepted)
    assert sorted(" ".join(r.members) for r in kept.collect()) == ["book@N@dobj read@V@HEAD", "book@N@dobj read@V@HEAD"]
    assert keep_lemmas(groups, ["uid"], None) is groups


def test_malformed_sentences(spark):
    texts = spark.createDataFrame([("1 a b NN O dep\n2 c c NN O x=1",), ("1 a b NN O y=2=3\n2 ! ! . O nope",), ("1 a b NN O",), ("",)], "value string")
    out = text_sentences(texts, strict=False).collect()
    assert [[(t.deprel, t.head) for t in r.tokens] for r in out] == [[("y=2", "3")]]
    with pytest.raises(PySparkException):
        text_sentences(texts).collect()


def test_listing_and_separators(spark, folder, tmp_path):
    assert conll.read_conll(spark, [folder]).count() == 3
    want = rows(conll.read_conll(spark, [str(tmp_path / "a.conll")]).select("tokens"))
    variants = {"blanks": CORPUS.replace("\n\n", "\n \t\n"), "crlf": CORPUS.replace("\n", "\r\n"), "both": CORPUS.replace("\n\n", "\n \t\n\n\n").replace("\n", "\r\n"), "ends": "\n \n" + CORPUS.strip("\n"), "stray": CORPUS.replace("\n2 ", "  \n\t2 ")}
    for name, text in variants.items():
        (tmp_path / name).write_bytes(text.encode())
        for compact in (False, True):
            assert rows(conll.read_conll(spark, [str(tmp_path / name)], compact=compact).select("tokens")) == want, (name, compact)
    assert [len(r.lines) for r in conll.read_raw_sentences(spark, [str(tmp_path / "crlf")]).orderBy(F.size("lines").desc()).collect()] == [5, 4, 4]
    assert conll.sentence_texts(spark, [str(tmp_path / "sub")]).count() == 3
    (tmp_path / "empty").write_text("")
    assert conll.read_conll(spark, [str(tmp_path / "empty")]).count() == 0


def test_large_file_is_divided(spark, tmp_path):
    """A file with carriage returns is read by many tasks, and sentences go over their bounds."""
    n = 3000
    (tmp_path / "w").write_bytes("".join(f"1 a w{i} N O x=2\r\n2 b b N O y=1\r\n{' ' * (i % 3)}\r\n" for i in range(n)).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path / "w")).rdd.getNumPartitions() > 10
        got = conll.read_conll(spark, [str(tmp_path / "w")]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(tuple(t.lemma for t in r.tokens) for r in got) == sorted((f"w{i}", "b") for i in range(n))


def test_parser_of_the_users(spark):
    texts = spark.createDataFrame([("a b|c",), (None,), ("",)], "body string")
    parser = lambda: lambda t: [[{"id": i + 1, "lemma": w, "extra": 1} for i, w in enumerate(s.split())] for s in t.split("|") if s]
    got = conll.parse_texts(texts, parser, "body", str.upper).collect()
    assert [[(t.id, t.lemma, t.head) for t in r.tokens] for r in got] == [[("1", "A", ""), ("2", "B", "")], [("1", "C", "")]]


def test_refinements(spark):
    text = "1 they they NN O nsubj=2\n2 gave give VBD O ROOT=0\n3 up up RP O compound:prt=2\n4 it it NN O dobj=2"
    s = text_sentences(spark.createDataFrame([(text,)], "value string"))
    labels = Labels(("V", "N", "RP"), ("nsubj", "dobj"))
    words = lambda **o: [(w.lemma, w.upos) for w in build_dependencies(s, labels, **o).first().words]
    assert words() == [("PERSON", "N"), ("give", "V"), ("up", "RP"), ("it", "N")]
    assert words(phrasal_verbs=True)[1] == ("give_up", "V")
    assert words(refine=False)[0] == ("they", "N")
    assert build_dependencies(s, Labels(None, None)).first().deps[0].role == "nsubj"


def test_labels(spark):
    df = spark.createDataFrame([("it's", "VBZ", "nsubjpass"), ("1-2", "IN", "nmod:agent"), ("café", "JJR", "dobj"), (None, None, None)], "a string, b string, c string")
    got = df.select(accepted_lemma(F.col("a")), standard_pos(F.col("b")), standard_role(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(True, "V", "dobj"), (False, "IN", "nsubj"), (False, "J", "dobj"), (None, None, None)]


def test_relation_filter_of_odd_roles(spark, tmp_path):
    roles = ["nsubj", " NSUBJ", "Nmod:in ", "HEAD", None, "", "det"]
    spark.createDataFrame([(x,) for x in roles], "role string").write.parquet(f"{tmp_path}/event_word_edges.parquet")
    assert {tuple(r) for r in corpus.prefix_relation_filter(spark, str(tmp_path)).collect()} == {("nsubj", 2), ("nmod:in", 1)}


def test_line_sentences(spark):
    ts = "2022-01-01 00:00:0{}"
    lines = [(i, "f", i, x, ts.format(0)) for i, x in enumerate(CORPUS.split("\n"), 1)]
    lines += [(90, "f", 1, "1 Cats cat NNS O nsubj=2", ts.format(1)), (91, "g", 1, "1 a", None), (92, None, 1, "1 a a NN O x=2", None), (93, "h", 1, None, None), (94, "h", 2, "1 a a NN O x=2", None)]
    df = spark.createDataFrame(lines, "line_id long, file_name string, line_no int, line string, loaded_at string")
    got = {(r.file_name, r.sentence): [t.lemma for t in r.tokens] for r in line_sentences(df.withColumn("extra", F.lit(1))).collect()}
    assert got[("f", 0)][:2] == ["cat", "chase"] and set(got) == {("f", 0), ("f", 1), ("f", 2), ("h", 1)}
    assert line_sentences(df.limit(0)).count() == 0


def test_line_sentences_keep_odd_lines(spark):
    sentences = ["1 a a N O x=2\n2 b b@c N O nope", "0 a a N O x=2\n2 b b N O y=0", "1 a a N O x=1,y=z", "1 a a N O 1x=2,=3", "1 a a N O x=2\n2 b b N O nope", "1 a a N O x=2\n2 b b N O nope=1 more", '1 a" a N O x=2\n2 b b N O y=1', "x a a N O nope"]
    df = spark.createDataFrame([(i, "f", i, x, None) for i, x in enumerate("\n\n".join(sentences).split("\n"))], "line_id long, file_name string, line_no int, line string, loaded_at string")
    got = {r.sentence: [(t.id, t.lemma, t.deprel, t.head) for t in r.tokens] for r in line_sentences(df).collect()}
    assert got == {0: [("1", "a", "x", "2")], 1: [("0", "a", "x", "2"), ("2", "b", "y", "0")], 2: [("1", "a", "x", "1"), ("1", "a", "y", "z")], 3: [("1", "a", "1x", "2"), ("1", "a", "", "3")]}
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(sentences) if i not in (5, 6)], "i int, value string")
    assert {r.i: [(t.id, t.lemma, t.deprel, t.head) for t in r.tokens] for r in text_sentences(texts).collect()} == got


def test_cube(spark, folder):
    cube = counting.token_cube(conll.read_conll(spark, [folder]))
    n = cube.filter("grouping = 0").agg(F.sum("freq")).first()[0]
    assert {r[0] for r in cube.groupBy("grouping").agg(F.sum("freq").alias("n")).select("n").collect()} == {n}
    assert cube.filter("ne = 'LOCATION' AND grouping = 14").first().freq == 1
