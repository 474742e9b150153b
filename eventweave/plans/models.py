"""Queries on vectors, items, representations and their scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventweave.functions import vectors as v
from eventweave.functions.sets import relations_of
from eventweave.operators import representation as r
from eventweave.operators.evaluate import context_similarity
from eventweave.operators.graph import Graph, delivered_graph
from eventweave.operators.knowledge import in_vocabulary, knowledge, requests_of
from eventweave.operators.ordering import number_rows, spearman
from eventweave.operators.prepare import EXPERIMENTS, pair_mapping, prepare_analogies, prepare_fit, prepare_pairs
from eventweave.plans.graphs import GRAPH_SQL, RELATIONS, STOP, delivered, thousandths
from eventweave.session import materialize, table

SETTINGS = r.Settings(n=20, m=5, stop=STOP)
HEAD = 30


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


def _shared_space(spark: SparkSession, sf: str, d: Graph) -> r.Space:
    """A vector space for the words of the graph: the form of word id i has vector i modulo their number."""
    e = _vectors(spark, sf)
    n = e.count()
    return r.Space(d.words.groupBy("form").agg((F.max("word_id") % n).alias("vec_id")), e.select("vec_id", "vec"))


def _space(spark: SparkSession, sf: str, d: Graph) -> DataFrame:
    return _shared_space(spark, sf, d).joined()


def _lookup_graph(spark: SparkSession, sf: str) -> Graph:
    """The delivered graph for lookups over all items: words are read several times and written, edges are moved once, by event."""
    d = thousandths(delivered_graph(table(spark, sf, "words_nodes"), table(spark, sf, "events_nodes"), table(spark, sf, "event_word_edges").repartition("event_id")))
    return Graph(materialize(d.words, "words"), d.events, d.args)


def _triples(d: Graph) -> DataFrame:
    """(row_id, s, v, o, freq): the distinct subjects, heads and objects of all events that have them, by form; of several the first counts."""
    m = F.split("form", ",")
    of = lambda role: F.get(F.filter(m, lambda x: x.endswith(f"@{role}")), F.lit(0))
    lemma = lambda x: F.lower(F.get(F.split(x, "@"), F.lit(0)))
    rows = d.events.select(lemma(of("nsubj")).alias("s"), lemma(of("HEAD")).alias("v"), lemma(of("dobj")).alias("o"), "freq").dropna()
    rows = rows.groupBy("s", "v", "o").agg(F.sum("freq").cast("bigint").alias("freq"))
    return number_rows(rows, [F.col("s").asc(), F.col("v").asc(), F.col("o").asc()], "row_id", 0)


def _items(triples: DataFrame) -> DataFrame:
    """Items of three words with the targets SENTENCE, OBJ and SBJ in turn."""
    word = lambda c, pos, rel: F.struct(F.col(c).alias("form"), F.lit(pos).alias("pos"), F.lit(rel).alias("rel"))
    target = F.get(F.array(F.lit("SENTENCE"), F.lit("OBJ"), F.lit("SBJ")), (F.col("row_id") % 3).cast("int"))
    rows = triples.select(F.col("row_id").alias("item_id"), F.format_string("%s@N@SBJ %s@V@ROOT %s@N@OBJ", "s", "v", "o").alias("item"), target.alias("target"), F.array(word("s", "N", "SBJ"), word("v", "V", "ROOT"), word("o", "N", "OBJ")).alias("elements"))
    return rows.withColumn("relations", relations_of(F.col("elements"), F.col("target")))


def _opened(df: DataFrame, keys: list[str], vec: str = "vec", digits: int = 6) -> DataFrame:
    return df.select(*keys, F.posexplode(vec).alias("i", "x")).withColumn("x", F.round("x", digits) + F.lit(0.0))


def vec_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """The last and the first 8 numbers of every vector."""
    e = _vectors(spark, sf)
    last = _opened(e.withColumn("vec", v.cut(F.col("vec"), 8, True)), ["vec_id"]).withColumn("part", F.lit("last"))
    return last.unionByName(_opened(e.withColumn("vec", v.cut(F.col("vec"), 8, False)), ["vec_id"]).withColumn("part", F.lit("first")))


def vec_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return _opened(r.group_centroids(_vectors(spark, sf), "label"), ["label"])


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    """(label, g): the first HEAD vectors of each label as a list of elements."""
    ranked = _vectors(spark, sf).withColumn("n", F.row_number().over(W.partitionBy("label").orderBy("vec_id"))).filter(F.col("n") <= HEAD)
    element = F.struct(F.col("vec_id").cast("string").alias("label"), "vec", F.lit(0.0).alias("w"))
    return ranked.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", element.alias("e")))), lambda x: x["e"]).alias("g"))


def vec_centroid_of_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """The mean over labels of the mean of their first five vectors; labels are few."""
    lists = _lists(spark, sf).agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "g"))), lambda x: x["g"]).alias("lists"))
    return _opened(lists.select(v.centroid(F.col("lists"), 5).alias("vec")), [])


def cosine_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's cosine to vector 0."""
    e = _vectors(spark, sf)
    head = e.filter(F.col("vec_id") == 0).select(F.col("vec").alias("head"))
    return e.crossJoin(F.broadcast(head)).select("vec_id", F.round(v.cosine(F.col("vec"), F.col("head")), 6).alias("score"))  # one row


def cosine_eval_zero(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine for evaluation of each vector with its reverse, where every seventh is zero and every fifth has a NaN."""
    e = _vectors(spark, sf)
    vec = F.when(F.col("vec_id") % 7 == 0, F.transform("vec", lambda x: x * 0)).when(F.col("vec_id") % 5 == 0, F.transform("vec", lambda x, i: F.when(i == 0, float("nan")).otherwise(x))).otherwise(F.col("vec"))
    return e.select("vec_id", F.round(v.cosine_or_zero(vec, F.reverse("vec")), 6).alias("score"))


def rerank_stable(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors of each label ranked by its first vector, in the order of `v.rerank` but without holding a label as one list."""
    e = _vectors(spark, sf)
    heads = e.groupBy(F.col("label").alias("of")).agg(F.min(F.struct("vec_id", "vec"))["vec"].alias("head"))
    scored = e.join(heads, F.col("label").eqNullSafe(F.col("of"))).select("label", "vec_id", v.cosine(F.col("vec"), F.col("head")).alias("score"))
    ranked = number_rows(scored, [F.col("label").asc(), F.col("score").isNull(), -F.col("score"), F.col("vec_id").asc()], "n", 0)
    first = ranked.groupBy(F.col("label").alias("of")).agg(F.min("n").alias("first"))
    ranked = ranked.join(first, F.col("label").eqNullSafe(F.col("of")))
    return ranked.select("label", (F.col("n") - F.col("first")).cast("int").alias("place"), "vec_id")


def relation_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(_triples(delivered(spark, sf)))
    more = F.when(F.col("item_id") % 2 == 0, "LOCATION").otherwise("SENTENCE")
    return items.select("item_id", F.array_join(relations_of(F.col("elements"), more), ",").alias("relations"))


def prepare_ks(spark: SparkSession, sf: str) -> DataFrame:
    return prepare_pairs(_pairs(spark, sf))


def prepare_ks_verbs_first(spark: SparkSession, sf: str) -> DataFrame:
    return prepare_pairs(_pairs(spark, sf), "verbs_args")


def prepare_ks_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return pair_mapping(_pairs(spark, sf))


def prepare_dtfit(spark: SparkSession, sf: str) -> DataFrame:
    """The items of every experiment."""
    t = _triples(delivered(spark, sf))
    t = t.select("row_id", F.col("s").alias("SUBJECT"), F.col("v").alias("VERB"), F.col("o").alias("OBJECT"))
    return reduce(DataFrame.unionByName, [prepare_fit(t, x).withColumn("experiment", F.lit(x)) for x in EXPERIMENTS])


def prepare_tfit(spark: SparkSession, sf: str) -> DataFrame:
    w = delivered(spark, sf).words
    return prepare_analogies(w.select(F.col("word_id").alias("row_id"), F.concat("form", F.lit("-"), F.lower("pos"), F.lit("_obj")).alias("c0")))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _paired(_triples(delivered(spark, sf)))


def _paired(triples: DataFrame) -> DataFrame:
    """Consecutive triples as sentence pairs, scored by the smaller of their frequencies."""
    t = triples.withColumn("pair", F.floor(F.col("row_id") / 2))
    one = t.filter(F.col("row_id") % 2 == 0).select(F.col("pair").alias("row_id"), F.col("s").alias("subject1"), F.col("v").alias("verb1"), F.col("o").alias("object1"), F.col("freq").alias("f1"))
    two = t.filter(F.col("row_id") % 2 == 1).select(F.col("pair").alias("row_id"), F.col("s").alias("subject2"), F.col("v").alias("verb2"), F.col("o").alias("object2"), F.col("freq").alias("f2"))
    return one.join(two, "row_id").withColumn("score", F.least("f1", "f2").cast("double")).drop("f1", "f2")


def spearman_events(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation of frequency and number of members over all event rows that have both."""
    return spearman(table(spark, sf, "events_nodes"), "freq", "deg").withColumn("rho", F.round("rho", 6))


def lc_vector(spark: SparkSession, sf: str) -> DataFrame:
    d = delivered(spark, sf)
    items = _items(_triples(d))
    return _opened(r.linguistic_conditions(r.known_words(items, _space(spark, sf, d)), items), ["item_id"], "lc")


def gek_batched(spark: SparkSession, sf: str) -> DataFrame:
    """The lookups of all items answered by one join, cut to n rows and then to words with vectors."""
    d = thousandths(delivered(spark, sf))
    found = knowledge(d, requests_of(_items(_triples(d))), RELATIONS, SETTINGS.n, "pmi", STOP)
    return in_vocabulary(found, _space(spark, sf, d)).select("form", "pos", "rel", "box", "rank", "label", "label_pos", F.col("w").cast("bigint").alias("w"))


def ac_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Both vectors of every item, one row a number."""
    d = _lookup_graph(spark, sf)
    out = r.represent(_items(materialize(_triples(d), "triples")).drop("item"), d, _shared_space(spark, sf, d), RELATIONS, SETTINGS)
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("vec")) for c in ("lc", "ac")]))
    return _opened(out.select("item_id", "target", both.alias("v")).select("item_id", "target", "v.*"), ["item_id", "target", "kind"])


def ac_first_step(spark: SparkSession, sf: str) -> DataFrame:
    """The active context of one-word items (each verb's best objects): the centroid of the first m, without any ranking."""
    d = thousandths(delivered(spark, sf))
    verbs = d.words.filter(F.col("pos") == "V").groupBy("form").agg(F.min("word_id").alias("item_id"))
    word = F.struct("form", F.lit("V").alias("pos"), F.lit("ROOT").alias("rel"))
    items = verbs.select("item_id", F.col("form").alias("item"), F.lit("OBJ").alias("target"), F.array(word).alias("elements"))
    items = items.withColumn("relations", relations_of(F.col("elements"), F.col("target")))
    return _opened(r.represent(items, d, _space(spark, sf, d), RELATIONS, SETTINGS), ["item_id"], "ac")


def ks_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of sentences, their context vectors' similarity and its rank correlation with the score."""
    d = _lookup_graph(spark, sf)
    triples = materialize(_triples(d), "triples")
    pairs = _paired(triples)
    items = _items(triples).drop("item").withColumn("target", F.lit("SENTENCE"))
    sims = context_similarity(r.represent_pairs(pair_mapping(pairs), items, d, _shared_space(spark, sf, d), RELATIONS, SETTINGS), pairs.select("row_id", "score"))
    return spearman(sims, "score", "sims").withColumn("rho", F.round("rho", 6))


QUERIES = [vec_truncate, vec_centroid, vec_centroid_of_centroids, cosine_rank, cosine_eval_zero, rerank_stable, relation_set_ops, prepare_ks, prepare_ks_verbs_first, prepare_ks_mapping, prepare_dtfit, prepare_tfit, spearman_events, lc_vector, gek_batched, ac_vector, ac_first_step, ks_scores]

_E = "vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
_LISTS = f"{_E}, lists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM vectors) WHERE n <= {HEAD})"
_OPEN = "unnest(range(len({0}))) AS i, round(unnest({0}), 6) + 0.0 AS x"
_COS = "list_dot_product({0}, {1}) / nullif(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 0)"
_TRIPLES = f"""{GRAPH_SQL},
  three AS (SELECT freq, string_split(form, ',') AS m FROM e),
  named AS (SELECT freq, lower(string_split(list_filter(m, lambda x: ends_with(x, '@nsubj'))[1], '@')[1]) AS s, lower(string_split(list_filter(m, lambda x: ends_with(x, '@HEAD'))[1], '@')[1]) AS v,
      lower(string_split(list_filter(m, lambda x: ends_with(x, '@dobj'))[1], '@')[1]) AS o FROM three),
  triples AS (SELECT s, v, o, CAST(sum(freq) AS BIGINT) AS freq, row_number() OVER (ORDER BY s, v, o) - 1 AS row_id FROM named WHERE s IS NOT NULL AND v IS NOT NULL AND o IS NOT NULL GROUP BY s, v, o)"""
_SPACE = f"""{_E}, forms AS (SELECT form, max(word_id) AS word_id FROM w GROUP BY form), space AS (SELECT form, vec FROM forms JOIN vectors ON vec_id = word_id % (SELECT count(*) FROM embeddings))"""
_KS = """SELECT row_id AS item_id, {0} AS item, 'SENTENCE' AS target FROM triples WHERE row_id < (SELECT count(*) // 2 * 2 FROM triples)"""
_REL = "rel(rel, role) AS (VALUES ('SBJ', 'nsubj'), ('OBJ', 'dobj'), ('ROOT', NULL))"
_FOUND = f"""hops AS (SELECT n.form, n.pos, x.rel, y.rel AS box, a.role, b.role AS role2, m.form AS label, m.pos AS label_pos, round(b.pmi * 1000) AS pmi
    FROM a JOIN w n ON n.word_id = a.word_id JOIN a b ON b.event_id = a.event_id AND NOT (b.word_id = a.word_id AND b.role IS NOT DISTINCT FROM a.role) JOIN w m ON m.word_id = b.word_id
    JOIN rel x ON x.role IS NOT DISTINCT FROM a.role JOIN rel y ON y.role IS NOT DISTINCT FROM b.role WHERE x.rel <> y.rel AND m.form NOT IN ('location', 'person', 'organization')),
  asked AS (SELECT s AS form, 'N' AS pos, 'SBJ' AS rel FROM triples UNION SELECT v, 'V', 'ROOT' FROM triples UNION SELECT o, 'N', 'OBJ' FROM triples),
  sums AS (SELECT form, pos, rel, box, label, label_pos, role, role2, CAST(coalesce(sum(pmi), 0) AS BIGINT) AS w FROM hops GROUP BY ALL),
  found AS (SELECT *, CAST(row_number() OVER (PARTITION BY form, pos, rel, box ORDER BY w DESC, label, label_pos, role NULLS FIRST, role2 NULLS FIRST) AS INTEGER) AS rank FROM sums)"""
# the fold of an item: a word is asked for the other relations only, so a context has two lists at most: `c2` ranks the second by the first, then `c1` the first by that
_FOLD = f"""{_FOUND},
  words AS (SELECT row_id, step, form, pos, rel, vec FROM (SELECT row_id, unnest([0, 1, 2]) AS step, unnest([s, v, o]) AS form, unnest(['N', 'V', 'N']) AS pos, unnest(['SBJ', 'ROOT', 'OBJ']) AS rel FROM triples) JOIN space USING (form)),
  lists AS (SELECT w.row_id, f.box, dense_rank() OVER (PARTITION BY w.row_id, f.box ORDER BY w.step) AS place, row_number() OVER (PARTITION BY w.row_id, f.box, w.step ORDER BY f.rank) AS n, s.vec
    FROM words w JOIN found f ON f.form = w.form AND f.pos = w.pos AND f.rel = w.rel AND f.rank <= {SETTINGS.n} JOIN space s ON s.form = f.label),
  opened AS (SELECT row_id, box, unnest(range(len(vec))) AS i, unnest(vec) AS x, n FROM lists WHERE place = 1 AND n <= {SETTINGS.m}),
  h1 AS (SELECT row_id, box, list(x ORDER BY i) AS vec FROM (SELECT row_id, box, i, sum(x ORDER BY n) / count(*) AS x FROM opened GROUP BY ALL) GROUP BY ALL),
  second AS (SELECT row_id, box, l.vec, row_number() OVER (PARTITION BY row_id, box ORDER BY {_COS.format('l.vec', 'h1.vec')} DESC NULLS LAST, n) AS n FROM lists l JOIN h1 USING (row_id, box) WHERE place = 2),
  opened2 AS (SELECT row_id, box, unnest(range(len(vec))) AS i, unnest(vec) AS x, n FROM second WHERE n <= {SETTINGS.m}),
  h2 AS (SELECT row_id, box, list(x ORDER BY i) AS vec FROM (SELECT row_id, box, i, sum(x ORDER BY n) / count(*) AS x FROM opened2 GROUP BY ALL) GROUP BY ALL),
  first AS (SELECT l.row_id, l.box, l.vec, row_number() OVER (PARTITION BY l.row_id, l.box ORDER BY {_COS.format('l.vec', 'h2.vec')} DESC NULLS LAST, l.n) AS n FROM lists l LEFT JOIN h2 ON h2.row_id = l.row_id AND h2.box = l.box WHERE l.place = 1),
  opened1 AS (SELECT row_id, box, unnest(range(len(vec))) AS i, unnest(vec) AS x, n FROM first WHERE n <= {SETTINGS.m}),
  means AS (SELECT row_id, box, i, sum(x ORDER BY n) / count(*) AS x FROM opened1 GROUP BY ALL UNION ALL SELECT row_id, box, i, sum(x ORDER BY n) / count(*) AS x FROM opened2 GROUP BY ALL),
  boxes AS (SELECT row_id, box, i, avg(x) AS x FROM means GROUP BY ALL)"""
_TARGET = "(CASE row_id % 3 WHEN 0 THEN 'SENTENCE' WHEN 1 THEN 'OBJ' ELSE 'SBJ' END)"

ORACLE = {
    "vec_truncate": f"WITH {_E} SELECT vec_id, {_OPEN.format('vec[-8:]')}, 'last' AS part FROM vectors UNION ALL SELECT vec_id, {_OPEN.format('vec[1:8]')}, 'first' FROM vectors",
    "vec_centroid": f"WITH {_E}, o AS (SELECT label, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM vectors) SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) + 0.0 AS x FROM o GROUP BY label, i",
    "vec_centroid_of_centroids": f"""WITH {_LISTS}, o AS (SELECT label, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM lists WHERE n <= 5),
  c AS (SELECT label, i, avg(x) AS x FROM o GROUP BY label, i) SELECT CAST(i AS INTEGER) AS i, round(avg(x), 6) + 0.0 AS x FROM c GROUP BY i""",
    "cosine_rank": f"WITH {_E} SELECT a.vec_id, round({_COS.format('a.vec', 'b.vec')}, 6) AS score FROM vectors a, vectors b WHERE b.vec_id = 0",
    "cosine_eval_zero": f"""WITH {_E}, z AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(vec, lambda x: 0.0::DOUBLE) WHEN vec_id % 5 = 0 THEN list_transform(vec, lambda x, i: CASE WHEN i = 1 THEN 0.0 ELSE x END) ELSE vec END AS a, list_reverse(vec) AS b FROM vectors)
SELECT vec_id, round(coalesce({_COS.format('a', 'b')}, 0), 6) AS score FROM z""",
    "rerank_stable": f"""WITH {_E}, numbered AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM vectors),
  s AS (SELECT l.label, l.vec_id, l.n, {_COS.format('l.vec', 'h.vec')} AS score FROM numbered l JOIN numbered h ON h.label IS NOT DISTINCT FROM l.label AND h.n = 1)
SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC NULLS LAST, n) - 1 AS INTEGER) AS place, vec_id FROM s""",
    "relation_set_ops": f"WITH {_TRIPLES} SELECT row_id AS item_id, CASE WHEN row_id % 2 = 0 THEN 'LOCATION,OBJ,ROOT,SBJ' ELSE 'OBJ,ROOT,SBJ' END AS relations FROM triples",
    "prepare_ks": f"WITH {_TRIPLES} {_KS.format("s || '@N@SBJ ' || v || '@V@ROOT ' || o || '@N@OBJ'")}",
    "prepare_ks_verbs_first": f"WITH {_TRIPLES} {_KS.format("v || '@V@ROOT ' || s || '@N@SBJ ' || o || '@N@OBJ'")}",
    "prepare_ks_mapping": f"WITH {_TRIPLES} SELECT row_id // 2 AS orig, row_id AS row1, row_id + 1 AS row2 FROM triples WHERE row_id % 2 = 0 AND row_id + 1 < (SELECT count(*) FROM triples)",
    "prepare_dtfit": f"""WITH {_TRIPLES}, kinds(experiment, target) AS (VALUES ('Triples', 'OBJ'), ('Loc', 'LOCATION'), ('Instr', 'INSTRUMENT'), ('Time', 'TIME'), ('Recipient', 'RECIPIENT'))
SELECT row_id AS item_id, s || '@N@SBJ ' || v || '@V@ROOT' || CASE WHEN experiment = 'Triples' THEN '' ELSE '  ' || o || '@N@OBJ' END AS item, target, experiment FROM triples, kinds""",
    "prepare_tfit": f"""WITH {GRAPH_SQL} SELECT word_id AS item_id, CASE WHEN form NOT LIKE '%-%' AND form NOT LIKE '%\\_%' ESCAPE '\\' THEN form || '@' || upper(pos) || CASE WHEN pos = 'V' THEN '@ROOT' ELSE '@SBJ' END END AS item,
  CASE WHEN form NOT LIKE '%-%' AND form NOT LIKE '%\\_%' ESCAPE '\\' THEN 'OBJ' END AS target FROM w""",
    "spearman_events": """WITH b AS (SELECT freq AS x, deg AS y FROM events_nodes WHERE freq IS NOT NULL AND deg IS NOT NULL),
  r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM b)
SELECT CAST(count(*) AS BIGINT) AS n, round(corr(rx, ry), 6) AS rho FROM r""",
    "lc_vector": f"""WITH {_TRIPLES}, {_SPACE}, k AS (SELECT row_id, row_id % 3 AS t, unnest(['OBJ', 'ROOT', 'SBJ']) AS rel, unnest([o, v, s]) AS form FROM triples),
  f AS (SELECT row_id, t, rel, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM k JOIN space USING (form) WHERE t = 0 OR (t = 1 AND rel = 'OBJ') OR (t = 2 AND rel = 'SBJ'))
SELECT row_id AS item_id, CAST(i AS INTEGER) AS i, round(sum(x ORDER BY rel) / count(*), 6) + 0.0 AS x FROM f GROUP BY row_id, i""",
    "gek_batched": f"WITH {_TRIPLES}, {_SPACE}, {_REL}, {_FOUND} SELECT form, pos, rel, box, rank, label, label_pos, w FROM found SEMI JOIN asked USING (form, pos, rel) WHERE rank <= {SETTINGS.n} AND label IN (SELECT form FROM space)",
    "ac_first_step": f"""WITH {GRAPH_SQL}, triples AS (SELECT NULL::VARCHAR AS s, NULL::VARCHAR AS v, NULL::VARCHAR AS o WHERE false), {_SPACE}, {_REL}, {_FOUND},
  verbs AS (SELECT form, min(word_id) AS item_id FROM w WHERE pos = 'V' GROUP BY form),
  known AS (SELECT v.item_id, f.rank, s.vec, row_number() OVER (PARTITION BY v.item_id ORDER BY f.rank) AS n FROM verbs v SEMI JOIN space USING (form) JOIN found f ON f.form = v.form AND f.pos = 'V' AND f.rel = 'ROOT' AND f.box = 'OBJ' AND f.rank <= {SETTINGS.n} JOIN space s ON s.form = f.label),
  o AS (SELECT item_id, n, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM known WHERE n <= {SETTINGS.m})
SELECT item_id, CAST(i AS INTEGER) AS i, round(sum(x ORDER BY n) / count(*), 6) + 0.0 AS x FROM o GROUP BY item_id, i""",
    "ac_vector": f"""WITH {_TRIPLES}, {_SPACE}, {_REL}, {_FOLD},
  ac AS (SELECT row_id, i, avg(x) AS x FROM boxes WHERE {_TARGET} IN ('SENTENCE', box) GROUP BY ALL),
  lc AS (SELECT row_id, i, avg(x) AS x FROM (SELECT row_id, rel, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM words WHERE {_TARGET} IN ('SENTENCE', rel)) GROUP BY ALL)
SELECT row_id AS item_id, {_TARGET} AS target, kind, CAST(i AS INTEGER) AS i, round(x, 6) + 0.0 AS x FROM (SELECT *, 'lc' AS kind FROM lc UNION ALL SELECT *, 'ac' FROM ac)""",
    "ks_scores": f"""WITH {_TRIPLES}, {_SPACE}, {_REL}, {_FOLD},
  ac AS (SELECT row_id, list(x ORDER BY i) AS vec FROM (SELECT row_id, i, avg(x) AS x FROM boxes GROUP BY ALL) GROUP BY row_id),
  pairs AS (SELECT a.row_id // 2 AS pair, least(a.freq, b.freq) AS score, {_COS.format('x.vec', 'y.vec')} AS sims FROM triples a JOIN triples b ON b.row_id = a.row_id + 1 AND a.row_id % 2 = 0
    JOIN ac x ON x.row_id = a.row_id JOIN ac y ON y.row_id = b.row_id),
  r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rx, rank() OVER (ORDER BY sims) + (count(*) OVER (PARTITION BY sims) - 1) / 2 AS ry FROM pairs)
SELECT CAST(count(*) AS BIGINT) AS n, round(corr(rx, ry), 6) AS rho FROM r""",
}
