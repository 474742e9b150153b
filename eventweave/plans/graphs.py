"""Queries on the delivered event graph: listings, one and two hops, knowledge lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.operators import graph as g
from eventweave.operators.knowledge import knowledge, with_same_relations
from eventweave.operators.traversal import edges, events_of, participants, words_with
from eventweave.session import table

#: The word of the ad-hoc queries, the relation map and the stop nodes (the delivered graph has its forms in lower case).
FORM, POS = "sentence", "N"
RELATIONS = {"SBJ": ["nsubj"], "OBJ": ["dobj"], "ROOT": ["None"]}
STOP = ("location", "person", "organization")
TOP = 50


def delivered(spark: SparkSession, sf: str) -> g.Graph:
    return g.delivered_graph(table(spark, sf, "words_nodes"), table(spark, sf, "events_nodes"), table(spark, sf, "event_word_edges"))


def around(spark: SparkSession, sf: str) -> g.Graph:
    """What two hops from the word of the ad-hoc queries can reach."""
    return g.delivered_neighbourhood(table(spark, sf, "words_nodes"), table(spark, sf, "events_nodes"), table(spark, sf, "event_word_edges"), FORM, POS)


def thousandths(graph: g.Graph) -> g.Graph:
    """pmi in whole thousandths, so that sums don't depend on their order."""
    return g.Graph(graph.words, graph.events, graph.args.withColumn("pmi", F.round(F.col("pmi") * 1000)))


def word_pairs(graph: g.Graph, relations: tuple[str, ...] = ("SBJ", "OBJ", "ROOT")) -> DataFrame:
    """Every word of the graph in each of `relations`, asked for every other relation."""
    rels = lambda names: F.explode(F.array(*[F.lit(r) for r in names]))
    asked = graph.words.select("form", "pos").distinct().withColumn("rel", rels(relations)).withColumn("box", rels(tuple(RELATIONS)))
    return asked.filter(F.col("rel") != F.col("box"))


def graph_words(spark: SparkSession, sf: str) -> DataFrame:
    return delivered(spark, sf).words


def graph_events(spark: SparkSession, sf: str) -> DataFrame:
    return delivered(spark, sf).events


def graph_args(spark: SparkSession, sf: str) -> DataFrame:
    return delivered(spark, sf).args


def imported_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with both ends after import, by role."""
    d = delivered(spark, sf)
    return g.import_graph(d.words, d.events, d.args).args.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def role_list(spark: SparkSession, sf: str) -> DataFrame:
    return g.relation_list(delivered(spark, sf).args)


def g0_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges(delivered(spark, sf)).select("event", "role", "form", "event_id", "word_id").orderBy("event_id", "word_id", F.col("role").asc_nulls_first()).limit(25)


def g1_words(spark: SparkSession, sf: str) -> DataFrame:
    return delivered(spark, sf).words.select("form", "word_id").orderBy("form", "word_id").limit(10)


def g2_word(spark: SparkSession, sf: str) -> DataFrame:
    named = g.rows_named(table(spark, sf, "words_nodes"), FORM)
    return words_with(g.delivered_graph(named, table(spark, sf, "events_nodes"), table(spark, sf, "event_word_edges")), FORM).select("word_id", "pos", "freq")


def g3_events(spark: SparkSession, sf: str) -> DataFrame:
    d = around(spark, sf)
    return events_of(d, words_with(d, FORM, POS)).select("event_id", "form").distinct().orderBy("event_id").limit(10)


def g4_participants(spark: SparkSession, sf: str) -> DataFrame:
    d = around(spark, sf)
    order = ["event_id", F.col("role").asc_nulls_first(), F.col("role2").asc_nulls_first(), "form"]
    return participants(d, words_with(d, FORM, POS)).select("event_id", "role", "role2", "form").orderBy(*order).limit(30)


def g5_subjects(spark: SparkSession, sf: str) -> DataFrame:
    d = around(spark, sf)
    return participants(d, words_with(d, FORM, POS), "nsubj").select("event_id", "role2", "form").orderBy("event_id", F.col("role2").asc_nulls_first(), "form").limit(30)


def g6_objects(spark: SparkSession, sf: str) -> DataFrame:
    d = around(spark, sf)
    order = [F.col("pmi").desc_nulls_last(), "event_id", F.col("role2").asc_nulls_first(), "form"]
    return participants(d, words_with(d, FORM, POS), "dobj").select("word", "role", "pmi", "event", "event_id", "role2", "form").orderBy(*order).limit(10)


def _gek(spark: SparkSession, sf: str, weight: str, relations: tuple[str, ...], n: int = TOP) -> DataFrame:
    d = thousandths(delivered(spark, sf))
    return knowledge(d, word_pairs(d, relations), RELATIONS, n, weight, STOP).withColumn("w", F.col("w").cast("bigint"))


def gek_pmi_topn(spark: SparkSession, sf: str) -> DataFrame:
    """All words as subject, object and head: their best fillers of the other relations, by summed pmi (thousandths)."""
    return _gek(spark, sf, "pmi", ("SBJ", "OBJ", "ROOT"))


def gek_lmi_topn(spark: SparkSession, sf: str) -> DataFrame:
    return _gek(spark, sf, "lmi", ("SBJ", "OBJ", "ROOT"), 10)


def gek_null_role(spark: SparkSession, sf: str) -> DataFrame:
    """Heads only: the near edge has no role."""
    return _gek(spark, sf, "pmi", ("ROOT",))


def gek_same_relation(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects, with the word itself for its own relation."""
    d = thousandths(delivered(spark, sf))
    asked = word_pairs(d, ("SBJ",))
    return with_same_relations(knowledge(d, asked, RELATIONS, TOP, "pmi", STOP), asked).withColumn("w", F.col("w").cast("bigint"))


QUERIES = [graph_words, graph_events, graph_args, imported_graph, role_list, g0_edges, g1_words, g2_word, g3_events, g4_participants, g5_subjects, g6_objects, gek_pmi_topn, gek_lmi_topn, gek_null_role, gek_same_relation]

_B = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
GRAPH_SQL = f"""w AS (SELECT wordid AS word_id, max(lower(trim(form, {_B}))) AS form, max(left(trim(pos, {_B}), 1)) AS pos, CAST(sum(coalesce(freq, 0)) AS BIGINT) AS freq FROM (
      SELECT *, row_number() OVER (PARTITION BY wordid, slice_id ORDER BY loaded_at DESC NULLS LAST, form DESC NULLS LAST, freq DESC NULLS LAST, pos DESC NULLS LAST) AS last FROM words_nodes WHERE wordid IS NOT NULL)
    WHERE last = 1 GROUP BY wordid),
  members AS (SELECT eventid, freq, list_sort(list_distinct(list_transform(string_split(form, ','), lambda x: trim(x, ' ' || chr(9))))) AS m FROM events_nodes WHERE eventid IS NOT NULL AND form IS NOT NULL),
  e AS (SELECT eventid AS event_id, max(array_to_string(m, ',')) AS form, CAST(max(coalesce(freq, 0)) AS BIGINT) AS freq FROM members
    WHERE len(list_filter(m, lambda x: NOT regexp_full_match(x, '[^@]+@[^@]+@[^@]+'))) = 0 GROUP BY eventid),
  keyed AS (SELECT *, CASE WHEN role IS NULL OR lower(trim(role, {_B})) IN ('', 'none', 'head') THEN NULL ELSE lower(trim(role, {_B})) END AS r FROM event_word_edges WHERE event_id IS NOT NULL AND word_id IS NOT NULL),
  a AS (SELECT event_id, word_id, r AS role, CAST(coalesce(freq, 0) AS BIGINT) AS freq, CASE WHEN isfinite(pmi) THEN pmi END AS pmi FROM (
      SELECT *, row_number() OVER (PARTITION BY event_id, word_id, r ORDER BY loaded_at DESC NULLS LAST, CASE WHEN isnan(pmi) THEN 'Infinity'::DOUBLE ELSE pmi END DESC NULLS LAST, freq DESC NULLS LAST, slice_id DESC NULLS LAST) AS last FROM keyed)
    WHERE last = 1)"""
_PATHS = f"""{GRAPH_SQL}, hops AS (SELECT n.form AS word, a.event_id, a.role, a.pmi, b.role AS role2, m.form, m.pos, b.pmi AS pmi2, b.freq AS freq2, n.pos AS word_pos
    FROM a JOIN w n ON n.word_id = a.word_id JOIN a b ON b.event_id = a.event_id AND NOT (b.word_id = a.word_id AND b.role IS NOT DISTINCT FROM a.role) JOIN w m ON m.word_id = b.word_id)"""


def _gek_sql(weight: str, relations: str, n: int) -> str:
    return f"""{_PATHS}, rel(rel, role) AS (VALUES ('SBJ', 'nsubj'), ('OBJ', 'dobj'), ('ROOT', NULL)),
  sums AS (SELECT h.word AS form, h.word_pos AS pos, x.rel, y.rel AS box, h.role, h.role2, h.form AS label, h.pos AS label_pos, CAST(coalesce(sum({weight}), 0) AS BIGINT) AS w
    FROM hops h JOIN rel x ON x.role IS NOT DISTINCT FROM h.role JOIN rel y ON y.role IS NOT DISTINCT FROM h.role2
    WHERE x.rel <> y.rel AND x.rel IN ({relations}) AND h.form NOT IN ('location', 'person', 'organization') GROUP BY ALL),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY form, pos, rel, box ORDER BY w DESC, label, label_pos, role NULLS FIRST, role2 NULLS FIRST) AS INTEGER) AS rank FROM sums),
  gek AS (SELECT form, pos, rel, box, rank, label, label_pos, role, role2, w FROM ranked WHERE rank <= {n})"""


_PMI, _LMI, _ALL = "round(h.pmi2 * 1000)", "round(h.pmi2 * 1000) * h.freq2", "'SBJ', 'OBJ', 'ROOT'"
ORACLE = {
    "graph_words": f"WITH {GRAPH_SQL} SELECT word_id, form, pos, freq FROM w",
    "graph_events": f"WITH {GRAPH_SQL} SELECT event_id, form, freq, CAST(len(string_split(form, ',')) AS INTEGER) AS deg FROM e",
    "graph_args": f"WITH {GRAPH_SQL} SELECT event_id, word_id, role, freq, pmi FROM a",
    "imported_graph": f"WITH {GRAPH_SQL} SELECT role, CAST(count(*) AS BIGINT) AS n FROM a SEMI JOIN w USING (word_id) WHERE event_id IN (SELECT event_id FROM e) GROUP BY role",
    "role_list": f"WITH {GRAPH_SQL} SELECT DISTINCT role FROM a WHERE role IS NOT NULL",
    "g0_edges": f"WITH {GRAPH_SQL} SELECT e.form AS event, a.role, w.form, a.event_id, a.word_id FROM a JOIN e USING (event_id) JOIN w USING (word_id) ORDER BY event_id, word_id, role NULLS FIRST LIMIT 25",
    "g1_words": f"WITH {GRAPH_SQL} SELECT form, word_id FROM w ORDER BY form, word_id LIMIT 10",
    "g2_word": f"WITH {GRAPH_SQL} SELECT word_id, pos, freq FROM w WHERE form = '{FORM}'",
    "g3_events": f"WITH {GRAPH_SQL} SELECT DISTINCT e.event_id, e.form FROM a JOIN e USING (event_id) JOIN w USING (word_id) WHERE w.form = '{FORM}' AND w.pos = '{POS}' ORDER BY e.event_id LIMIT 10",
    "g4_participants": f"WITH {_PATHS} SELECT event_id, role, role2, hops.form FROM hops SEMI JOIN e USING (event_id) WHERE word = '{FORM}' AND word_pos = '{POS}' ORDER BY event_id, role NULLS FIRST, role2 NULLS FIRST, hops.form LIMIT 30",
    "g5_subjects": f"WITH {_PATHS} SELECT event_id, role2, hops.form FROM hops SEMI JOIN e USING (event_id) WHERE word = '{FORM}' AND word_pos = '{POS}' AND role = 'nsubj' ORDER BY event_id, role2 NULLS FIRST, hops.form LIMIT 30",
    "g6_objects": f"WITH {_PATHS} SELECT word, role, pmi, e.form AS event, event_id, role2, hops.form FROM hops JOIN e USING (event_id) WHERE word = '{FORM}' AND word_pos = '{POS}' AND role = 'dobj' ORDER BY pmi DESC NULLS LAST, event_id, role2 NULLS FIRST, hops.form LIMIT 10",
    "gek_pmi_topn": f"WITH {_gek_sql(_PMI, _ALL, TOP)} SELECT * FROM gek",
    "gek_lmi_topn": f"WITH {_gek_sql(_LMI, _ALL, 10)} SELECT * FROM gek",
    "gek_null_role": f"WITH {_gek_sql(_PMI, _ALL.split(', ')[2], TOP)} SELECT * FROM gek",
    "gek_same_relation": f"WITH {_gek_sql(_PMI, _ALL.split(', ')[0], TOP)} SELECT * FROM gek UNION ALL SELECT DISTINCT form, pos, 'SBJ', 'SBJ', 1, form, pos, NULL, NULL, 1 FROM w",
}
