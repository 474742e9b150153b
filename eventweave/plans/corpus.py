"""Queries from the parsed corpus to frequency tables and the graph built from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.functions.labels import Labels, accepted_lemma, accepted_relation, entity_or, standard_pos, standard_role
from eventweave.functions.sets import explode_subsets
from eventweave.functions.text import ALL_BLANKS, role_key, strip
from eventweave.operators import counting, graph, malformed
from eventweave.operators.dependencies import build_dependencies, build_groups, keep_lemmas
from eventweave.operators.latest import latest_rows
from eventweave.operators.sentences import line_sentences
from eventweave.plans.lines import LINES_SQL
from eventweave.session import scratch_dir, table
from eventweave.sources import conll

LEMMA_THRESHOLD, EVENT_THRESHOLD, SMALL_LIMIT = 5, 2, 4


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    return line_sentences(table(spark, sf, "corpus_lines"), table(spark, sf, "corpus_files"))


def _built(spark: SparkSession, sf: str) -> DataFrame:
    return build_dependencies(_sentences(spark, sf))


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return build_groups(_built(spark, sf))


def conll_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf).select("file_name", "sentence", F.explode("tokens").alias("t")).select("file_name", "sentence", "t.*")


def read_conll(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus lines written as text files and read again by the file reader: a third of the files with carriage returns, a third with blanks in the lines between sentences."""
    rows = table(spark, sf, "corpus_lines").filter(F.col("file_name").isNotNull() & F.col("line_no").isNotNull())
    rows = latest_rows(rows.select("file_name", "line_no", "line", "loaded_at", "line_id"), ["file_name", "line_no"], "loaded_at", ["line_id"])
    kinds = table(spark, sf, "corpus_files").groupBy("file_name").agg(F.max("delim").alias("delim"))
    text = F.translate(strip(F.coalesce("line", F.lit("")), ALL_BLANKS), "\n\r", "  ")
    style = F.pmod(F.crc32("file_name"), F.lit(3))
    written = F.concat(F.when((style == 2) & (text == ""), " \t").otherwise(text), F.when(style == 1, "\r").otherwise(""))
    rows = rows.join(kinds, "file_name", "left").select("file_name", F.coalesce("delim", F.lit("space")).alias("delim"), "line_no", written.alias("value"))
    folder = f"{scratch_dir(spark)}/corpus-{uuid.uuid4().hex}"
    ordered = rows.repartition("delim", "file_name").sortWithinPartitions("delim", "file_name", "line_no")
    ordered.select("value", "delim", "file_name").write.partitionBy("delim", "file_name").text(folder)
    out = []
    for kind in ("space", "tab"):
        names = [x for x in spark.read.text(folder).inputFiles() if f"/delim={kind}/" in x]
        out.append(conll.read_conll(spark, names, malformed.DELIMITERS[kind], strict=False))
    tokens = out[0].unionByName(out[1]).select(F.regexp_extract("file", "file_name=([^/]*)", 1).alias("file_name"), F.explode("tokens").alias("t"))
    return tokens.select("file_name", "t.*")


def charset_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = malformed.tokens(table(spark, sf, "corpus_lines"), table(spark, sf, "corpus_files"))
    return t.filter(accepted_lemma(F.col("lemma"))).select("line_id", "lemma")


def entity_substitution(spark: SparkSession, sf: str) -> DataFrame:
    t = malformed.tokens(table(spark, sf, "corpus_lines"), table(spark, sf, "corpus_files"))
    return t.select("line_id", entity_or(F.col("lemma"), F.col("upos"), F.col("ne"), F.lower("lemma")).alias("lemma"))


def pos_standardise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "words_nodes").select("wordid", "slice_id", "pos", standard_pos(F.col("pos")).alias("standard"))


def role_standardise(spark: SparkSession, sf: str) -> DataFrame:
    t = conll_tokens(spark, sf)
    return t.groupBy("deprel", standard_role(F.col("deprel")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def prefix_relation_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "event_word_edges").select(role_key(F.col("role")).alias("role"))
    return e.filter(accepted_relation(F.col("role"), Labels())).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def sentence_words(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf).select("file_name", "sentence", F.explode("words").alias("w")).select("file_name", "sentence", "w.*")


def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf).select("file_name", "sentence", F.explode("deps").alias("d")).select("file_name", "sentence", "d.*")


def lemma_freq(spark: SparkSession, sf: str) -> DataFrame:
    return counting.lemma_freqs(_built(spark, sf))


def lemma_freq_thresh(spark: SparkSession, sf: str) -> DataFrame:
    return counting.lemma_freqs(_built(spark, sf), LEMMA_THRESHOLD)


def lemma_total(spark: SparkSession, sf: str) -> DataFrame:
    return counting.total_freq(lemma_freq(spark, sf))


def group_build(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf).select("file_name", "sentence", "head", F.array_join("members", " ").alias("members"))


def accepted_lemma_semi(spark: SparkSession, sf: str) -> DataFrame:
    built = _built(spark, sf)
    kept = keep_lemmas(build_groups(built), ["file_name", "sentence", "head"], counting.lemma_freqs(built, LEMMA_THRESHOLD))
    return kept.select("file_name", "sentence", "head", F.array_join("members", " ").alias("members"))


def powerset_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """All subsets of two or more of each group, with the group they come from."""
    g = _groups(spark, sf).filter(F.size("members") < counting.GROUP_LIMIT)
    return explode_subsets(g, "members", "event").select("file_name", "sentence", "head", F.array_join("event", " ").alias("event"))


def event_freq(spark: SparkSession, sf: str) -> DataFrame:
    return counting.event_freqs(_groups(spark, sf))


def event_freq_thresh(spark: SparkSession, sf: str) -> DataFrame:
    return counting.event_freqs(_groups(spark, sf), EVENT_THRESHOLD)


def event_freq_small_groups(spark: SparkSession, sf: str) -> DataFrame:
    """With a lower limit on the size of groups."""
    return counting.event_freqs(_groups(spark, sf), limit=SMALL_LIMIT)


def merged_freqs(spark: SparkSession, sf: str) -> DataFrame:
    """Partial counts of the slices' word tables added up."""
    w = table(spark, sf, "words_nodes").select("form", "pos", F.col("freq").cast("bigint").alias("freq"), "slice_id")
    return counting.merge_freqs([w.filter(F.col("slice_id") < 10).drop("slice_id"), w.filter(F.col("slice_id") >= 10).drop("slice_id")], ["form", "pos"])


def arity_freq(spark: SparkSession, sf: str) -> DataFrame:
    return counting.arity_freqs(event_freq(spark, sf))


def token_cube(spark: SparkSession, sf: str) -> DataFrame:
    return counting.token_cube(_sentences(spark, sf))


def word_prob(spark: SparkSession, sf: str) -> DataFrame:
    return graph.word_nodes(lemma_freq(spark, sf)).withColumn("prob", F.round("prob", 9))


def event_prob_by_arity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.event_nodes(event_freq(spark, sf)).withColumn("prob", F.round("prob", 9))


def _graph(spark: SparkSession, sf: str, **options: str) -> graph.Graph:
    built = _built(spark, sf)
    return graph.build_graph(counting.lemma_freqs(built), counting.event_freqs(build_groups(built)), **options)


def args_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).args


def args_weighted(spark: SparkSession, sf: str) -> DataFrame:
    a = _graph(spark, sf, weights="pmi").args
    return a.select("event_id", "word_id", "role", "freq", F.round("prob", 9).alias("prob"), F.round("pmi", 5).alias("pmi"), "degree")


def orphan_edges_anti(spark: SparkSession, sf: str) -> DataFrame:
    built = _built(spark, sf)
    return graph.orphans(counting.lemma_freqs(built, LEMMA_THRESHOLD), counting.event_freqs(build_groups(built)))


QUERIES = [conll_tokens, read_conll, charset_filter, entity_substitution, pos_standardise, role_standardise, prefix_relation_filter, sentence_words, dependencies, lemma_freq, lemma_freq_thresh, lemma_total, group_build, accepted_lemma_semi, powerset_patterns, event_freq, event_freq_thresh, event_freq_small_groups, merged_freqs, arity_freq, token_cube, word_prob, event_prob_by_arity, args_edges, args_weighted, orphan_edges_anti]

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LATEST = """source AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_name, line_no ORDER BY loaded_at DESC NULLS LAST, line_id DESC) AS last
    FROM corpus_lines WHERE file_name IS NOT NULL AND line_no IS NOT NULL) WHERE last = 1)"""
_JUDGED = LINES_SQL.replace("source AS (SELECT * FROM corpus_lines)", _LATEST)
_STANDARD_ROLE = "CASE deprel WHEN 'nsubjpass' THEN 'dobj' WHEN 'csubjpass' THEN 'ccomp' WHEN 'nsubj:xsubj' THEN 'nsubj' WHEN 'nmod:agent' THEN 'nsubj' ELSE deprel END"
_STANDARD_POS = "CASE WHEN left(upos, 1) IN ('V', 'N', 'J') THEN left(upos, 1) ELSE upos END"
_IS_LEMMA = "regexp_full_match({0}, '[A-Za-z0-9.''-]+') AND regexp_matches({0}, '[A-Za-z]')"
_BOUNDS = f"""bounds AS (SELECT file_name, line_no, coalesce(sum(CASE WHEN trim(coalesce(line, ''), {_BLANKS}) = '' THEN 1 ELSE 0 END)
      OVER (PARTITION BY file_name ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence FROM source)"""
_ACCEPTED = f"""accepted AS (SELECT p.file_name, p.sentence, p.line_no, f[1] AS id, f[4] AS upos, f[4] IN ('NNP', 'NNPS') AND f[5] <> 'O' AS is_ne, f[5] AS ne, f[2] AS raw_text, f[3] AS raw_lemma, p.r
    FROM parsed p JOIN fine USING (file_name, sentence) WHERE {_IS_LEMMA.format("f[3]")}),
  opened AS (SELECT *, unnest(r) AS rel, unnest(range(len(r))) AS k FROM accepted),
  tokens AS (SELECT file_name, sentence, line_no, k, id, CASE WHEN is_ne THEN ne ELSE raw_text END AS text, CASE WHEN is_ne THEN ne ELSE lower(raw_lemma) END AS lemma, upos,
      string_split(rel, '=')[-1] AS head, left(rel, length(rel) - length(string_split(rel, '=')[-1]) - 1) AS deprel FROM opened)"""
_NO_BARE = f"""count_if(coalesce({_IS_LEMMA.format("f[3]")}, false) AND len(list_filter(r, lambda x: NOT contains(x, '='))) > 0) = 0"""
_TOKENS = f"""{_JUDGED},
  {_BOUNDS},
  parsed AS (SELECT b.sentence, j.* FROM judged j JOIN bounds b USING (file_name, line_no)),
  fine AS (SELECT file_name, sentence FROM parsed GROUP BY ALL HAVING count_if(coalesce(reason IN ('quoting', 'columns'), false)) = 0 AND {_NO_BARE}),
  {_ACCEPTED}"""
_READ = f"""{_LATEST},
  {_BOUNDS},
  plain AS (SELECT file_name, line_no, translate(trim(coalesce(line, ''), {_BLANKS}), chr(10) || chr(13), '  ') AS raw FROM source),
  kinds AS (SELECT file_name, max(delim) AS delim FROM corpus_files GROUP BY 1),
  cut AS (SELECT file_name, sentence, line_no, string_split(raw, CASE WHEN delim = 'tab' THEN chr(9) ELSE ' ' END) AS f FROM plain JOIN bounds USING (file_name, line_no) LEFT JOIN kinds USING (file_name) WHERE raw <> ''),
  parsed AS (SELECT *, string_split(f[6], ',') AS r FROM cut),
  fine AS (SELECT file_name, sentence FROM parsed GROUP BY ALL HAVING count_if(len(f) <> 6) = 0 AND {_NO_BARE}),
  {_ACCEPTED}"""
_WORDS = f"""{_TOKENS},
  kept AS (SELECT *, {_STANDARD_POS} AS pos, {_STANDARD_ROLE} AS role FROM tokens WHERE {_STANDARD_POS} IN ('V', 'N')),
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_name, sentence, id ORDER BY line_no, k) AS n FROM kept) WHERE n = 1),
  words AS (SELECT file_name, sentence, id, CASE WHEN lemma IN ('I', 'he', 'she', 'you', 'we', 'they') THEN 'PERSON' ELSE lemma END AS lemma,
      CASE WHEN lemma IN ('I', 'he', 'she', 'you', 'we', 'they') THEN 'N' ELSE pos END AS upos FROM firsts),
  deps AS (SELECT k.file_name, k.sentence, k.head, k.id, k.role FROM kept k SEMI JOIN words w ON w.file_name = k.file_name AND w.sentence = k.sentence AND w.id = k.head
    WHERE regexp_matches(k.role, '^(nsubj|dobj|iobj|nmod|obl|xcomp)'))"""
_LEMMAS = f"{_WORDS}, lemmas AS (SELECT lemma, upos AS pos, CAST(count(*) AS BIGINT) AS freq FROM words GROUP BY ALL)"
_MEMBERS = """members AS (
    SELECT d.file_name, d.sentence, d.head, w.lemma, w.upos AS pos, concat_ws('@', w.lemma, w.upos, d.role) AS member FROM deps d JOIN words w ON w.file_name = d.file_name AND w.sentence = d.sentence AND w.id = d.id
    UNION SELECT d.file_name, d.sentence, d.head, w.lemma, w.upos, concat_ws('@', w.lemma, w.upos, 'HEAD') FROM deps d JOIN words w ON w.file_name = d.file_name AND w.sentence = d.sentence AND w.id = d.head)"""
_GROUPS = f"{_LEMMAS}, {_MEMBERS}, groups AS (SELECT file_name, sentence, head, list_sort(list_distinct(list(member))) AS m FROM members GROUP BY ALL)"


def _patterns(limit: int) -> str:
    return f"""{_GROUPS},
  masks AS (SELECT *, unnest(range(CAST(pow(2, len(m)) AS BIGINT))) AS mask FROM groups WHERE len(m) < {limit}),
  patterns AS (SELECT file_name, sentence, head, array_to_string(list_filter(m, lambda x, i: (mask >> (i - 1)) & 1 = 1), ' ') AS event FROM masks WHERE bit_count(mask) >= 2),
  event_counts AS (SELECT event, CAST(count(*) AS BIGINT) AS freq FROM patterns GROUP BY event)"""


_EVENTS = _patterns(16)
_NODES = f"""{_EVENTS},
  word_nodes AS (SELECT row_number() OVER (ORDER BY lemma, pos) AS word_id, lemma AS form, pos, freq, freq / (SELECT sum(freq) FROM lemmas) AS prob FROM lemmas),
  event_degs AS (SELECT *, CAST(len(string_split(event, ' ')) AS INTEGER) AS deg FROM event_counts),
  event_nodes AS (SELECT row_number() OVER (ORDER BY replace(event, ' ', ',')) AS event_id, replace(event, ' ', ',') AS form, freq, freq / sum(freq) OVER (PARTITION BY deg) AS prob, deg FROM event_degs),
  opened_events AS (SELECT event_id, freq, prob, deg, string_split(unnest(string_split(form, ',')), '@') AS p FROM event_nodes),
  edge AS (SELECT event_id, word_id, CASE WHEN p[3] <> 'HEAD' THEN p[3] END AS role, e.freq, e.prob, e.deg AS degree, w.prob AS word_prob FROM opened_events e JOIN word_nodes w ON w.form = p[1] AND w.pos = p[2])"""
_CUBE = f"""{_TOKENS}, t AS (SELECT lemma, {_STANDARD_POS} AS pos, {_STANDARD_ROLE} AS rel, CASE WHEN lemma IN ('LOCATION', 'PERSON', 'ORGANIZATION') THEN lemma ELSE 'O' END AS ne FROM tokens)
SELECT lemma, pos, rel, ne, CAST(grouping(lemma, pos, rel, ne) AS INTEGER) AS grouping, CAST(count(*) AS BIGINT) AS freq FROM t
GROUP BY GROUPING SETS ((lemma, pos, rel, ne), (lemma, pos), (pos, rel), (ne), (rel), (pos))"""

ORACLE = {
    "conll_tokens": f"WITH {_TOKENS} SELECT file_name, sentence, id, text, lemma, upos, head, deprel FROM tokens",
    "read_conll": f"WITH {_READ} SELECT file_name, id, text, lemma, upos, head, deprel FROM tokens",
    "charset_filter": f"WITH {LINES_SQL} SELECT line_id, f[3] AS lemma FROM judged WHERE reason IS NULL AND {_IS_LEMMA.format('f[3]')}",
    "entity_substitution": f"WITH {LINES_SQL} SELECT line_id, CASE WHEN f[4] IN ('NNP', 'NNPS') AND f[5] <> 'O' THEN f[5] ELSE lower(f[3]) END AS lemma FROM judged WHERE reason IS NULL",
    "pos_standardise": "SELECT wordid, slice_id, pos, CASE WHEN left(pos, 1) IN ('V', 'N', 'J') THEN left(pos, 1) ELSE pos END AS standard FROM words_nodes",
    "role_standardise": f"WITH {_TOKENS} SELECT deprel, {_STANDARD_ROLE} AS role, CAST(count(*) AS BIGINT) AS n FROM tokens GROUP BY ALL",
    "prefix_relation_filter": f"""WITH keyed AS (SELECT lower(trim(role, {_BLANKS})) AS role FROM event_word_edges)
SELECT role, CAST(count(*) AS BIGINT) AS n FROM keyed WHERE regexp_matches(role, '^(nsubj|dobj|iobj|nmod|obl|xcomp)') GROUP BY role""",
    "sentence_words": f"WITH {_WORDS} SELECT file_name, sentence, id, lemma, upos FROM words",
    "dependencies": f"WITH {_WORDS} SELECT file_name, sentence, head, id, role FROM deps",
    "lemma_freq": f"WITH {_LEMMAS} SELECT lemma, pos, freq FROM lemmas",
    "lemma_freq_thresh": f"WITH {_LEMMAS} SELECT lemma, pos, freq FROM lemmas WHERE freq > {LEMMA_THRESHOLD}",
    "lemma_total": f"WITH {_LEMMAS} SELECT CAST(sum(freq) AS BIGINT) AS total FROM lemmas",
    "group_build": f"WITH {_GROUPS} SELECT file_name, sentence, head, array_to_string(m, ' ') AS members FROM groups",
    "accepted_lemma_semi": f"""WITH {_LEMMAS}, {_MEMBERS}, left_over AS (SELECT * FROM members SEMI JOIN (SELECT lemma, pos FROM lemmas WHERE freq > {LEMMA_THRESHOLD}) USING (lemma, pos))
SELECT file_name, sentence, head, array_to_string(list_sort(list_distinct(list(member))), ' ') AS members FROM left_over GROUP BY file_name, sentence, head HAVING bool_or(ends_with(member, '@HEAD'))""",
    "powerset_patterns": f"WITH {_EVENTS} SELECT file_name, sentence, head, event FROM patterns",
    "event_freq": f"WITH {_EVENTS} SELECT event, freq FROM event_counts",
    "event_freq_thresh": f"WITH {_EVENTS} SELECT event, freq FROM event_counts WHERE freq > {EVENT_THRESHOLD}",
    "event_freq_small_groups": f"WITH {_patterns(SMALL_LIMIT)} SELECT event, freq FROM event_counts",
    "merged_freqs": "SELECT form, pos, CAST(sum(freq) AS BIGINT) AS freq FROM words_nodes WHERE slice_id IS NOT NULL GROUP BY ALL",
    "arity_freq": f"WITH {_EVENTS} SELECT CAST(len(string_split(event, ' ')) AS INTEGER) AS deg, CAST(sum(freq) AS BIGINT) AS total FROM event_counts GROUP BY 1",
    "token_cube": f"WITH {_CUBE}",
    "word_prob": f"WITH {_NODES} SELECT word_id, form, pos, freq, round(prob, 9) AS prob FROM word_nodes",
    "event_prob_by_arity": f"WITH {_NODES} SELECT event_id, form, freq, round(prob, 9) AS prob, deg FROM event_nodes",
    "args_edges": f"WITH {_NODES} SELECT event_id, word_id, role, freq, CAST(0 AS DOUBLE) AS prob, CAST(0 AS DOUBLE) AS pmi, degree FROM edge",
    "args_weighted": f"WITH {_NODES} SELECT event_id, word_id, role, freq, round(prob, 9) AS prob, round(log2(prob) - sum(log2(word_prob)) OVER (PARTITION BY event_id), 5) AS pmi, degree FROM edge",
    "orphan_edges_anti": f"""WITH {_NODES} SELECT p[1] AS form, p[2] AS pos, CAST(count(*) AS BIGINT) AS edges FROM opened_events
WHERE NOT EXISTS (SELECT 1 FROM lemmas l WHERE l.freq > {LEMMA_THRESHOLD} AND l.lemma = p[1] AND l.pos = p[2]) GROUP BY ALL""",
}
