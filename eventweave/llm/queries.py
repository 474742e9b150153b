"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.llm import bpe, heavy_hitters, packing, subjects, terms, together, top_n
from eventweave.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_hitters.frequent_events(table(spark, sf, "events_nodes")).select("form")


def p2_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The same events with their exact totals; the sketch's bounds are checked in the tests."""
    return heavy_hitters.frequent_events(table(spark, sf, "events_nodes")).select("form", F.col("total").alias("freq"))


def p2_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The same events with their exact totals, and whether the sketch's bounds hold them."""
    total = F.col("total")
    return heavy_hitters.frequent_events(table(spark, sf, "events_nodes")).select("form", total.alias("freq"), (F.col("lower") <= total).alias("from_below"), (total <= F.col("upper")).alias("from_above"))


def p3_top(spark: SparkSession, sf: str) -> DataFrame:
    """Ten events at most of every form, role and slice, with their rank; also of groups of ten or fewer."""
    top = top_n.strongest_events(table(spark, sf, "event_word_edges"), table(spark, sf, "words_nodes"), only_over=False)
    return top.select("slice_id", "form", "role", "event_id", "rank")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return top_n.strongest_events(table(spark, sf, "event_word_edges"), table(spark, sf, "words_nodes")).select("slice_id", "form", "role", "event_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = together.members_together(table(spark, sf, "events_nodes"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.filter(wide("n_ab") * wide("n") >= 5 * wide("n_a") * wide("n_b")).select("item_a", "item_b")


def p4_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of members of an event, with its counts and lift."""
    pairs = together.members_together(table(spark, sf, "events_nodes"), at_least=1, one_in=None)
    return pairs.select("item_a", "item_b", "n_a", "n_b", "n_ab", F.round("lift", 3).alias("lift"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return terms.word_marks(table(spark, sf, "words_nodes")).filter(F.col("mark").isNotNull() & F.col("form").isNotNull()).select("form", "pos", "mark")


def p5_words(spark: SparkSession, sf: str) -> DataFrame:
    return terms.word_marks(table(spark, sf, "words_nodes"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"), ["doc_id"])


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, or piece of one with more than 2048 tokens: its tokens (begin, n) and its container."""
    return packing.pack_documents(table(spark, sf, "documents"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """One row about the packing of all texts, sized by started four characters, into containers of 2048: items, pieces and total, containers that are too full, small items
    that were divided, and whether there are at most one in a hundred more containers, and one, than the total needs."""
    capacity = 2048
    sized = table(spark, sf, "documents").select("doc_id", F.ceil(F.length("text") / 4).alias("size"))
    packed = packing.pack(sized, ["doc_id"], "size", capacity)
    per = packed.groupBy("container").agg(F.sum("n").alias("held")).filter(F.col("held") > 0).agg(F.count(F.lit(1)).alias("containers"), F.count_if(F.col("held") > capacity).alias("too_full"))
    cut = packed.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    items = cut.agg(F.count(F.lit(1)).alias("items"), F.sum("k").alias("pieces"), F.sum("n").alias("total"), F.count_if((F.col("k") > 1) & (F.col("n") <= capacity)).alias("divided"))
    least = F.ceil(F.col("total") / capacity)
    out = items.crossJoin(F.broadcast(per))  # one row each
    return out.select("items", "pieces", "total", "too_full", "divided", (F.col("containers") >= least).alias("all_held"), (F.col("containers") <= least * 1.01 + 1).alias("near_least"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.subjects_of(table(spark, sf, "documents"), table(spark, sf, "subject_labels"), table(spark, sf, "subject_areas")).select("doc_id", "subject")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each subject area and their share of the corpus."""
    docs, areas = table(spark, sf, "documents"), table(spark, sf, "subject_areas")
    return subjects.composition(docs, subjects.subjects_of(docs, table(spark, sf, "subject_labels"), areas), areas)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (p2_found, p2_totals, p2_bounds, p3_found, p3_top, p4_found, p4_pairs, p5_found, p5_words, p6_ids, p7_pack, p7_fill, p8_found, p8_shares)}

_MEMBERS = """
  members AS (
    SELECT DISTINCT eventid, list_sort(list_distinct(list_transform(string_split(form, ','), lambda x: trim(x, ' ' || chr(9))))) AS items, freq
    FROM events_nodes WHERE form IS NOT NULL),
  sound AS (SELECT eventid, items, max(coalesce(freq, 0)) AS freq FROM members
    WHERE len(list_filter(items, lambda x: NOT regexp_full_match(x, '[^@]+@[^@]+@[^@]+'))) = 0 GROUP BY eventid, items)"""
_P2 = f"""WITH {_MEMBERS},
  totals AS (SELECT array_to_string(items, ',') AS form, CAST(sum(freq) AS BIGINT) AS freq FROM sound GROUP BY items)
SELECT form, freq FROM totals WHERE freq * 500 >= (SELECT sum(freq) FROM totals) AND freq > 0"""
_PAIRS = f"""WITH {_MEMBERS},
  rec AS (SELECT row_number() OVER () AS id, items FROM sound),
  item AS (SELECT id, unnest(items) AS item FROM rec),
  single AS (SELECT item, CAST(count(*) AS BIGINT) AS n_item FROM item GROUP BY item),
  joined AS (SELECT a.item AS item_a, b.item AS item_b, CAST(count(*) AS BIGINT) AS n_ab FROM item a JOIN item b ON a.id = b.id AND a.item < b.item GROUP BY ALL),
  pairs AS (SELECT item_a, item_b, (SELECT count(*) FROM rec) AS n, x.n_item AS n_a, y.n_item AS n_b, n_ab
    FROM joined JOIN single x ON x.item = item_a JOIN single y ON y.item = item_b)"""
_WORDS = """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY wordid, slice_id ORDER BY loaded_at DESC NULLS LAST, pos DESC NULLS LAST, freq DESC NULLS LAST) AS r FROM words_nodes),
  words AS (SELECT lower(trim(form, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS form, left(trim(pos), 1) AS pos,
      CAST(sum(coalesce(freq, 0)) AS BIGINT) AS freq, CAST(count(DISTINCT slice_id) AS BIGINT) AS slices
    FROM ranked WHERE r = 1 GROUP BY 1, 2),
  marked AS (SELECT *, CASE WHEN freq <= 2 THEN 'rare' WHEN slices * 10 >= 9 * (SELECT count(DISTINCT slice_id) FROM words_nodes) THEN 'common' END AS mark FROM words)"""

_TOP = """WITH e AS (SELECT event_id, word_id, CASE WHEN role IS NULL OR lower(trim(role)) IN ('', 'none', 'head') THEN 'head' ELSE lower(trim(role)) END AS role,
      slice_id, pmi, freq, loaded_at FROM event_word_edges WHERE word_id IS NOT NULL),
  latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, word_id, role
      ORDER BY loaded_at DESC NULLS LAST, pmi DESC NULLS LAST, freq DESC NULLS LAST, slice_id DESC NULLS LAST) AS r FROM e) WHERE r = 1 AND pmi IS NOT NULL AND NOT isnan(pmi)),
  forms AS (SELECT wordid AS word_id, max(lower(trim(form))) AS form FROM words_nodes WHERE wordid IS NOT NULL AND form IS NOT NULL GROUP BY 1),
  ranked AS (SELECT slice_id, form, role, event_id, row_number() OVER g AS r, count(*) OVER (PARTITION BY slice_id, form, role) AS n
    FROM latest JOIN forms USING (word_id) WINDOW g AS (PARTITION BY slice_id, form, role ORDER BY pmi DESC, freq DESC NULLS LAST, event_id))"""

ORACLE: dict[str, str] = {
    "p2_found": f"SELECT form FROM ({_P2})",
    "p2_totals": _P2,
    "p2_bounds": f"SELECT form, freq, true AS from_below, true AS from_above FROM ({_P2})",
    "p3_found": f"{_TOP} SELECT slice_id, form, role, event_id FROM ranked WHERE r <= 10 AND n > 10",
    "p3_top": f"{_TOP} SELECT slice_id, form, role, event_id, CAST(r AS INTEGER) AS rank FROM ranked WHERE r <= 10",
    "p4_found": _PAIRS + " SELECT item_a, item_b FROM pairs WHERE n_ab >= 10 AND n_ab * 1000 >= n AND CAST(n_ab AS HUGEINT) * n >= 5 * CAST(n_a AS HUGEINT) * n_b",
    "p4_pairs": _PAIRS + " SELECT item_a, item_b, n_a, n_b, n_ab, round(n_ab * CAST(n AS DOUBLE) / (CAST(n_a AS DOUBLE) * n_b), 3) AS lift FROM pairs",
    "p5_found": _WORDS + " SELECT form, pos, mark FROM marked WHERE mark IS NOT NULL AND form IS NOT NULL",
    "p5_words": _WORDS + " SELECT form, pos, freq, slices, mark FROM marked",
    "p7_fill": """WITH d AS (SELECT CAST(coalesce(ceil(length(text) / 4), 0) AS BIGINT) AS n FROM documents)
SELECT CAST(count(*) AS BIGINT) AS items, CAST(sum(greatest(ceil(n / 2048), 1)) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS total, CAST(0 AS BIGINT) AS too_full, CAST(0 AS BIGINT) AS divided, true AS all_held, true AS near_least FROM d""",
}
