"""Items from the original datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Orders of the words, targets by experiment.
ORDERS = {"head_verbs_args": ("s", "v", "o"), "verbs_args": ("v", "s", "o")}
EXPERIMENTS = {"Triples": "OBJ", "Loc": "LOCATION", "Instr": "INSTRUMENT", "Time": "TIME", "Recipient": "RECIPIENT"}
GOLD_COLUMNS = {"OBJ": "OBJECT"}


def _words(order: str, **cols: Column) -> Column:
    if order not in ORDERS:
        raise ValueError(f"no such order: {order}; there are {', '.join(ORDERS)}")
    shape = {"s": "%s@N@SBJ", "v": "%s@V@ROOT", "o": "%s@N@OBJ"}
    used = [x for x in ORDERS[order] if x in cols]
    return F.format_string(" ".join(shape[x] for x in used), *[cols[x] for x in used])


def prepare_pairs(pairs: DataFrame, order: str = "head_verbs_args") -> DataFrame:
    """(item_id, item, target) of sentence pairs (row_id, subject1, verb1, object1, subject2, verb2, object2): rows 2i and 2i + 1."""
    sides = [_words(order, s=F.col(f"subject{k}"), v=F.col(f"verb{k}"), o=F.col(f"object{k}")) for k in (1, 2)]
    rows = pairs.select("row_id", F.posexplode(F.array(*sides)).alias("side", "item"))
    return rows.select((F.col("row_id") * 2 + F.col("side")).alias("item_id"), "item", F.lit("SENTENCE").alias("target"))


def pair_mapping(pairs: DataFrame) -> DataFrame:
    """(orig, row1, row2): which items belong to a pair."""
    return pairs.select(F.col("row_id").alias("orig"), (F.col("row_id") * 2).alias("row1"), (F.col("row_id") * 2 + 1).alias("row2"))


def prepare_fit(ratings: DataFrame, experiment: str, order: str = "head_verbs_args") -> DataFrame:
    """(item_id, item, target) of typicality ratings (row_id, SUBJECT, VERB, OBJECT); all but Triples end in two blanks and the object."""
    if experiment not in EXPERIMENTS:
        raise ValueError(f"no target for the experiment {experiment}; there are {', '.join(EXPERIMENTS)}")
    item = _words(order, s=F.col("SUBJECT"), v=F.col("VERB"))
    if experiment != "Triples":
        item = F.format_string("%s  %s@N@OBJ", item, F.col("OBJECT"))
    return ratings.select(F.col("row_id").alias("item_id"), item.alias("item"), F.lit(EXPERIMENTS[experiment]).alias("target"))


def prepare_analogies(rows: DataFrame, column: str = "c0") -> DataFrame:
    """(item_id, item, target) of rows like `word-n_obj`: verbs are roots, all else subjects. Rows of another form have null item and target."""
    cell = F.split(F.col(column), "_", -1)
    word = F.split(F.get(cell, F.lit(0)), "-", -1)
    sound = (F.size(cell) == 2) & (F.size(word) == 2)
    pos = F.get(word, F.lit(1))
    item = F.concat(F.get(word, F.lit(0)), F.lit("@"), F.upper(pos), F.when(pos == "v", "@ROOT").otherwise("@SBJ"))
    return rows.select(F.col("row_id").alias("item_id"), F.when(sound, item).alias("item"), F.when(sound, F.upper(F.get(cell, F.lit(1)))).alias("target"))


PREPARE = {"ks": prepare_pairs, "dtfit": prepare_fit, "tfit_mit": prepare_analogies}
