"""Items that appear together, counted over collapsed baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweave.functions.text import event_members
from eventweave.session import materialize

#: Up to so many items (about 64 bytes each in a hash table) the frequent items are broadcast; beyond, Spark chooses the join.
BROADCAST_ITEMS = 200_000
#: Up to so many frequent items are filtered by a list in the plan; baskets of more items than LARGE are divided among tasks.
LITERAL_ITEMS, LARGE = 10_000, 256


def collapse(df: DataFrame, items: Column, copies: list[str] | None = None) -> DataFrame:
    """Distinct baskets with the number of records that hold them: (items, weight). Records that agree in `copies` and their items are one."""
    rows = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(copies or [])], items.alias("items")).filter(F.col("items").isNotNull())
    if copies:
        rows = rows.distinct()
    return rows.groupBy("items").agg(F.count(F.lit(1)).alias("weight"))


def reduce_baskets(baskets: DataFrame, frequent: DataFrame, size: int) -> DataFrame:
    """The baskets (items, weight) with only their frequent items (`item`), collapsed again; those with fewer than two are left out.

    Up to LITERAL_ITEMS of them, which with a floor of n / c records are at most c times the mean basket, go into the filter itself and nothing is moved before the second
    collapse; beyond, single items are joined and baskets put together again.
    """
    if size <= LITERAL_ITEMS:
        names = [r[0] for r in frequent.select("item").collect()]
        few = baskets.select(F.filter("items", lambda x: x.isin(names)).alias("items"), "weight")
    else:
        single = baskets.withColumn("basket", F.monotonically_increasing_id()).select("basket", "weight", F.explode("items").alias("item"))
        kept = single.join(F.broadcast(frequent) if size <= BROADCAST_ITEMS else frequent, "item", "left_semi")
        few = kept.groupBy("basket", "weight").agg(F.array_sort(F.collect_list("item")).alias("items")).drop("basket")
    return few.filter(F.size("items") > 1).groupBy("items").agg(F.sum("weight").alias("weight"))


def enumerate_pairs(baskets: DataFrame) -> DataFrame:
    """(item_a, item_b, weight): every pair of each basket once, item_a < item_b, streamed from two generators.

    Baskets of more than LARGE items are divided by blocks of their first items over all tasks.
    """
    def of(rows: DataFrame) -> DataFrame:
        first = rows.select("items", "weight", "start", F.posexplode(F.slice("items", F.col("start") + 1, F.lit(LARGE))).alias("at", "item_a"))
        return first.select("item_a", F.explode(F.slice("items", F.col("start") + F.col("at") + 2, F.size("items"))).alias("item_b"), "weight")

    small = baskets.filter(F.size("items") <= LARGE).withColumn("start", F.lit(0))
    large = baskets.filter(F.size("items") > LARGE).withColumn("start", F.explode(F.sequence(F.lit(0), F.size("items") - 1, F.lit(LARGE))))
    return of(small).unionByName(of(large.repartition("items", "start")))


def pairs_in(baskets: DataFrame, at_least: int = 1, one_in: int | None = None) -> DataFrame:
    """Pairs of items with their measures: (item_a, item_b, n, n_a, n_b, n_ab, lift, conviction), item_a < item_b.

    n: records; n_ab: records with both, at least `at_least` and n / `one_in`. A pair can't be in more records than either item, so baskets are reduced to
    items of so many records before pairs are made; this loses no pair.
    conviction = P(a) P(not b) / P(a and not b), null where b always follows a. Baskets of one item count in n; without baskets there are no pairs.
    """
    n = baskets.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    floor = max(at_least, -(-n // one_in) if one_in else 1)
    single = baskets.select("weight", F.explode("items").alias("item")).groupBy("item").agg(F.sum("weight").alias("n_item"))
    single = materialize(single.filter(F.col("n_item") >= floor), "items")
    size = single.count()
    hint = F.broadcast if size <= BROADCAST_ITEMS else (lambda x: x)
    both = enumerate_pairs(reduce_baskets(baskets, single, size) if floor > 1 else baskets)
    out = both.groupBy("item_a", "item_b").agg(F.sum("weight").alias("n_ab")).filter(F.col("n_ab") >= floor)
    out = out.join(hint(single.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))), "item_a")
    out = out.join(hint(single.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))), "item_b")
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b"))
    conviction = F.when(F.col("n_a") > F.col("n_ab"), F.col("n_a").cast("double") * (F.lit(n) - F.col("n_b")) / (F.lit(float(max(n, 1))) * (F.col("n_a") - F.col("n_ab"))))
    return out.select("item_a", "item_b", F.lit(n).cast("bigint").alias("n"), "n_a", "n_b", "n_ab", lift.alias("lift"), conviction.alias("conviction"))


def members_together(events: DataFrame, at_least: int = 10, one_in: int | None = 1000) -> DataFrame:
    """Pairs of members of event forms. Rows of one `eventid` are one record; rows without a sound form are left out."""
    return pairs_in(materialize(collapse(events, event_members(events["form"]), ["eventid"]), "baskets"), at_least, one_in)
