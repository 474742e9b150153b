"""Words and dependencies of a sentence, and the groups around its heads. Everything is row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweave.functions.labels import PERSON, PRONOUNS, Labels, accepted_pos, accepted_relation, standard_pos, standard_role
from eventweave.functions.sets import sorted_distinct


def _word(words: Column, ids: Column, wanted: Column) -> Column:
    """The word of an id; `ids` are those of `words`, in their order. A plain scan of them, without a lambda for each."""
    return F.get(words, (F.array_position(ids, wanted) - 1).cast("int"))


def build_dependencies(sentences: DataFrame, labels: Labels = Labels(), refine: bool = True, phrasal_verbs: bool = False) -> DataFrame:
    """`sentences` with `words` (id, lemma, upos) and `deps` (head, id, role) instead of `tokens`.

    Words have an accepted part of speech; the first token of an id counts. Dependencies have an accepted relation and a head among the words, so roots are
    dropped. `refine`: personal pronouns become PERSON; with `phrasal_verbs` also verbs take their particles (tag RP, relation with `prt`) as `verb_particle`.
    """
    std = F.transform("tokens", lambda t: F.struct(t["id"].alias("id"), t["lemma"].alias("lemma"), standard_pos(t["upos"]).alias("upos"), t["head"].alias("head"), standard_role(t["deprel"]).alias("role")))
    out = sentences.withColumn("__kept", F.filter(std, lambda t: accepted_pos(t["upos"], labels)))
    out = out.withColumn("__ids", F.transform("__kept", lambda t: t["id"]))
    word = lambda t: F.struct(t["id"].alias("id"), t["lemma"].alias("lemma"), t["upos"].alias("upos"))
    out = out.withColumn("words", F.transform(F.filter("__kept", lambda t, i: F.array_position("__ids", t["id"]) == i + 1), word))
    if refine:
        if phrasal_verbs:
            out = out.withColumn("__word_ids", F.transform("words", lambda w: w["id"]))
            particles = lambda w: F.transform(F.filter("__kept", lambda t: (t["head"] == w["id"]) & t["role"].contains("prt") & (_word(F.col("words"), F.col("__word_ids"), t["id"])["upos"] == "RP")), lambda t: t["lemma"])
            joined = lambda w: F.struct(w["id"].alias("id"), F.when(w["upos"] == "V", F.array_join(F.concat(F.array(w["lemma"]), particles(w)), "_")).otherwise(w["lemma"]).alias("lemma"), w["upos"].alias("upos"))
            out = out.withColumn("words", F.transform("words", joined))
        is_pronoun = lambda w: w["lemma"].isin(*PRONOUNS)
        out = out.withColumn("words", F.transform("words", lambda w: F.struct(w["id"].alias("id"), F.when(is_pronoun(w), PERSON[0]).otherwise(w["lemma"]).alias("lemma"), F.when(is_pronoun(w), PERSON[1]).otherwise(w["upos"]).alias("upos"))))
    dep = lambda t: F.struct(t["head"].alias("head"), t["id"].alias("id"), t["role"].alias("role"))
    out = out.withColumn("deps", F.transform(F.filter("__kept", lambda t: F.array_contains("__ids", t["head"]) & accepted_relation(t["role"], labels)), dep))
    return out.drop("__kept", "__ids", "__word_ids", "tokens")


def _member(word: Column, role: Column) -> Column:
    return F.concat_ws("@", word["lemma"], word["upos"], role)


def build_groups(built: DataFrame) -> DataFrame:
    """One row per head with dependents: the other columns, `head` (token id) and `members`, the sorted distinct `lemma@pos@role` of head (HEAD) and dependents."""
    heads = F.array_distinct(F.transform("deps", lambda d: d["head"]))
    rows = built.withColumn("__ids", F.transform("words", lambda w: w["id"])).withColumn("head", F.explode(heads))
    word = lambda i: _word(F.col("words"), F.col("__ids"), i)
    of_head = F.transform(F.filter("deps", lambda d: d["head"] == F.col("head")), lambda d: _member(word(d["id"]), d["role"]))
    members = F.concat(F.array(_member(word(F.col("head")), F.lit("HEAD"))), of_head)
    return rows.withColumn("members", sorted_distinct(members)).drop("words", "deps", "__ids")


def keep_lemmas(groups: DataFrame, keys: list[str], accepted: DataFrame | None) -> DataFrame:
    """Groups (by `keys`, which identify one) without members whose (lemma, pos) isn't in `accepted`; a group whose head isn't is dropped. None accepts all.

    The semi join runs on single members before any subset is made; Spark broadcasts the accepted lemmas if they are small.
    """
    if accepted is None:
        return groups
    single = groups.select(*keys, F.explode("members").alias("member"))
    parts = F.split("member", "@")
    single = single.withColumn("lemma", F.get(parts, F.lit(0))).withColumn("pos", F.get(parts, F.lit(1)))
    kept = single.join(accepted.select("lemma", "pos").distinct(), ["lemma", "pos"], "left_semi")
    whole = kept.groupBy(*keys).agg(F.array_sort(F.collect_set("member")).alias("members"))
    return whole.filter(F.exists("members", lambda m: m.endswith("@HEAD")))
