"""Subject areas of documents, by label propagation over a verified similarity graph of their sentences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweave.functions.text import ALL_BLANKS, strip
from eventweave.functions.vectors import let
from eventweave.session import materialize, release

#: Ends of sentences: white space after a full stop, question or exclamation mark (not after the quote that follows one), or a blank line.
SENTENCE_END = r"(?<=[.!?])\s+|\n\s*\n"
#: Words: letters, joined by apostrophes and hyphens.
WORD = r"\p{L}++(?:['’-]++\p{L}++)*+"
#: Verified terms and labelled documents up to these numbers (about 150 and 40 bytes each) are broadcast; beyond, Spark joins by shuffle.
BROADCAST_TERMS, BROADCAST_SEEDS = 100_000, 200_000
#: Votes are counted in these parts.
UNIT = 1_000_000


@dataclass(frozen=True)
class Graph:
    """Parameters of the similarity graph and of the propagation; none depends on the number of documents.

    words: a sentence has so many words at least; shorter pieces (headings, list marks) aren't counted as sentences.
    links: a term links documents only if so many labelled ones hold it.
    agreement: least agreement above chance of the labelled documents that a term links; below, its links are dropped.
    similarity: a sentence takes a label if its weighted links to that label add up to this. A term that links two documents of one subject weighs about 0.7, so one
    sound link is enough.
    majority: and if these are at least this share of all its links.
    coverage: after the first round a term links only if this share of its sentences is labelled: terms of neutral sentences and names fall out.
    prior: labelled documents of an even mixture that every term is taken to have besides its own.
    support: an uncontested label is trusted if one `support`-th of the document's sentences agree with it, judged by the other documents' labels.
    refinements: passes that divide the sentences of labelled documents with several subjects among these.
    rounds, settled: propagation ends when a round changes the mass of labels by less than `settled`, or after `rounds`.
    """

    words: int = 3
    links: int = 2
    agreement: float = 0.3
    similarity: float = 0.4
    majority: float = 0.6
    coverage: float = 0.3
    prior: float = 0.3
    support: int = 8
    refinements: int = 2
    rounds: int = 5
    settled: float = 0.01


def sentences(docs: DataFrame, text: str = "text", words: int = Graph.words) -> DataFrame:
    """(doc_id, sents): the sentences of every row as lists of their distinct words in lower case. Pieces of fewer than `words` words are none; a null, empty or blank text has none."""
    found = F.transform(F.split(F.lower(F.col(text)), SENTENCE_END), lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0)))
    sents = F.transform(F.filter(found, lambda w: F.size(w) >= words), F.array_distinct)
    language = F.left(F.lower(strip(F.coalesce(F.col("lang") if "lang" in docs.columns else F.lit(None), F.lit("")), ALL_BLANKS)), F.lit(2))
    return docs.filter(F.col(text).isNotNull()).select("doc_id", language.alias("language"), sents.alias("sents"))


def hashed(texts: DataFrame) -> DataFrame:
    """`texts` with the 64-bit hash of every word in its place: no word comes out, and numbers are joined and grouped faster."""
    return texts.withColumn("sents", F.transform("sents", lambda s: F.transform(s, lambda w: F.xxhash64(w))))


def seeds(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, seed, agreed): places in `subjects` of the document's labels, and of those that two annotators gave.

    Subjects are compared stripped and in lower case; unknown and null ones are dropped. Repeats by one annotator count once; a missing annotator is one.
    """
    names = F.array(*[F.lit(s) for s in subjects])
    annotator = F.coalesce(strip(F.col("annotator")) if "annotator" in labels.columns else F.lit(None), F.lit(""))
    known = labels.filter(F.col("doc_id").isNotNull()).select("doc_id", (F.array_position(names, F.lower(strip(F.col("subject"), ALL_BLANKS))) - 1).cast("int").alias("k"), annotator.alias("annotator"))
    each = known.filter(F.col("k") >= 0).groupBy("doc_id", "k").agg(F.count_distinct("annotator").alias("by"))
    return each.groupBy("doc_id").agg(F.array_sort(F.collect_list("k")).alias("seed"), F.array_sort(F.collect_list(F.when(F.col("by") > 1, F.col("k")))).alias("agreed"))  # at most one entry a subject


def broad_terms(docs: DataFrame, most: float) -> list[int]:
    """Terms in more than a share `most` of the documents of their language (the one that most of their documents have): function words.

    A subject's term isn't in more documents than the subject. With d distinct words in a mean document there are less than d / `most` such terms in a language.
    """
    per = docs.select("language", F.explode(F.array_distinct(F.flatten("sents"))).alias("term")).groupBy("term", "language").agg(F.count(F.lit(1)).alias("n"))
    home = per.groupBy("term").agg(F.max(F.struct("n", "language")).alias("home")).select("term", "home.*")
    size = docs.groupBy("language").agg(F.count(F.lit(1)).alias("size"))
    return sorted(r[0] for r in home.join(F.broadcast(size), "language").filter(F.col("n") > most * F.col("size")).select("term").collect())  # languages are two letters


class _Links:
    """Term links of one labelling: shares of the subjects `p`, and the weight of the links, the chance-corrected agreement of document pairs.

    Two labelled documents that share a term agree with a probability of sum(p^2); two of any terms with sum(pi^2). Pairs are never made.
    """

    def __init__(self, k: int, pi: list[float], prior: float):
        self.k, self.prior, self.chance = k, prior, sum(x * x for x in pi)

    def _votes(self, n: Column, least: float) -> Column:
        """The votes of one link for each subject, from the counts `n` (an array), in millionths; null below the agreement `least`. Arrays keep each step computed once.

        Whole numbers add up to the same in any order, and cheaply.
        """
        plus = lambda a, b: a + b
        shares = lambda n: let(F.aggregate(n, F.lit(self.prior), plus), lambda total: F.transform(n, lambda x: (x + self.prior / self.k) / total))
        agreement = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x)
        weight = lambda p: (agreement(p) - self.chance) / (1 - self.chance)
        return let(shares(n), lambda p: let(weight(p), lambda w: F.when((w >= least) & (w > 0), F.transform(p, lambda x: (w * x * UNIT + 0.5).cast("bigint")))))

    def votes(self, df: DataFrame, n: Column, keep: list[str], least: float = 0.0) -> DataFrame:
        """`keep` and v0...: what each link adds to the subjects of a sentence; links below `least` are dropped."""
        if self.chance >= 1:  # one subject only: nothing to agree above chance
            df = df.filter("false")
        out = df.select(*keep, self._votes(n, least).alias("v")).filter(F.col("v").isNotNull())
        return out.select(*keep, *[F.get("v", F.lit(i)).alias(f"v{i}") for i in range(self.k)])


def _n(k: int) -> list[Column]:
    return [F.col(f"n{i}") for i in range(k)]


def _mixture(counts: DataFrame, k: int) -> list[float]:
    """Mass of each subject; one row of `k` numbers."""
    row = counts.agg(*[F.sum(x) for x in _n(k)]).first()
    return [float(x or 0) for x in row]


def _shares(mass: list[float]) -> list[float]:
    total = sum(mass)
    return [x / total if total else 0.0 for x in mass]


def _sum(df: DataFrame, by: list[str], k: int) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(k)])


def _best(k: int, similarity: float, majority: float) -> Column:
    """The place of the subject that a sentence's links agree on, else null. Ties go to the first."""
    v = [F.col(f"v{i}") for i in range(k)]
    best = F.greatest(*v) if k > 1 else v[0]
    place = F.coalesce(*[F.when(x == best, F.lit(i)) for i, x in enumerate(v)])
    return F.when((best >= similarity * UNIT) & (best >= majority * sum(v, F.lit(0))), place)


def _by_document(df: DataFrame, own: str, k: int) -> DataFrame:
    """(term, n0...): labelled documents that hold each term; one of several subjects is shared out evenly."""
    each = df.select("doc_id", own, F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.first(own).alias(own))
    return each.groupBy("term").agg(*[F.round(F.sum(F.array_contains(own, i).cast("double") / F.size(own)), 6).alias(f"n{i}") for i in range(k)])


def trusted_seeds(known: DataFrame, total: DataFrame, k: int, g: Graph) -> DataFrame:
    """(doc_id, own): the labels of each document that two annotators gave, or that its text supports; documents without any are left out.

    `known` (uid, doc_id, seed, agreed, terms) are the sentences of labelled documents. The text is judged by the links to other labelled documents: the
    document's own label is taken out of the counts first, and half the similarity is enough.
    """
    counts = materialize(_by_document(known, "seed", k), "counts")
    links = _Links(k, _shares(_mixture(counts, k)), g.prior)
    met = known.select("uid", "doc_id", "seed", F.explode("terms").alias("term"))
    others = F.transform(F.array(*_n(k)), lambda n, i: F.greatest(n - F.array_contains("seed", i).cast("double") / F.size("seed"), F.lit(0.0)))
    kinds = met.select("term", "seed").distinct().join(counts, "term").filter(sum(_n(k), F.lit(0.0)) > 1.001)  # judged once for all documents with the same labels
    votes = _sum(met.join(links.votes(kinds, others, ["term", "seed"], g.agreement / 2), ["term", "seed"]), ["uid", "doc_id"], k)
    best = votes.select("doc_id", _best(k, g.similarity / 2, 0.0).alias("k")).filter(F.col("k").isNotNull()).groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("votes"))
    given = known.groupBy("doc_id").agg(F.first("seed").alias("seed"), F.first("agreed").alias("agreed"))
    label = given.select("doc_id", "agreed", F.explode("seed").alias("k")).join(best, ["doc_id", "k"], "left").join(total, "doc_id")
    sound = F.array_contains("agreed", F.col("k")) | (F.coalesce("votes", F.lit(0)) * g.support >= F.col("sentences"))
    out = materialize(label.filter(sound).groupBy("doc_id").agg(F.array_sort(F.collect_list("k")).alias("own")), "trusted")
    release(counts)
    return out


def _first_counts(known: DataFrame, k: int, g: Graph) -> DataFrame:
    """Counts of the trusted documents: where one has several subjects, each of its sentences goes to those its links speak for, and a term to those of its sentences."""
    counts = materialize(_by_document(known, "own", k), "counts")
    for _ in range(g.refinements):
        links = _Links(k, _shares(_mixture(counts, k)), g.prior)
        votes = links.votes(counts, F.array(*_n(k)), ["term"])
        met = known.select("uid", "doc_id", "own", F.explode("terms").alias("term"))
        summed = _sum(met.join(votes, "term"), ["uid"], k)
        inside = [F.when(F.array_contains("own", i), (F.col(f"v{i}") / UNIT) * (F.col(f"v{i}") / UNIT)).otherwise(0.0) for i in range(k)]
        each = met.join(summed, "uid").select("doc_id", "term", *[x.alias(f"z{i}") for i, x in enumerate(inside)])
        whole = F.greatest(sum((F.col(f"z{i}") for i in range(k)), F.lit(0.0)), F.lit(1e-12))
        each = each.groupBy("doc_id", "term").agg(*[F.avg(F.col(f"z{i}") / whole).alias(f"n{i}") for i in range(k)])
        old, counts = counts, materialize(each.groupBy("term").agg(*[F.round(F.sum(f"n{i}"), 6).alias(f"n{i}") for i in range(k)]), "counts")
        release(old)
    return counts


def _label(rows: DataFrame, terms: DataFrame, trusted: DataFrame, k: int, g: Graph) -> DataFrame:
    """(uid, doc_id, k): the label of every sentence whose links agree on one; in clamped documents only their own labels.

    The rows are bucketed by sentence and each meets the broadcast terms where it lies: nothing is moved.
    """
    met = rows.select("uid", "doc_id", F.explode("terms").alias("term")).join(terms, "term")
    best = _sum(met, ["uid", "doc_id"], k).select("uid", "doc_id", _best(k, g.similarity, g.majority).alias("k")).filter(F.col("k").isNotNull())
    return best.join(trusted, "doc_id", "left").withColumn("clamped", F.col("own").isNotNull() & ~F.array_contains("own", F.col("k"))).drop("own")


def propagate(docs: DataFrame, labels: DataFrame, subjects: list[str], g: Graph = Graph()) -> DataFrame:
    """(doc_id, subject, n, sentences, trusted): sentences of each document that deal with a subject, its sentences in all, and whether the label is a trusted seed.

    The graph links the sentences of documents that share terms. The similarity of two sentences is the sum over their shared terms of the terms' weights, each the
    agreement above chance of the labelled documents it links (see `_Links`): so links are verified before labels pass over them. The graph is kept in its two sides,
    sentence - term and term - sentence, and a round is two joins on the term; a term with a third of all sentences costs a row for each and no pair.

    Trusted seeds (see `trusted_seeds`) are clamped: in the rounds their documents pass on no other label, and they are in the result whatever the text
    gives. Other labels are no seeds. A document keeps the subjects of all its sentences. Function words of a language link nothing (see `broad_terms`), so that a language
    with labels of few subjects doesn't take these for all its documents; sentences without verified links have no label.
    Without labels or subjects nothing is labelled; with one subject links can't be verified, and only labels of two annotators come out. Repeated rows of a document
    count as more of its sentences.
    """
    k = len(subjects)
    spark = docs.sparkSession
    if not k:
        return spark.createDataFrame([], "doc_id bigint, subject string, n bigint, sentences bigint, trusted boolean")
    given = materialize(seeds(labels, subjects), "seeds")
    few = lambda df, limit: F.broadcast(df) if df.count() <= limit else df
    parts = materialize(hashed(sentences(docs, words=g.words)), "texts")
    parts, texts = parts.filter(F.size("sents") > 0), parts
    share = given.select(F.explode("seed").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    broad = broad_terms(parts, max(2 / k, share / max(given.count(), 1)))
    rows = parts.select("doc_id", F.explode("sents").alias("terms")).select("doc_id", F.filter("terms", lambda w: ~w.isin(broad)).alias("terms")).filter(F.size("terms") > 0)
    rows = rows.join(few(given, BROADCAST_SEEDS), "doc_id", "left").withColumn("uid", F.monotonically_increasing_id())
    rows = materialize(rows.select("uid", "doc_id", "seed", "agreed", "terms"), "rows", bucket_by="uid")
    total = materialize(parts.groupBy("doc_id").agg(F.sum(F.size("sents")).cast("bigint").alias("sentences")), "total")
    labelled = rows.filter(F.col("seed").isNotNull())
    trusted = trusted_seeds(labelled, total, k, g)
    hinted = few(trusted, BROADCAST_SEEDS)
    counts = _first_counts(labelled.join(hinted, "doc_id"), k, g)
    mass, first, found = _mixture(counts, k), True, None
    for r in range(g.rounds + 1):
        links = _Links(k, _shares(mass), g.prior if first else 2 * g.prior)
        sound = sum(_n(k), F.lit(0.0)) >= F.greatest(F.lit(g.links - 1e-6), F.lit(0.0) if first else g.coverage * F.col("frequency"))
        terms = materialize(links.votes(counts.filter(sound), F.array(*[x.cast("double") for x in _n(k)]), ["term"], g.agreement), "terms")
        old, found = found, _label(rows, few(terms, BROADCAST_TERMS), hinted, k, g).persist()  # counted here, and read once more if it is the last
        if old is not None:
            old.unpersist()
        if r == g.rounds:
            break
        joined = rows.select("uid", "terms").join(found.filter(~F.col("clamped")).select("uid", "k").hint("shuffle_hash"), "uid", "left")
        each = joined.select(F.explode("terms").alias("term"), "k").groupBy("term", "k").agg(F.count(F.lit(1)).alias("n"))  # two numbers a row, opened when they are few
        each = each.groupBy("term").agg(F.sum("n").alias("frequency"), *[F.coalesce(F.sum(F.when(F.col("k") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(k)])
        new = materialize(each.filter(F.col("frequency") >= g.links), "counts")
        before, mass = mass, _mixture(new, k)
        release(counts)
        counts, done = new, not first and sum(abs(a - b) for a, b in zip(before, mass)) <= g.settled * sum(mass)
        first = False
        if done:
            break
        release(terms)
    names = F.array(*[F.lit(s) for s in subjects])
    per = found.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n")).withColumn("trusted", F.lit(False))
    kept = trusted.select("doc_id", F.explode("own").alias("k"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("trusted"))
    out = per.unionByName(kept).groupBy("doc_id", "k").agg(F.sum("n").alias("n"), F.max("trusted").alias("trusted")).join(total, "doc_id")
    out = materialize(out.select("doc_id", F.get(names, F.col("k")).alias("subject"), "n", "sentences", "trusted"), "subjects")
    found.unpersist()
    release(given, texts, rows, total, trusted, counts, terms)
    return out


def subjects_of(docs: DataFrame, labels: DataFrame, areas: DataFrame, part: int = 4, g: Graph = Graph()) -> DataFrame:
    """(doc_id, subject, n, sentences, trusted): the subject areas that at least one `part`-th of a document's sentences deal with, or that it is trusted to have; several, one or none."""
    subjects = sorted(r[0] for r in areas.select(F.lower(strip(F.col("subject"), ALL_BLANKS))).distinct().collect() if r[0])  # the list of areas is short and fixed
    return propagate(docs, labels, subjects, g).filter(F.col("trusted") | (F.col("n") * part >= F.col("sentences")))


def composition(docs: DataFrame, found: DataFrame, areas: DataFrame) -> DataFrame:
    """(subject, documents, share): documents of each subject, and their share of all documents."""
    n = docs.agg(F.count(F.lit(1)).alias("all"))
    per = found.groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))
    out = areas.select(F.lower(strip(F.col("subject"), ALL_BLANKS)).alias("subject")).distinct().join(per, "subject", "left").crossJoin(F.broadcast(n))  # one row
    documents = F.coalesce("documents", F.lit(0))
    return out.select("subject", documents.alias("documents"), (documents / F.greatest("all", F.lit(1))).alias("share"))
