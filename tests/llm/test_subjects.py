import random

import pytest
from pyspark.sql import functions as F

from eventweave.llm import subjects

AREAS = ["cooking", "finance", "law", "linguistics", "medicine", "music", "science", "software", "sport", "travel"]
SYLLABLES = {"en": "ba ke lo mi nu pra ste tho wi".split(), "it": "ca de fo gi lu ma re zzo vi".split(), "de": "sch ung ei acht fern hau wer zug olz".split()}
FUNCTION = {"en": ["the {} of the {} had a {} in {}", "every {} knows whether this {} or that {} came to {}"], "it": ["il {} con la {} ha una {} a {}", "secondo {3} ogni {0} era prima della {1} e del {2}"], "de": ["die {} und der {} war eine {} bei {}", "laut {3} kam erst das {0} und dann der {1} als {2}"]}
NEUTRAL = {"en": "nothing else was said about it in {}", "it": "nessuno ha detto altro di questo a {}", "de": "niemand sagte mehr darüber in {}"}


def vocabulary(language, area, n=14):
    rnd = random.Random(f"{language}{area}")
    return sorted({"".join(rnd.choice(SYLLABLES[language]) for _ in range(3)) + area[:2] for _ in range(n)})


def corpus(n=1500, labelled=4, seed=1, languages=("en", "en", "it", "de"), areas=AREAS):
    """Documents of one or two areas, or none, with a passing mention here and there; one in `labelled` has labels, one in twenty of these a wrong one."""
    rnd = random.Random(seed)
    words = {(x, a): vocabulary(x, a) for x in set(languages) for a in areas}
    docs, labels, truth = [], [], set()
    for i in range(n):
        language = rnd.choice(languages)
        mix = rnd.choice([1, 1, 1, 2, 0])
        own = rnd.sample(areas, min(mix, len(areas)))
        parts = [a for a in own for _ in range(rnd.randint(5, 8))] + [None] * rnd.randint(0, 2 if own else 8)
        if len(own) == 1 and rnd.random() < 0.3:
            parts.append(rnd.choice(areas))  # a passing mention
        rnd.shuffle(parts)
        place = lambda: f"Place{chr(97 + rnd.randint(0, 25))}{chr(97 + rnd.randint(0, 25))}"
        sentence = lambda a: NEUTRAL[language].format(place()) if a is None else rnd.choice(FUNCTION[language]).format(*rnd.sample(words[language, a], 3), place())
        text = rnd.choice([". ", "! ", ".\n\n"]).join(sentence(a).capitalize() for a in parts)
        docs.append((i, text.upper() if i % 9 == 0 else text, language if i % 11 else rnd.choice([None, "und", language.upper() + "-XX"])))
        truth |= {(i, a) for a in own}
        if i % labelled == 0:
            given = own if rnd.random() > 0.05 else [rnd.choice(areas)]
            for a in given:
                labels += [(i, rnd.choice([a, f" {a.upper()}"]), f"ann{x}") for x in rnd.choice([[1], [2], [1, 2], [3, 3]])]
    labels += [(2, None, "ann1"), (3, "nonsense", "ann1"), (None, "law", "ann1"), (10**6, "law", None)]
    return docs, labels, truth


def frames(spark, docs, labels, areas=AREAS):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("terms", F.lit("clash")).withColumn("subject", F.lit("clash")).withColumn("n", F.lit(0))
    return d, spark.createDataFrame(labels, "doc_id long, subject string, annotator string").withColumn("seed", F.lit(1)), spark.createDataFrame([(a,) for a in areas], "subject string")


def measured(got, truth):
    return len(got & truth) / max(1, len(truth)), len(got & truth) / max(1, len(got))


@pytest.fixture(scope="module")
def found(spark):
    docs, labels, truth = corpus()
    extra = [(2000, None, "en"), (2001, "", "en"), (2002, " \n\t", None), (2003, "x" * 100000, "en"), (2004, docs[1][1], "en"), (1, docs[1][1], "en")]
    rows = subjects.subjects_of(*frames(spark, docs + extra, labels)).collect()
    return docs, labels, truth, rows


def test_accuracy_on_unlabelled_by_language(found):
    docs, labels, truth, rows = found
    seen = {x[0] for x in labels}
    for language in (None, "en", "it", "de"):
        ids = {i for i, _, x in docs if i not in seen and language in (None, (x or "").lower()[:2])}
        recall, precision = measured({(r.doc_id, r.subject) for r in rows if r.doc_id in ids}, {x for x in truth if x[0] in ids})
        assert recall > 0.95 and precision > 0.97, (language, recall, precision)


def test_odd_texts(found):
    _, _, _, rows = found
    assert not {r.doc_id for r in rows} & {2000, 2001, 2002, 2003}
    assert {r.subject for r in rows if r.doc_id == 2004} == {r.subject for r in rows if r.doc_id == 1}


def test_trusted_seeds_are_clamped(found):
    docs, labels, truth, rows = found
    by = {}
    for i, s, who in labels:
        if s and i is not None and i < 1500:
            by.setdefault((i, s.strip().lower()), set()).add(who)
    got, trusted = {(r.doc_id, r.subject) for r in rows}, {(r.doc_id, r.subject) for r in rows if r.trusted}
    there = {i for i, t, _ in docs if t}
    assert {x for x, who in by.items() if len(who) > 1 and x[0] in there and x[1] in AREAS} <= trusted <= got
    alone = {x for x, who in by.items() if len(who) == 1 and x[1] in AREAS and x[0] in there}
    right, wrong = alone & truth, alone - truth
    assert len(right & trusted) > 0.97 * len(right) and len(wrong & trusted) < 0.2 * len(wrong) and wrong


def test_language_with_labels_of_one_subject_doesnt_drift(spark):
    """German documents are labelled with travel only: others keep no subject rather than travel."""
    docs, labels, truth = corpus(900, 2, 3)
    language = {i: (x or "").lower()[:2] for i, _, x in docs}
    labels = [x for x in labels if language.get(x[0]) != "de" or (x[1] or "").strip().lower() == "travel"]
    labels = [x for x in labels if language.get(x[0]) != "de" or {s for i, s in truth if i == x[0]} == {"travel"}]
    got = {(r.doc_id, r.subject) for r in subjects.subjects_of(*frames(spark, docs, labels)).collect() if language[r.doc_id] == "de"}
    recall, precision = measured(got, {x for x in truth if language[x[0]] == "de" and x[1] == "travel"})
    assert recall > 0.9 and precision > 0.9


def test_edges(spark):
    d, l, a = frames(spark, *corpus(40)[:2])
    assert subjects.subjects_of(d.limit(0), l, a).count() == 0
    assert subjects.subjects_of(d, l.limit(0), a).count() == 0
    assert subjects.subjects_of(d, l, a.limit(0)).count() == 0
    one = subjects.subjects_of(d, l, a.filter("subject = 'law'"))
    assert {r.trusted for r in one.collect()} <= {True}
    shares = {r.subject: (r.documents, r.share) for r in subjects.composition(d, spark.createDataFrame([(1, "law"), (2, "law")], "doc_id long, subject string"), a.filter("subject in ('law', 'sport')")).collect()}
    assert shares == {"law": (2, 0.05), "sport": (0, 0.0)}


def test_sentences(spark):
    text = 'See also: a-b, c, d. "Who did it, then?" asked the man the man. Two words.\nOne line\ngoes on here. It\'s a 2-word \'q\' -- end'
    got = subjects.sentences(spark.createDataFrame([(1, text, " EN-us")], "doc_id long, text string, lang string")).first()
    assert got.sents == [["see", "also", "a-b", "c", "d"], ["who", "did", "it", "then", "asked", "the", "man"], ["one", "line", "goes", "on", "here"], ["it's", "a", "word", "q", "end"]]
    assert got.language == "en"
