"""Part-of-speech and relation labels. Fixed values of the formats stand in the tables below."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relations that are counted as another.
ROLE_NAMES = {"nsubjpass": "dobj", "csubjpass": "ccomp", "nsubj:xsubj": "nsubj", "nmod:agent": "nsubj"}
#: Classes of tags by first letter; personal pronouns and what they become; names that stand for entities.
POS_CLASSES = ("V", "N", "J")
PRONOUNS = ("I", "he", "she", "you", "we", "they")
PERSON = ("PERSON", "N")
PROPER = ("NNP", "NNPS")
STOP_NODES = ("LOCATION", "PERSON", "ORGANIZATION")
#: Fixed value: the characters of a lemma.
LEMMA = r"\A[A-Za-z0-9.'-]+\z"


@dataclass(frozen=True)
class Labels:
    """Accepted parts of speech and relation prefixes; None accepts all."""

    pos: tuple[str, ...] | None = ("V", "N")
    relations: tuple[str, ...] | None = ("nsubj", "dobj", "iobj", "nmod", "obl", "xcomp")


def accepted_lemma(lemma: Column) -> Column:
    """Only letters, digits, `.`, `'` and `-`, at least one letter."""
    return lemma.rlike(LEMMA) & lemma.rlike("[A-Za-z]")


def entity_or(value: Column, upos: Column, ne: Column, otherwise: Column) -> Column:
    """The entity tag of proper nouns that have one."""
    return F.when(upos.isin(*PROPER) & (ne != "O"), ne).otherwise(otherwise)


def standard_pos(upos: Column) -> Column:
    """Verbs, nouns and adjectives by the first letter of the tag."""
    first = F.left(upos, F.lit(1))
    return F.when(first.isin(*POS_CLASSES), first).otherwise(upos)


def standard_role(role: Column) -> Column:
    out = role
    for old, new in ROLE_NAMES.items():
        out = F.when(role == old, new).otherwise(out)
    return out


def accepted_pos(pos: Column, labels: Labels) -> Column:
    return F.lit(True) if labels.pos is None else pos.isin(*labels.pos)


def accepted_relation(role: Column, labels: Labels) -> Column:
    """Begins with an accepted relation: `nmod` accepts `nmod:in`."""
    if labels.relations is None:
        return F.lit(True)
    out = F.lit(False)
    for r in labels.relations:
        out = out | role.startswith(r)
    return out
