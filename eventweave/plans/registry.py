"""All registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventweave.plans import corpus, graphs, lines, models

FLAGSHIP = "gek_pmi_topn"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for module in (lines, corpus, graphs, models):
    QUERIES |= {q.__name__: q for q in module.QUERIES}
    ORACLE |= module.ORACLE
