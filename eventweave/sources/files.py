"""Files and plain lists."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.functions.labels import Labels
from eventweave.functions.text import ALL_BLANKS, split_blank, strip


def _hidden(name: str) -> bool:
    return name.startswith((".", "_"))


def is_file(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def list_files(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """A file yields itself; a folder its files, without hidden ones and without folders. Works on any file system of the cluster; only names are listed."""
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.getFileStatus(path).isFile():
            out.append(p)
            continue
        found = [s.getPath() for s in fs.listStatus(path) if s.isFile()]
        out += sorted(str(x.toString()) for x in found if not _hidden(x.getName()))
    return out


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value): the lines of text files, compressed or not."""
    return spark.read.text(path)


def head_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first lines of a small file; configuration, not data."""
    return [r[0] for r in spark.read.text(path).limit(n).collect()]


def read_set(spark: SparkSession, path: str) -> DataFrame:
    """(value): the distinct lines, stripped."""
    return read_lines(spark, path).select(strip(F.col("value"), ALL_BLANKS).alias("value")).distinct()


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(at, word): the words of all lines in order, from 0."""
    from eventweave.operators.ordering import number_lines

    rows = number_lines(read_lines(spark, path), "line").select("line", F.posexplode(split_blank(F.col("value"))).alias("i", "word"))
    from eventweave.operators.ordering import number_rows

    return number_rows(rows, [F.col("line"), F.col("i")], "at", 0).select("at", "word")


def read_labels(spark: SparkSession, path: str) -> Labels:
    """Accepted parts of speech (first line) and relation prefixes (second). An empty relation line accepts all relations, an empty first line no word."""
    lines = [x.strip() for x in head_lines(spark, path, 2)]
    pos, relations = (lines + ["", ""])[:2]
    return Labels(tuple(pos.split()), tuple(relations.split()) or None)


def read_relations(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Relation map: the first column's relation has the roles of the comma list in the second; further columns are ignored."""
    out = {}
    for r in spark.read.text(path).collect():  # a map of a few relations
        cells = r[0].split()
        if len(cells) >= 2:
            out[cells[0]] = cells[1].split(",")
    return out


def _scalar(text: str) -> Any:
    text = text.strip().strip("\"'")
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    try:
        return float(text)
    except ValueError:
        return {"true": True, "false": False, "null": None, "": None}.get(text.lower(), text)


def load_config(text: str) -> Any:
    """An immutable object of nested attributes from YAML text: mappings, scalars and `[a, b]` lists. With PyYAML installed, any YAML mapping."""
    try:
        import yaml

        tree = yaml.safe_load(text) or {}
    except ImportError:
        tree, stack = {}, []
        stack = [(-1, tree)]
        for line in text.splitlines():
            line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
            if not line or ":" not in line:
                continue
            depth = len(line) - len(line.lstrip())
            key, _, value = line.strip().partition(":")
            while stack[-1][0] >= depth:
                stack.pop()
            value = value.strip()
            if not value:
                stack[-1][1][key] = {}
                stack.append((depth, stack[-1][1][key]))
            elif value.startswith("[") and value.endswith("]"):
                stack[-1][1][key] = [_scalar(x) for x in value[1:-1].split(",") if x.strip()]
            else:
                stack[-1][1][key] = _scalar(value)
    return _freeze(tree)


def _freeze(x: Any) -> Any:
    if isinstance(x, dict):
        kind = dataclasses.make_dataclass("Config", [str(k) for k in x], frozen=True)
        return kind(*[_freeze(v) for v in x.values()])
    return tuple(map(_freeze, x)) if isinstance(x, list) else x
