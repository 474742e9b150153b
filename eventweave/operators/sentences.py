"""Sentences of tokens, from rows of one line each or from text of one sentence each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventweave.functions.labels import accepted_lemma, entity_or
from eventweave.functions.text import ALL_BLANKS, rsplit_relation, split_exact, strip
from eventweave.operators.latest import latest_rows
from eventweave.operators.malformed import FIELDS, NO_FIELDS, parse_lines

#: Lines of a file whose sentence bounds are counted together.
CHUNK = 10_000


def raw_tokens(parsed: Column) -> tuple[Column, Column]:
    """(tokens, bad) of an array of parsed lines (structs of FIELDS).

    Tokens are structs (id, text, lemma, upos, head, deprel), all strings, one per relation of each line with an accepted lemma, in order; names of entities
    stand for proper nouns, other lemmas are in lower case. bad: some accepted line has a relation without `=`.
    """
    kept = F.filter(parsed, lambda t: accepted_lemma(t["lemma"]))

    def one(t: Column) -> Column:
        lemma = entity_or(t["lemma"], t["upos"], t["ne"], F.lower(t["lemma"]))
        text = entity_or(t["text"], t["upos"], t["ne"], t["text"])

        def each(r: Column) -> Column:
            _, relation, head = rsplit_relation(r)
            return F.struct(t["id"].alias("id"), text.alias("text"), lemma.alias("lemma"), t["upos"].alias("upos"), head.alias("head"), relation.alias("deprel"))

        return F.transform(F.split(t["deprels"], ",", -1), each)

    bad = F.exists(kept, lambda t: F.exists(F.split(t["deprels"], ",", -1), lambda r: ~F.contains(r, F.lit("="))))
    return F.flatten(F.transform(kept, one)), bad


def is_blank(line: Column) -> Column:
    """Ends a sentence: null, or nothing but white space."""
    return line.isNull() | (strip(line, ALL_BLANKS) == "")


def sentence_numbers(lines: DataFrame, file: str = "file_name", at: str = "line_no", chunk: Column | None = None, line: str = "line") -> DataFrame:
    """`lines` with `sentence`: blank lines before the line in its file. A file is counted in chunks, by default of CHUNK lines, so a large one is no single task."""
    chunk = F.floor(F.col(at) / CHUNK) if chunk is None else chunk
    marked = lines.withColumn("__chunk", chunk).withColumn("__blank", is_blank(F.col(line)).cast("bigint"))
    own = marked.groupBy(file, "__chunk").agg(F.sum("__blank").alias("__k"))
    shift = own.select(file, "__chunk", F.coalesce(F.sum("__k").over(W.partitionBy(file).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    within = F.coalesce(F.sum("__blank").over(W.partitionBy(file, "__chunk").orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = marked.withColumn("__within", within).join(shift, [file, "__chunk"])
    return out.withColumn("sentence", F.col("__within") + F.col("__shift")).drop("__chunk", "__blank", "__within", "__shift")


def line_sentences(lines: DataFrame, files: DataFrame | None = None, delimiter: str = "space") -> DataFrame:
    """(file_name, sentence, tokens) of the rows of `lines` (file_name, line_no, line, loaded_at, line_id).

    Of lines delivered twice the latest counts. A sentence with a line that isn't six fields, or with a relation without `=` of an accepted lemma, is dropped
    as a whole; so is one without accepted tokens. Other lemmas are skipped, odd ids, heads and relations kept, as in `text_sentences`. Rows without file or
    number are left out.
    """
    rows = lines.filter(F.col("file_name").isNotNull() & F.col("line_no").isNotNull()).select("file_name", "line_no", "line", "loaded_at", "line_id")
    # repeats of a line and its sentence are found where its chunk lies: lines are moved once for both
    rows = rows.withColumn("chunk", F.floor(F.col("line_no") / CHUNK)).repartition("file_name", "chunk")
    rows = latest_rows(rows, ["file_name", "chunk", "line_no"], "loaded_at", ["line_id"]).drop("loaded_at", "line_id")
    parsed = parse_lines(sentence_numbers(rows, chunk=F.col("chunk")), files, delimiter=delimiter, keep_odd=True).filter(F.col("id").isNotNull() | F.col("reason").isNotNull())
    whole = parsed.groupBy("file_name", "sentence").agg(F.array_sort(F.collect_list(F.struct("line_no", *FIELDS))).alias("parsed"), F.count_if(F.coalesce(F.col("reason").isin(*NO_FIELDS), F.lit(False))).alias("rejected"))
    tokens, bad = raw_tokens(F.col("parsed"))
    return whole.filter(F.col("rejected") == 0).filter(~bad).select("file_name", "sentence", tokens.alias("tokens")).filter(F.size("tokens") > 0)


def text_sentences(texts: DataFrame, text: str = "value", delimiter: str = " ", strict: bool = True) -> DataFrame:
    """`tokens` of rows that hold one sentence of lines each; the row's other columns are kept. Row-local: nothing is moved.

    A line without exactly six fields fails the query (`strict`), or drops its sentence.
    """
    split = F.transform(F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: strip(x, ALL_BLANKS)), lambda x: x != ""), lambda x: split_exact(x, delimiter))
    rows = texts.withColumn("__lines", split)
    wrong = F.exists("__lines", lambda x: F.size(x) != len(FIELDS))
    if strict:
        fail = F.raise_error(F.concat(F.lit("a line doesn't have six fields: "), F.to_json(F.filter("__lines", lambda x: F.size(x) != len(FIELDS)))))
        rows = rows.withColumn("__lines", F.when(wrong, fail.cast(rows.schema["__lines"].dataType)).otherwise(F.col("__lines")))
    else:
        rows = rows.filter(~wrong)
    parsed = F.transform("__lines", lambda x: F.struct(*[F.get(x, F.lit(i)).alias(c) for i, c in enumerate(FIELDS)]))
    rows = rows.withColumn("__lines", parsed)
    tokens, bad = raw_tokens(F.col("__lines"))
    return rows.filter(~bad).withColumn("tokens", tokens).filter(F.size("tokens") > 0).drop("__lines", text)
