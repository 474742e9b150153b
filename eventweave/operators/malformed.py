"""Rows that fail to parse: valid tokens and rejected lines with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventweave.functions.text import LINE_BLANKS, rsplit_relation, strip
from eventweave.functions.vectors import let

#: The line format; `corrupt` holds the raw text of what the reader couldn't take.
FIELDS = ("id", "text", "lemma", "upos", "ne", "deprels")
LINE_SCHEMA = T.StructType([*(T.StructField(c, T.StringType()) for c in FIELDS), T.StructField("corrupt", T.StringType())])
#: Fixed values of the format.
DELIMITERS = {"space": " ", "tab": "\t"}
RELATION = r"\A[A-Za-z][A-Za-z0-9:_-]*\z"
NUMBER = r"\A[0-9]+\z"
BAD_LEMMA = "[\\x00- @\uFFFD\u007F]"
REASONS = ("quoting", "columns", "token_id", "lemma", "deprel", "head")
#: Columns that the reader has room for by default, less a margin.
READER_COLUMNS = 20_000
#: Reasons of lines that can't be divided into the six fields.
NO_FIELDS = ("quoting", "columns")


def _read(raw: Column, delimiter: str) -> Column:
    """Permissive read of one line under the explicit schema. A line feed inside a line is data: the line separator is a character that no text line has."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "sep": delimiter, "quote": '"', "escape": '"', "lineSep": "\x01", "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return F.from_csv(raw, LINE_SCHEMA.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)


def _quotes(raw: Column, delimiter: Column) -> Column:
    """struct (sound: are the quotes, fields: how many) of a line, linear in its length.

    Cut at the double quotes, pieces at even places are outside. Inside the line such a piece is empty (a doubled quote) or begins and ends with a
    delimiter; the first ends and the last begins with one, or is empty; and the number of quotes is even.
    """
    at_start = lambda x: F.startswith(x, delimiter)
    at_end = lambda x: F.endswith(x, delimiter)

    def judge(p: Column) -> Column:
        last = F.size(p) - 1  # of a bound variable: the line is cut once, not once a piece
        sound = F.transform(p, lambda x, i: (i % 2 == 1) | (x == "") | (((i == 0) | at_start(x)) & ((i == last) | at_end(x))))
        outside = F.transform(p, lambda x, i: F.when(i % 2 == 0, F.length(x) - F.length(F.replace(x, delimiter, F.lit("")))).otherwise(0))
        return F.struct(((last % 2 == 0) & F.forall(sound, lambda x: x)).alias("sound"), (F.aggregate(outside, F.lit(0), lambda n, x: n + x) + 1).alias("fields"))

    return let(F.split(raw, '"', -1), judge)


def _is_number(x: Column) -> Column:
    return x.rlike(NUMBER)


def _value(digits: Column) -> Column:
    """Digits as a number; null beyond 38 of them."""
    return digits.try_cast("decimal(38,0)")


def _is_positive(digits: Column) -> Column:
    return F.coalesce(_value(digits) >= 1, F.ltrim(digits, F.lit("0")) != "")


def _same_number(a: Column, b: Column) -> Column:
    """Equal as numbers, whatever their length and leading zeros."""
    return F.coalesce(_value(a) == _value(b), F.ltrim(a, F.lit("0")) == F.ltrim(b, F.lit("0")))


def _outcome(raw: Column, is_tab: Column, keep_odd: bool) -> Column:
    """struct (*FIELDS, reason) of one line. Each step is bound once: the line is read once, whatever is made of it."""
    sep = F.when(is_tab, "\t").otherwise(" ")
    quoted = F.contains(raw, F.lit('"'))
    # the reader drops U+0000 inside quotes: such lines are read with it escaped
    nul = F.contains(raw, F.lit("\x00"))
    escaped = F.when(nul, F.replace(F.replace(raw, F.lit("\x02"), F.lit("\x02b")), F.lit("\x00"), F.lit("\x02a"))).otherwise(raw)
    restored = lambda x: F.when(nul, F.replace(F.replace(x, F.lit("\x02a"), F.lit("\x00")), F.lit("\x02b"), F.lit("\x02"))).otherwise(x)
    plain_count = F.length(raw) - F.length(F.replace(raw, sep, F.lit(""))) + 1

    def of_values(shape: Column, v: Column) -> Column:
        pieces = F.split(v["deprels"], ",", -1)

        def bad_relation(piece: Column) -> Column:
            has, relation, _ = rsplit_relation(piece)
            return ~has | ~relation.rlike(RELATION)

        def bad_head(piece: Column) -> Column:
            head = F.substring_index(piece, "=", -1)
            return ~_is_number(head) | _same_number(head, v["id"])

        reason = (
            F.when(shape.isNotNull(), shape)
            .when(~(_is_number(v["id"]) & _is_positive(v["id"])), "token_id")
            .when((v["lemma"] == "") | v["lemma"].rlike(BAD_LEMMA), "lemma")
            .when(F.exists(pieces, bad_relation), "deprel")
            .when(F.exists(pieces, bad_head), "head")
        )

        def result(reason: Column) -> Column:
            has = (reason.isNull() | ~reason.isin(*NO_FIELDS)) if keep_odd else reason.isNull()
            return F.struct(*[F.when(has, v[c]).alias(c) for c in FIELDS], reason.alias("reason"))

        return let(reason, result)

    def of_read(quotes: Column, read: Column) -> Column:
        # only what the reader kept as corrupt, or may have read too laxly, is judged again by its quotes and count
        again = read.isNull() | read["corrupt"].isNotNull() | quoted
        shape = F.when(again, F.when(quoted & ~quotes["sound"], "quoting").when(F.when(quoted, quotes["fields"]).otherwise(plain_count) != len(FIELDS), "columns"))
        values = F.struct(*[restored(F.coalesce(read[c], F.lit(""))).alias(c) for c in FIELDS])
        return let(shape, lambda s: let(values, lambda v: of_values(s, v)))

    def of_quotes(quotes: Column) -> Column:
        # the reader fails on a line of more columns than it has room for, whatever its mode
        readable = (F.length(raw) < READER_COLUMNS) | (plain_count < READER_COLUMNS) | (quotes["sound"] & (quotes["fields"] == len(FIELDS)))
        of = lambda kind: F.when(readable & kind, escaped)
        return let(F.when(is_tab, _read(of(is_tab), "\t")).otherwise(_read(of(~is_tab), " ")), lambda r: of_read(quotes, r))

    return F.when(raw != "", let(F.when(quoted, _quotes(raw, sep)), of_quotes))


def parse_lines(lines: DataFrame, files: DataFrame | None = None, line: str = "line", file: str = "file_name", delimiter: str = "space", keep_odd: bool = False) -> DataFrame:
    """`lines` with `id, text, lemma, upos, ne, deprels` of sound token lines, `corrupt` (the raw line) and `reason` of the others.

    A reason is the first of REASONS that holds. Blank lines and null lines are sentence bounds: all of these columns are null. The delimiter of a line is
    that of its file in `files` (`space` or `tab`); lines of unknown files, or whose file has none, have `delimiter`. Existing columns named like the new
    ones are replaced. Rows stay as many as they are; the only join is on the file name.

    keep_odd: lines of six fields keep their values beside a reason that isn't one of NO_FIELDS.

    Every line is read permissively under LINE_SCHEMA, which keeps the raw text of what isn't six columns as corrupt. Corrupt lines, and lines with quotes, about
    which the reader is laxer than the format, are judged again by quotes and count; then the values are checked, numbers by casts. Lines with more delimiters
    than the reader has room for are judged first and read only if six fields are left.
    """
    new = [*FIELDS, "corrupt", "reason"]
    out = lines.drop(*[c for c in new if c in lines.columns])
    if files is not None:
        delims = files.filter(F.col(file).isNotNull()).groupBy(F.col(file).alias("__file")).agg(F.max(F.lower(strip(F.col("delim")))).alias("__delim"))
        out = out.join(delims, out[file] == delims["__file"], "left").drop("__file")
    else:
        out = out.withColumn("__delim", F.lit(None).cast("string"))
    out = out.withColumn("__raw", strip(F.col(line), LINE_BLANKS)).withColumn("__tab", F.coalesce(F.col("__delim"), F.lit(delimiter)) == "tab")
    # a generator of one row: what stands above it can't make Spark read the line again
    out = out.select("*", F.inline_outer(F.array(_outcome(F.col("__raw"), F.col("__tab"), keep_odd))))
    out = out.withColumn("corrupt", F.when(F.col("reason").isNotNull(), F.col(line)))
    return out.select(*[c for c in lines.columns if c not in new], *FIELDS, "corrupt", "reason")


def rejected(lines: DataFrame, files: DataFrame | None = None, **options: str) -> DataFrame:
    """Only the lines that break the format, with `corrupt` and `reason`."""
    return parse_lines(lines, files, **options).filter(F.col("reason").isNotNull()).drop(*FIELDS)


def tokens(lines: DataFrame, files: DataFrame | None = None, **options: str) -> DataFrame:
    """Only the valid token lines, with their values; `id` as a number is `token_id` (null beyond 64 bits)."""
    out = parse_lines(lines, files, **options).filter(F.col("id").isNotNull()).drop("corrupt", "reason")
    return out.withColumn("token_id", F.expr("try_cast(id AS BIGINT)"))
