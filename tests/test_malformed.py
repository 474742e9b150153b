"""The line parser against a plain restatement of the format's rules."""
import random
import re

from pyspark.sql import functions as F

from eventweave.operators import malformed
from eventweave.operators.malformed import FIELDS, parse_lines, rejected, tokens

PIECES = ["1", "2", "a", "b", '"', '"', " ", "\t", "\n", "\r", "=", "@", ",", "ROOT=0", "nsubj=2", '""', "\x00", "\x01", "\x02a", "\\", "#", "é", " ", "�", ""]


def plain(line, d):
    s = line.strip(" \t\r\n")
    if not s:
        return None, None
    field = rf'"(?:[^"]|"")*"|[^"{d}]*'
    if not re.fullmatch(rf"(?:{field})(?:{d}(?:{field}))*", s, re.S):
        return "quoting", None
    values, at = [], 0
    while True:
        m = re.compile(field, re.S).match(s, at)
        values.append(m.group()[1:-1].replace('""', '"') if m.group().startswith('"') else m.group())
        at = m.end() + 1
        if at > len(s):
            break
    if len(values) != 6:
        return "columns", None
    if not re.fullmatch("[0-9]+", values[0]) or int(values[0]) < 1:
        return "token_id", None
    if not values[2] or re.search("[\x00- @�\x7f]", values[2]):
        return "lemma", None
    pieces = [p.rpartition("=") for p in values[5].split(",")]
    if any(not e or not re.fullmatch("[A-Za-z][A-Za-z0-9:_-]*", r) for r, e, _ in pieces):
        return "deprel", None
    if any(not re.fullmatch("[0-9]+", h) or int(h) == int(values[0]) for _, _, h in pieces):
        return "head", None
    return None, values


def test_against_plain_rules(spark):
    rnd = random.Random(5)
    cases = []
    for _ in range(6000):
        d = rnd.choice(" \t")
        if rnd.random() < 0.4:
            line = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14)))
        else:
            f = ["1", "x", "y", "N", "O", "nsubj=2,a=3"]
            for k in range(6):
                if rnd.random() < 0.3:
                    f[k] = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 4)))
                if rnd.random() < 0.3:
                    f[k] = '"' + f[k].replace('"', '""') + '"'
            line = d.join(f)
        cases.append((line, d))
    df = spark.createDataFrame([(i, s, "ft" if d == "\t" else "fs") for i, (s, d) in enumerate(cases)], "line_id long, line string, file_name string")
    files = spark.createDataFrame([("ft", "tab"), ("fs", " Space ")], "file_name string, delim string")
    got = {r.line_id: r for r in parse_lines(df, files).collect()}
    for i, (line, d) in enumerate(cases):
        reason, values = plain(line, d)
        r = got[i]
        assert (reason, values, line if reason else None) == (r.reason, [r[c] for c in FIELDS] if r.id is not None else None, r.corrupt), (line, d)


def test_very_many_delimiters(spark):
    for d, name in ((" ", "space"), ("\t", "tab")):
        run = d * 30000
        rows = [(1, f"1 a{run}b N O x=2".replace(" ", d), "columns"), (2, f'1 a b N O x"{run}y"z'.replace(" ", d), "quoting"), (3, f'1 "{run}" b N O x=2'.replace(" ", d), None), (4, f'1 "{run}"{run}N O x=2'.replace(" ", d), "columns"), (5, "1 a b N O x=2".replace(" ", d), None)]
        df = spark.createDataFrame([r[:2] for r in rows], "line_id long, line string")
        out = {r.line_id: r for r in parse_lines(df, delimiter=name).collect()}
        assert {i: r.reason for i, r in out.items()} == {i: reason for i, _, reason in rows}
        assert out[3].text == run and out[1].corrupt == rows[0][1]


def test_nulls_clashes_long_and_empty(spark):
    long = 'x""' * 20000
    rows = [(1, "1 a b N O x=2", "f", "kept"), (2, None, "f", "kept"), (3, " \r\n", None, "kept"), (4, "1 a b N O", "g", "kept"), (5, f'1 "{long}" b N O x=2', "f", "kept"), (5, f'1 "{long}" b N O x=2', "f", "kept"), (6, "01 a b N O x=" + "0" * 50 + "1", None, None), (7, "9" * 40 + " a b N O x=2", None, None)]
    df = spark.createDataFrame(rows, "line_id long, line string, file_name string, reason string").withColumn("lemma", F.lit("old")).withColumn("delim", F.lit("tab"))
    files = spark.createDataFrame([("f", "space"), ("f", "space"), (None, "tab"), ("g", None)], "file_name string, delim string")
    out = parse_lines(df, files)
    assert out.count() == 8 and sorted(out.columns) == sorted(["line_id", "line", "file_name", "delim", *FIELDS, "corrupt", "reason"])
    assert {(r.line_id, r.reason) for r in out.collect()} == {(1, None), (2, None), (3, None), (4, "columns"), (5, None), (6, "head"), (7, None)}
    t = {r.line_id: r for r in tokens(df, files).collect()}
    assert t[5].text == 'x"' * 20000 and t[7].token_id is None and t[1].token_id == 1
    assert rejected(df.limit(0), files.limit(0)).count() == 0
    assert parse_lines(df, None, delimiter="tab").filter("reason = 'columns'").count() == 4  # and two are quoting


def test_reader_keeps_what_is_judged_again(spark):
    """Without quotes, a line comes out of the permissive read whole exactly if it has six columns: the gate lets no bad row through."""
    rnd = random.Random(9)
    lines = {"".join(rnd.choice([x for x in PIECES if '"' not in x]) for _ in range(rnd.randint(1, 16))).strip(" \t\r\n") for _ in range(3000)} - {""}
    df = spark.createDataFrame([(x,) for x in sorted(lines)], "line string").filter(~F.contains("line", F.lit("\x00")))
    for d in (" ", "\t"):
        got = df.select("line", malformed._read(F.col("line"), d)["corrupt"].alias("corrupt")).collect()
        assert all((r.corrupt is None) == (r.line.count(d) == 5) for r in got)


def test_line_is_read_once(spark):
    df = spark.createDataFrame([("1 a b N O x=2", "f")], "line string, file_name string")
    files = spark.createDataFrame([("f", "tab")], "file_name string, delim string")
    plan = rejected(df, files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == 2  # one for each delimiter
