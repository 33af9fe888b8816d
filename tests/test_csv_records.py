"""CSV records over splits, against Spark's whole-file reader; shapes against parsing every value."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.dates import RULES, parse_date
from ledgerlens.functions.scalars import safe_numeric
from ledgerlens.functions.shapes import PLAIN_NUMBER, date_rule, shape_of
from ledgerlens.sources import csv_records as C
from ledgerlens.sources import ingest as IN


def whole(spark, path, n):
    schema = ", ".join(f"`c{i}` string" for i in range(n))
    return sorted(map(tuple, spark.read.options(header=True, quote='"', escape='"', multiLine=True).schema(schema).csv(path).collect()), key=repr)


def split(spark, path):
    df, names, _ = IN.read_csv(spark, path)
    return sorted(map(tuple, df.collect()), key=repr), names


@pytest.fixture
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def quoted(v):
    return '"' + v.replace('"', '""') + '"'


def test_records_over_block_edges(spark, tmp_path, small_splits):
    rng = random.Random(5)
    values = ["plain", quoted("a,b"), quoted('12"" wide'), quoted("two\nlines"), quoted("x\n" * 200 + "long"), quoted('"'), quoted("\n"), quoted(",\n,\""), '5" nail', "", '""', " pad ", quoted('q"\n"q')]
    for k in range(3):
        rows = [",".join([str(i), rng.choice(values), rng.choice(values)]) for i in range(150)]
        (tmp_path / f"f{k}.csv").write_text("id,left,right\n" + "\n".join(rows) + rng.choice(["", "\n", "\n\n"]))
    got, names = split(spark, str(tmp_path))
    assert names == ["id", "left", "right"] and got == whole(spark, str(tmp_path), 3) and len(got) == 450
    lines = C.lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    assert C.start_states(C.block_functions(lines)).where("inside").count() > 5   # blocks that start inside a field


def test_a_stray_quote_opens_nothing(spark, tmp_path, small_splits):
    (tmp_path / "s.csv").write_text("id,name\n" + "".join(f'{i},5" nail {i}\n' for i in range(100)))
    assert IN._lines_evidence(spark, str(tmp_path)) == (False, False)
    got, _ = split(spark, str(tmp_path))
    assert len(got) == 100 and got == whole(spark, str(tmp_path), 2)
    assert spark.read.csv(str(tmp_path)).rdd.getNumPartitions() > 3


def test_an_unclosed_field_ends_with_its_file(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('id,name\n1,x\n2,"open\n' + "more\n" * 100)
    (tmp_path / "b.csv").write_text('id,name\n3,"y\ny"\n')
    got, _ = split(spark, str(tmp_path))
    assert [r[0] for r in got] == ["1", "2", "3"] and got[1][1].count("more") == 100 and got[2][1] == "y\ny"


def test_header_with_a_line_break_latin1_and_empty(spark, tmp_path):
    p = tmp_path / "a folder" / "h 1%.csv"
    p.parent.mkdir()
    p.write_bytes('id,"two\nlines",Café\n1,"é\nü",x\n\n'.encode("latin1"))
    df, names, enc = IN.read_csv(spark, str(p))
    assert names == ["id", "two\nlines", "Café"] and enc == "ISO-8859-1" and [tuple(r) for r in df.collect()] == [("1", "é\nü", "x")]
    p.write_bytes("id,Café\n1,é\n".encode("latin1"))
    assert [tuple(r) for r in IN.load(spark, str(p)).collect()] == [(1.0, "é")]


def test_warnings(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_bytes("Sales,Profit,Profit.1,none,Ort\n1,2,3,,Köln\n".encode("latin1"))
    steps = IN.Ingest(spark, str(p))
    assert steps.typed().columns == ["Sales", "Profit", "Profit__2", "Ort"]
    assert sorted(map(tuple, steps.warnings().collect())) == [
        ("dropped", "Column 'none' holds nothing."), ("encoding", "The bytes are no UTF-8; read as ISO-8859-1."), ("renamed", "Column 3 'Profit.1' is read as 'Profit__2'.")]


TEXTS = ["$1,234.50", "(12)", "Rs. 5", "Rs5e3 INR", "USD 1", "12%", "1e5", "1E-5", ".5", "5.", "abc", "a1", "1.2.3", "nan", "NULL", "", "  7 ", "-", "1 2", "12,34", "€ 3", "9" * 40, "1d", "x 9 y 8 z 7",
         "2024-01-05", "2024-01-05T10:00:00Z", "2024-01-05 10:00:00 Europe/Paris", "2024/1/5", "20240105", "19990101", "12345678", "01/15/2024", "1.2.24", "1-2-2024 3:05 PM", "01/15/2024 15:04:05", "15-Jan-2024",
         "Jan 15, 2024", "September 2024", "15 sept 24", "no 5 day", "soon", "3 of 4 items left", "É 5", "2024-13-40", None]


def test_shapes_decide_like_values(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    rows = df.select("s", shape_of(F.col("s")).alias("shape"), safe_numeric(F.col("s")).isNotNull().alias("number"), F.col("s").rlike(PLAIN_NUMBER).alias("plain"), parse_date(F.col("s")).alias("date"))
    for r in rows.select("*", safe_numeric(F.col("shape")).isNotNull().alias("as_number"), F.col("shape").rlike(PLAIN_NUMBER).alias("as_plain"), date_rule(F.col("shape")).alias("rule")).collect():
        assert (r.number, r.plain) == (r.as_number, r.as_plain), r
        assert r.date is None or r.rule is not None, r
    for rule in RULES:  # a rule alone gives what all of them give for its shapes
        some = rows.where(date_rule(F.col("shape")) == rule).select("date", parse_date(F.col("s"), rules=[rule]).alias("alone")).collect()
        assert some and all(r.date == r.alone for r in some)


def test_blocks_are_read_once_for_marks_and_functions(spark, tmp_path, small_splits):
    (tmp_path / "s.csv").write_text("id,name\n" + "".join(f'{i},"a\nb"\n' if i % 7 == 3 else f"{i},c\n" for i in range(200)))
    blocks = IN._blocks(spark, str(tmp_path))
    assert blocks.columns == ["file", "block", "fn", "bad", "open"] and IN._lines_evidence(spark, str(tmp_path), blocks) == (False, True)
    df, names, _ = IN.read_csv(spark, str(tmp_path))
    assert names == ["id", "name"] and sorted((int(a), b) for a, b in df.collect()) == [(i, "a\nb" if i % 7 == 3 else "c") for i in range(200)]
