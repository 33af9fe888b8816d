"""Large tables are worked on in slices: the same rows, and never the disk of the whole table's shuffles."""

from __future__ import annotations

import glob
import time

import pytest
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.operators import customer, grouped, match, portfolio, star
from ledgerlens.roles import Roles
from ledgerlens.sources import ingest, sinks, testview

SALES = [(1, "2024-01-01", "Ann", "Pen", "A", 10.0, 4.0), (1, "2024-01-01", "Ann", "Pen", "A", 10.0, 4.0), (2, "2024-02-01", "Bob", None, "B", 5.0, 9.0), (3, None, None, "Ink", "A", 7.0, None),
         (4, "2024-03-01", "Cid", "Cap", None, None, 1.0), (None, "2024-03-02", "Ann", "Ink", "B", 3.0, 3.0), (5, "2023-03-02", "", "Pen", "B", 8.0, 1.0), (5, "2023-03-02", "Dee", "Box", "B", -8.0, 1.0)]
ROLES = Roles(order_id="o", date="d", customer="c", product="p", category="k", sales="s", cost="x", profit="x")


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(SALES, "o long, d string, c string, p string, k string, s double, x double").withColumn("d", F.to_timestamp("d"))


def rows(df):
    return sorted(map(str, df.collect()))


def shuffle_files(spark):
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|")
    return {n for n in names if "/shuffle_" in n}


@pytest.fixture
def folder(spark, tmp_path):
    """A shared folder of its own."""
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    yield session.shared_dir(spark).removeprefix("file:")
    spark.sparkContext.setCheckpointDir(before)


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    t = session.materialise([spark.range(1000).repartition(5, "id").where(session.in_slice(F.col("id"), i, 3)) for i in range(3)], "test")
    assert sorted(r.id for r in t.collect()) == list(range(1000))
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"   # as the session had it


def test_a_table_is_whole_with_its_last_slice(spark, tmp_path):
    path = str(tmp_path / "t")
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        session.write_slices([spark.range(5), broken], path)
    assert not testview._exists(spark, path)
    session.write_slices([spark.range(5), spark.range(5, 7)], path)   # what the broken write left is replaced
    assert testview._exists(spark, path) and sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(7))


def test_slices_of_the_star_join(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    put("lineitem", [(k if k % 11 else None, k % 4, 1 + k % 3, 2.0, 10.0 + k, 0.01, "N", None) for k in range(60)],
        "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp")
    put("orders", [(k if k else None, k % 5, None, "1-URGENT") for k in range(50)] + [(7, 2, None, "5-LOW")], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string")
    put("customer", [(k, f"C{k}", k % 2, "X") for k in range(4)], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string")
    put("nation", [(0, "N0", 0), (1, "N1", 1)], "n_nationkey long, n_name string, n_regionkey long")
    put("region", [(0, "EUROPE"), (1, "ASIA")], "r_regionkey long, r_name string")
    put("part", [(k, f"p{k}", "b", "PROMO", 3.0) for k in range(3)] + [(2, "p2 again", "b", "ECONOMY", 4.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double")
    whole = rows(testview.sales_fact_plan(spark, str(tmp_path)))
    parts = [rows(testview.sales_fact_plan(spark, str(tmp_path), i, 3)) for i in range(3)]
    assert sorted(sum(parts, [])) == whole and all(parts) and len(whole) > 20


def test_slices_of_the_star_fact(spark, sales, tmp_path):
    whole = rows(star.fact_sales(sales, ROLES))
    slices = star.fact_slices(sales, ROLES, 3)
    assert len(slices) == 3 and sorted(sum(map(rows, slices), [])) == whole and len(whole) == len(SALES)
    sinks.publish({"fact": slices, "one": star.dim_product(sales, ROLES)}, str(tmp_path / "set"), run="r")
    got = sinks.published(spark, str(tmp_path / "set"))
    assert rows(got["fact"]) == whole and all(sinks.verify(spark, str(tmp_path / "set")).values()) and got["one"].count() == 7


@pytest.mark.parametrize("most", [1, 4])
def test_slices_of_groups(sales, monkeypatch, most):
    monkeypatch.setattr(session, "SLICE_ROWS", 2)
    monkeypatch.setattr(session, "MOST_SLICES", most)
    assert session.slice_count(sales) == most
    assert rows(grouped.performance(sales, ROLES, "product", sort=False, written=True)) == rows(grouped.performance(sales, ROLES, "product", sort=False))
    assert rows(customer.customer_table(sales, ROLES, written=True)) == rows(customer.customer_table(sales, ROLES))
    assert portfolio.product_portfolio(sales, ROLES).count() == 5
    found = {(r.dimension, r.dimension_value): (r.order_count, r.row_count) for r in grouped.dim_perf(sales, ROLES, ["product", "category"]).collect()}
    assert found == {("product", "Pen"): (2, 3), ("product", None): (1, 1), ("product", "Ink"): (1, 2), ("product", "Cap"): (1, 1), ("product", "Box"): (1, 1),
                     ("category", "A"): (2, 3), ("category", "B"): (2, 4), ("category", None): (1, 1)}


@pytest.mark.parametrize("fuzzy", [False, True])
def test_slices_of_texts(spark, fuzzy):
    texts = spark.createDataFrame([(str(i % 9) if i % 10 else None, t) for i, t in enumerate(["chairs in asia", "Chairz of ann", "europ", None, "tables and chairs", "asia pacific"] * 4)], "text_id string, text string")
    df = spark.createDataFrame([("Asia", "Chairs", "Ann"), ("Europe", "Tables", "Bob"), ("Asia Pacific", "Chairs", None)], "region string, category string, customer string")
    roles = Roles(region="region", category="category", customer="customer")
    whole, parts = (rows(match.match_values(texts, df, roles, fuzzy, slices=n)) for n in (1, 3))
    assert whole == parts and len(whole) > 9


def test_ingest_does_not_write_the_text_again(spark, folder, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("id,name\n" + "".join(f'{i},"a\nb"\n' for i in range(50)))
    steps = ingest.Ingest(spark, str(p))
    assert steps.typed().count() == 50 and steps.shares().count() == 2 and steps.warnings().count() == 0
    written = [spark.read.parquet(f).columns for f in glob.glob(f"{folder}/ledgerlens/ingest_*")]
    assert ["id", "name"] in written and not [c for c in written if "c0" in c]


def test_the_csv_is_written_from_the_join_itself_and_gzipped(spark, folder, monkeypatch):
    from ledgerlens.plans import q_ingest

    from conftest import SMALL

    monkeypatch.setattr(session, "SLICE_ROWS", 3000)
    monkeypatch.setattr(q_ingest, "FILE_ROWS", 500)
    path = q_ingest.csv_path(spark, SMALL)
    assert not glob.glob(f"{folder}/ledgerlens/sales_fact_*")   # the fact's table isn't needed for it
    files = glob.glob(path.removeprefix("file:") + "/part-*")
    assert len(files) >= 10 and all(f.endswith(".csv.gz") for f in files)
    got = ingest.Ingest(spark, path).raw()
    assert got.columns == q_ingest.DEDUPED and got.count() == testview.sales_fact_plan(spark, SMALL).count()
