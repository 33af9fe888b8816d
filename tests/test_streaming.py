"""The micro-batch adapter applies a batch operator to arriving files once."""

from pyspark.sql import functions as F

from ledgerlens.operators.grouped import performance
from ledgerlens.roles import Roles
from ledgerlens.streaming import run_on_new_files


def test_filedrop_applies_operator(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("Region,Sales,Profit\nEast,100,10\nWest,50,-5\n")
    (src / "b.csv").write_text("Region,Sales,Profit\nEast,20,2\n")
    roles = Roles(region="Region", sales="Sales", profit="Profit")
    q = run_on_new_files(spark, str(src), "Region string, Sales double, Profit double",
                         lambda b: performance(b, roles, "region", sort=False).select("dimension_value", "sales", "profit"),
                         str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert "batch_id" in out.columns
    tot = out.agg(F.sum("sales"), F.sum("profit")).first()
    assert tot[0] == 170 and tot[1] == 7
