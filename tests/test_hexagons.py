"""Positions on the border of two hexagons."""

from pyspark.sql import functions as F

from fleetspark.functions import hexgrid
from fleetspark.operators import handover
from tests.compare import connection, same

SF = "/root/testdata/sf0.001"
#: Positions on the meridian where q and s are equal (the border of two hexagons in every second row) and beside it by
#: less than a cosine's last bits, as sums of decimals in any order leave them.
BORDER = """SELECT i * 20 + j * 4 + k AS seq, 1.285e1 + i / 1e4 AS lat, 8.005e1 + (15 - j) / 1e2 + j / 1e2 + (k - 1) * 1.4210854715202004e-14 AS lon
FROM (SELECT {i} AS i) AS a, (SELECT {j} AS j) AS b, (SELECT {k} AS k) AS c"""


def test_border_positions_get_the_cell_of_the_sql(spark):
    rows = spark.sql(BORDER.format(i="explode(sequence(0, 2999))", j="explode(sequence(0, 4))", k="explode(sequence(0, 2))"))
    got = handover.with_cell(rows).select("seq", F.expr(hexgrid.cell_id("hex_q", "hex_r")).alias("cell"))
    sql = BORDER.format(i="unnest(range(0, 3000))", j="unnest(range(0, 5))", k="unnest(range(0, 3))")
    same(got, connection(SF), f"SELECT seq, {hexgrid.cell_id(*hexgrid.axial('lat', 'lon'))} AS cell FROM ({sql}) t")


def test_a_hair_does_not_decide(spark):
    rows = spark.sql(BORDER.format(i="explode(sequence(0, 2999))", j="0", k="explode(sequence(0, 2))"))
    cells = handover.with_cell(rows).groupBy("lat").agg(F.count_distinct("hex_q", "hex_r").alias("n"))
    assert cells.filter("n > 1").count() == 0
