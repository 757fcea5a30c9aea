"""Products of more rows than a double holds."""

import math

import pytest
from pyspark.sql import functions as F

from lattica.operators import aggregate as ag
from lattica.queries import subtotal_codes


def test_a_product_beyond_a_double(spark):
    df = spark.createDataFrame([("many", 50)] * 800 + [("few", 3), ("few", -4), ("zero", 0), ("zero", 5)], "g string, n int")
    made = {r["g"]: (r["p"], r["l"]) for r in df.groupBy("g").agg(ag.subtotal(6, F.col("n")).alias("p"), ag.log_product(F.col("n")).alias("l")).collect()}
    assert made == {"many": (None, pytest.approx(800 * math.log(50))), "few": (-12.0, None), "zero": (0.0, None)}


def test_the_codes_of_a_large_group(spark):
    class Large:
        part = spark.range(1000).select(F.lit("B").alias("p_brand"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))

    assert subtotal_codes(Large).first()["s6"] == round(20 * math.lgamma(51), 4)
