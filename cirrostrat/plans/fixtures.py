"""Ensemble views of the driver's tables. Each reads its whole table once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import POINT

NX, NY, NZ, MEMBERS = 4, 4, 3, 8
TRUTH, PRIOR = 3, 6
R0 = 5.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ensemble of 8 members on 4 x 4 x 3 points from averages of line items."""
    rows = table(spark, sf_dir, "lineitem")
    index = {
        "i": F.col("l_partkey") % NX,
        "j": F.floor(F.col("l_orderkey") / 7) % NY,
        "k": F.col("l_linenumber") % NZ,
        "m": F.col("l_orderkey") % MEMBERS,
    }
    share = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, 1.0).otherwise(0.0))
    quantity, price, discount, tax = (F.avg(f"l_{c}") for c in ("quantity", "extendedprice", "discount", "tax"))
    return rows.groupBy(*(c.cast("int").alias(n) for n, c in index.items())).agg(
        (F.abs(tax - 0.04) * 0.2).alias("qg"),
        (F.abs(discount - 0.05) * 0.2).alias("qr"),
        (F.abs(share("R") - 0.25) * 0.01).alias("qs"),
        ((quantity - 25.5) * 2.0 + 273.0).alias("t"),
        (price / 2.0 + 50000.0).alias("p"),
        (quantity - 25.5).alias("u"),
        (price / 1000.0 - 38.0).alias("v"),
        ((discount - 0.05) * 100.0).alias("w"),
    )


def grid(spark: SparkSession, nx: int = NX, ny: int = NY) -> DataFrame:
    out = spark.range(nx * ny * NZ).select((F.col("id") % nx).cast("int").alias("i"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("j"), F.floor(F.col("id") / (nx * ny)).cast("int").alias("k"))
    return out.select("i", "j", "k", (F.col("i") * 2.0).alias("x_km"), (F.col("j") * 2.0).alias("y_km"), F.col("k").cast("double").alias("z_km"))


def domain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(state, grid) of an ensemble whose domain grows with the orders: 8 members on side x side x 3 points, one
    order for each member and point. The number of orders comes from the files' metadata."""
    orders = table(spark, sf_dir, "orders")
    side = max(1, math.isqrt(orders.count() // (MEMBERS * NZ)))
    cell = F.floor(F.col("o_orderkey") / (MEMBERS * NZ))
    cents = F.round(F.col("o_totalprice") * 100.0).cast("long")
    rows = orders.select(
        (cell % side).cast("int").alias("i"), F.floor(cell / side).cast("int").alias("j"), (F.floor(F.col("o_orderkey") / MEMBERS) % NZ).cast("int").alias("k"), (F.col("o_orderkey") % MEMBERS).cast("int").alias("m"),
        (cents % 997).alias("a"), (F.floor(cents / 997) % 991).alias("b"), (F.col("o_custkey") % 89).alias("c"),
    )
    state = rows.where(F.col("j") < side).select(
        *POINT, "m", (F.col("b") / 991.0 * 0.002).alias("qg"), (F.col("a") / 997.0 * 0.002).alias("qr"), (F.col("c") / 89.0 * 0.001).alias("qs"),
        ((F.col("a") - F.col("b")) / 100.0 + 273.0).alias("t"), (F.col("b") * 30.0 + 60000.0).alias("p"),
        ((F.col("b") - 495) / 30.0).alias("u"), ((F.col("a") - 498) / 30.0).alias("v"), ((F.col("c") - 44) / 20.0).alias("w"),
    )
    return state, grid(spark, side, side)


def hx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ensemble of 64 values for each observation: obs_id, m, y."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obs_id"), F.posexplode("embedding").alias("m", "e"))
    return rows.select("obs_id", "m", (F.col("e").cast("double") * 40.0 + 20.0).alias("y"))


def hx_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obs_id"), (F.col("label") * 5.0 + 10.0).alias("yo"), F.lit(R0).alias("r0"))


def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, d: event values about 50, scaled."""
    return table(spark, sf_dir, "events").select("event_type", ((F.col("value") - 50.0) * 0.4).alias("d"))


def latlon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slightly turned grid of 16 rows and 25 columns: j, i, lat, lon."""
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 16).cast("int").alias("j"), (F.floor(F.col("c_custkey") / 16) % 25).cast("int").alias("i")).distinct()
    return rows.select("j", "i", (F.lit(-35.0) + F.col("j") * 0.02 + F.col("i") * 0.001).alias("lat"), (F.lit(-60.0) + F.col("i") * 0.025 - F.col("j") * 0.002).alias("lon"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("ts_hour"), "event_type").agg(F.sum("value").alias("total"))
    return rows
