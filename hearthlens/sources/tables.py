"""Table access and the dwelling proxy view.

``dwellings(spark, sf_dir)`` turns the benchmark star schema into a wide
one-row-per-dwelling table with the columns the energy-certificate analysis
expects (county, type, year, rating, U-values, areas, fuels, flags ...).
It is written with the DataFrame API so Catalyst prunes columns at every scan
and picks the join strategies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Row key of the proxy table: every shorter key repeats somewhere.
DWELLING_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _d(x: float) -> Column:
    return F.lit(float(x))


def dwellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proxy dwelling table (see FIXTURES.md §1 for the column recipe)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")

    # Dimension side first (orders x customer x nation), then the fact table.
    # nation is a fixed 25-row code table: a broadcast with a fixed size bound.
    # The fact side (lineitem, and everything joined to it) is never a
    # broadcast build side: the static size estimate of a pruned Parquet scan
    # can fall under the broadcast threshold; the shuffle_merge hint pins
    # shuffle joins (AQE still splits skewed keys and coalesces partitions).
    cust_n = cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey)
    ord_c = orders.join(cust_n, orders.o_custkey == cust_n.c_custkey)
    j1 = li.hint("shuffle_merge").join(ord_c, li.l_orderkey == ord_c.o_orderkey)
    j = j1.hint("shuffle_merge").join(part, j1.l_partkey == part.p_partkey)

    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    qty, psize = F.col("l_quantity"), F.col("p_size")
    null_d = F.lit(None).cast("double")
    null_s = F.lit(None).cast("string")
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        qty.cast("int").alias("l_quantity"),
        F.col("n_name").alias("CountyName"),
        F.concat(F.col("p_type"), F.lit("   ")).alias("DwellingTypeDescr"),
        (F.lit(1850) + F.pmod(pk * 7 + ok, F.lit(175))).cast("int").alias("Year_of_Construction"),
        F.when(F.pmod(ok, F.lit(997)) == 1, _d(-472.99))
         .when(F.pmod(ok, F.lit(991)) == 1, _d(32134.94))
         .otherwise(F.col("l_extendedprice") / 200.0).alias("BerRating"),
        (F.col("l_discount") * 20.0).alias("UValueWall"),
        (F.col("l_tax") * 10.0).alias("UValueRoof"),
        ((F.col("l_discount") + F.col("l_tax")) * 5.0).alias("UValueFloor"),
        (qty / 10.0).alias("UValueWindow"),
        _d(3.0).alias("UvalueDoor"),
        F.when(F.pmod(pk, F.lit(101)) == 0, _d(0.0)).otherwise(psize * 3.0).alias("WallArea"),
        (psize * 1.5).alias("RoofArea"),
        (qty * 2.0).alias("FloorArea"),
        (psize * 0.5).alias("WindowArea"),
        _d(1.85).alias("DoorArea"),
        F.when(F.pmod(ok, F.lit(31)) == 0, null_d).otherwise(qty * 2.0).alias("GroundFloorAreasq_m"),
        F.when(F.pmod(ok, F.lit(53)) == 0, null_d).otherwise(60.0 + qty * 1.1).alias("HSMainSystemEfficiency"),
        F.when(F.pmod(ok, F.lit(53)) == 0, null_d).otherwise(F.col("l_tax")).alias("HSSupplHeatFraction"),
        F.when(F.pmod(ok, F.lit(59)) == 0, null_s)
         .when(F.pmod(ok, F.lit(17)) == 0, F.lit("Please select"))
         .otherwise(F.col("c_mktsegment")).alias("StructureType"),
        F.when(F.pmod(ok, F.lit(59)) == 0, null_d)
         .otherwise(F.col("l_linenumber") * 1.0).alias("NoOfSidesSheltered"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Heating Oil   "))
         .when(F.col("o_orderpriority") == "2-HIGH", F.lit("Mains Gas"))
         .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("Electricity"))
         .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("Solid Multi-Fuel"))
         .alias("MainSpaceHeatingFuel"),
        F.when(F.col("l_returnflag") == "A", F.lit("YES"))
         .when(F.col("l_returnflag") == "R", F.lit("NO")).alias("SolarHotWaterHeating"),
        F.when(F.col("l_linestatus") == "F", F.lit("No"))
         .when(F.pmod(ok, F.lit(5)) == 0, F.lit("Yes")).alias("HESSchemeUpgrade"),
        F.when(F.pmod(pk, F.lit(7)) == 0, F.lit("No"))
         .otherwise(qty.cast("int").cast("string")).alias("DeclaredLossFactor"),
        F.when(F.pmod(sk, F.lit(2)) == 0, F.lit("YES")).alias("StorageLosses"),
    )
