"""A relational star schema viewed as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexgraph.plans.catalog import GraphCatalog


def star_graph(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    """Regions, nations, customers, suppliers, parts and orders as nodes; foreign keys as containments; parts that
    follow each other in an order as calls, a tree over part keys as inheritance, a cyclic map of suppliers as imports."""

    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    g = GraphCatalog()
    g.add_node("Region", lambda: t("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")))
    g.add_node("Nation", lambda: t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")))
    g.add_node("Customer", lambda: t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")))
    g.add_node("Supplier", lambda: t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))
    g.add_node("Part", lambda: t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price")))
    g.add_node("Order", lambda: t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")))

    def key(table: str, src: str, dst: str):
        return lambda: t(table).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))

    g.add_rel("REGION_CONTAINS_NATION", "Region", "Nation", key("nation", "n_regionkey", "n_nationkey"))
    g.add_rel("NATION_CONTAINS_CUSTOMER", "Nation", "Customer", key("customer", "c_nationkey", "c_custkey"))
    g.add_rel("NATION_CONTAINS_SUPPLIER", "Nation", "Supplier", key("supplier", "s_nationkey", "s_suppkey"))
    g.add_rel("CUSTOMER_CONTAINS_ORDER", "Customer", "Order", key("orders", "o_custkey", "o_orderkey"))
    g.add_rel("ORDER_CONTAINS_PART", "Order", "Part", key("lineitem", "l_orderkey", "l_partkey"))
    g.aliases["CONTAINS"] = sorted(g.rels)

    def calls() -> DataFrame:
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        rows = t("lineitem").select("l_quantity", "l_returnflag", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_linenumber").cast("long").alias("line_number"))
        return rows.filter("dst IS NOT NULL AND l_quantity >= 45 AND l_returnflag = 'R'").select("src", "dst", "line_number")

    def imports() -> DataFrame:
        s = t("supplier").select(F.col("s_suppkey").alias("src"))
        return s.select("src", ((F.col("src") * 3 + 1) % F.lit(s.count())).alias("dst"))

    g.add_rel("CALLS", "Part", "Part", calls)
    g.add_rel("INHERITS", "Part", "Part", lambda: t("part").filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst")))
    g.add_rel("IMPORTS", "Supplier", "Supplier", imports)
    return g
