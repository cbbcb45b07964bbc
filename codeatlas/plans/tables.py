"""The driver's tables as a graph: customers, suppliers, parts and orders are entities, nations
their files, and orders refer to customers and parts, parts to suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CodeGraph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    # Nations and regions are of fixed size.
    place = F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))
    line = lambda k: (k % 1000 + 1).cast("int")
    row = lambda kind, key, name, file, features, path: (
        F.concat(F.lit(f"{kind[0]}:"), key.cast("string")).alias("id"), F.lit(kind[1]).alias("kind"), name.alias("name"), file.alias("file"), line(key).alias("line_start"),
        (line(key) + (key % 50).cast("int")).alias("line_end"), features.alias("semantic_features"), path.alias("hierarchy_path"),
    )
    c = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    customers = c.select(*row(("customer", "class"), F.col("c_custkey"), F.col("c_name"), F.concat("r_name", F.lit("/"), "n_name"), F.array(F.lower("c_mktsegment"), F.lit("place order")), F.concat_ws("/", "r_name", "n_name", "c_mktsegment")))
    s = t("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    suppliers = s.select(*row(("supplier", "service"), F.col("s_suppkey"), F.col("s_name"), F.concat("r_name", F.lit("/"), "n_name"), F.array(F.lit("supply parts")), F.concat_ws("/", "r_name", "n_name", F.lit("SUPPLIER"))))
    p = t("part")
    parts = p.select(*row(("part", "model"), F.col("p_partkey"), F.col("p_name"), F.concat(F.lit("PARTS/"), "p_brand"), F.array(F.lower("p_name"), F.lower("p_type"), F.lower("p_brand")), F.concat_ws("/", F.lit("PARTS"), "p_brand", "p_type")))
    o = t("orders").join(c.select("c_custkey", "r_name", "n_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    orders = o.select(*row(("order", "function"), F.col("o_orderkey"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), F.concat(F.lit("ORDERS/"), "r_name", F.lit("/"), "n_name"), F.array(F.lower("o_orderpriority"), F.concat(F.lit("status "), F.lower("o_orderstatus"))), F.concat_ws("/", F.lit("ORDERS"), "r_name", "c_mktsegment")))
    return customers.unionByName(suppliers).unionByName(parts).unionByName(orders)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    to_customer = t("orders").select(name("order", "o_orderkey").alias("source"), name("customer", "o_custkey").alias("target"), F.lit("invokes").alias("kind"))
    to_part = t("lineitem").select("l_orderkey", "l_partkey").distinct().select(name("order", "l_orderkey").alias("source"), name("part", "l_partkey").alias("target"), F.lit("imports").alias("kind"))
    to_supplier = t("lineitem").select("l_partkey", "l_suppkey").distinct().select(name("part", "l_partkey").alias("source"), name("supplier", "l_suppkey").alias("target"), F.lit("composes").alias("kind"))
    return to_customer.unionByName(to_part).unionByName(to_supplier)


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    return CodeGraph(entities(spark, sf_dir), edges(spark, sf_dir))


#: The same graph in SQL.
GRAPH_SQL = """
WITH RECURSIVE pl AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT * FROM customer JOIN pl ON c_nationkey = n_nationkey),
raw AS (
  SELECT 'customer' AS t, c_custkey AS k, 'class' AS kind, c_name AS name, r_name || '/' || n_name AS file, [lower(c_mktsegment), 'place order'] AS semantic_features, r_name || '/' || n_name || '/' || c_mktsegment AS hierarchy_path FROM c
  UNION ALL SELECT 'supplier', s_suppkey, 'service', s_name, r_name || '/' || n_name, ['supply parts'], r_name || '/' || n_name || '/SUPPLIER' FROM supplier JOIN pl ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part', p_partkey, 'model', p_name, 'PARTS/' || p_brand, [lower(p_name), lower(p_type), lower(p_brand)], 'PARTS/' || p_brand || '/' || p_type FROM part
  UNION ALL SELECT 'order', o_orderkey, 'function', 'Order#' || o_orderkey, 'ORDERS/' || r_name || '/' || n_name, [lower(o_orderpriority), 'status ' || lower(o_orderstatus)], 'ORDERS/' || r_name || '/' || c_mktsegment FROM orders JOIN c ON o_custkey = c_custkey
),
entities AS (SELECT t || ':' || k AS id, kind, name, file, CAST(k % 1000 + 1 AS INT) AS line_start, CAST(k % 1000 + 1 + k % 50 AS INT) AS line_end, semantic_features, hierarchy_path FROM raw),
edges AS (
  SELECT 'order:' || o_orderkey AS source, 'customer:' || o_custkey AS target, 'invokes' AS kind FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'imports' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'composes' FROM lineitem
)
"""
