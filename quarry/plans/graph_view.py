"""The graph model projected onto the driver's tables: parts are entities, orders are sources, lineitems are edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Graph:
    """A table per node type and edge type; no edge table is ever deduplicated implicitly."""

    entity: DataFrame
    source: DataFrame
    supports: DataFrame
    links: DataFrame
    alias_of: DataFrame
    belongs_to: DataFrame | None = None
    pending: DataFrame | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slug(key) -> F.Column:
    return F.concat(F.lit("part-"), key.cast("string"))


def graph_view(spark: SparkSession, sf_dir: str) -> Graph:
    part, lineitem = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    k = F.col("p_partkey")
    alias = k % 17 == 16
    size = F.col("p_size") % 10
    entity = part.select(
        slug(k).alias("slug"),
        F.col("p_name").alias("title"),
        F.when(alias, "alias").when(size == 0, "summary").when(size <= 3, "article").otherwise("concept").alias("page_type"),
        F.when(alias, "alias").when(k % 13 == 0, "deprecated").otherwise("active").alias("status"),
        F.when(alias, slug(k - 1)).alias("canonical_id"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("run-"), (k % 3).cast("string"))).alias("first_run_id"),
        F.concat(F.lit("run-"), (k % 5).cast("string")).alias("last_run_id"),
    )
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    source = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("source_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "").otherwise(F.col("c_mktsegment"))).alias("domain"),
        F.col("o_orderstatus").alias("source_type"),
    )
    supports = lineitem.where("l_quantity <= 2").select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("source_id"), slug(F.col("l_partkey")).alias("slug")).distinct()
    n = part.agg(F.count("*").alias("n"))
    links = lineitem.where("l_quantity <= 1").crossJoin(F.broadcast(n)).select(slug(F.col("l_partkey")).alias("src"), slug((F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.col("n")).alias("dst")).distinct()
    alias_of = entity.where("canonical_id IS NOT NULL").select(F.col("slug").alias("alias_slug"), F.col("canonical_id").alias("canonical_slug"))
    return Graph(entity, source, supports, links, alias_of)


#: The same tables as DuckDB common table expressions.
PRELUDE = """
entity AS (
  SELECT 'part-' || p_partkey AS slug, p_name AS title,
    CASE WHEN p_partkey % 17 = 16 THEN 'alias' WHEN p_size % 10 = 0 THEN 'summary' WHEN p_size % 10 <= 3 THEN 'article' ELSE 'concept' END AS page_type,
    CASE WHEN p_partkey % 17 = 16 THEN 'alias' WHEN p_partkey % 13 = 0 THEN 'deprecated' ELSE 'active' END AS status,
    CASE WHEN p_partkey % 17 = 16 THEN 'part-' || (p_partkey - 1) END AS canonical_id,
    CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'run-' || (p_partkey % 3) END AS first_run_id,
    'run-' || (p_partkey % 5) AS last_run_id FROM part
), source AS (
  SELECT 'order-' || o_orderkey AS source_id,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE c_mktsegment END AS domain, o_orderstatus AS source_type
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
), supports AS (
  SELECT DISTINCT 'order-' || l_orderkey AS source_id, 'part-' || l_partkey AS slug FROM lineitem WHERE l_quantity <= 2
), links AS (
  SELECT DISTINCT 'part-' || l_partkey AS src, 'part-' || ((l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part)) AS dst FROM lineitem WHERE l_quantity <= 1
), alias_of AS (
  SELECT slug AS alias_slug, canonical_id AS canonical_slug FROM entity WHERE canonical_id IS NOT NULL
), active AS (
  SELECT slug, page_type FROM entity WHERE status = 'active' AND canonical_id IS NULL
), belongs AS (
  SELECT u.slug, s.domain, CAST(count(DISTINCT u.source_id) AS BIGINT) AS support_count
  FROM supports u JOIN source s USING (source_id) JOIN entity e USING (slug)
  WHERE e.canonical_id IS NULL AND s.domain <> '' GROUP BY u.slug, s.domain
)
"""
