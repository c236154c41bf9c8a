"""Queries on numbered files."""

from pyspark.sql import functions as F

from textloom.operators import checkpoints
from textloom.plans.registry import query, table

@query("SELECT o_orderpriority, 'model_' || max(o_orderkey) || '.pt' AS path, max(o_orderkey) AS step FROM orders GROUP BY o_orderpriority")
def latest_numbered(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderpriority", F.concat(F.lit("model_"), "o_orderkey", F.lit(".pt")).alias("p"))
    return checkpoints.latest(own, "p", "o_orderpriority")
