"""Queries on validated exports, evidence of older versions, and resampling by clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import navigate as N
from ..operators import runs as R
from ..operators import schemas as V
from ..sources import files as S
from ..storage import shared_folder
from .base import PAGES, load
from .navigation import _tree

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("legacy_evidence", "SELECT l_orderkey, 'd' || l_partkey AS doc_id, l_linenumber AS page, CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag END AS snippet FROM lineitem")
def _(spark, d):
    """Evidence of orders whose even lines were written as pairs and whose odd ones as objects."""
    doc, page = F.concat(F.lit('"d'), "l_partkey", F.lit('"')), F.col("l_linenumber").cast("string")
    piece = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("["), doc, F.lit(","), page, F.lit("]"))).otherwise(F.concat(F.lit('{"doc_id":'), doc, F.lit(',"page":'), page, F.lit(',"snippet":"'), "l_returnflag", F.lit('"}')))
    lists = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(piece), ","), F.lit("]")).alias("j"))
    return lists.select("l_orderkey", F.explode(R.evidence_pages(F.try_parse_json("j"))).alias("e")).select("l_orderkey", "e.*")


#: A run's row as these queries make it of an order.
ORDER_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["qid", "failure"],
    "properties": {
        "qid": {"type": "integer"}, "regime": {"enum": ["1", "2", "3"]}, "recall": {"type": ["number", "null"], "minimum": 0, "maximum": 1}, "failure": {"enum": [None, "error"]},
        "evidence": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["page"], "properties": {"page": {"type": "integer", "maximum": 5}}}},
    },
}


@query(
    "schema_violations",
    "WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, substr(o_orderpriority, 1, 1) AS regime, o_totalprice / 200000 AS recall, (SELECT max(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS last FROM orders) "
    "SELECT o_orderkey, '$.regime enum' AS rule FROM o WHERE regime > '3' UNION ALL SELECT o_orderkey, '$.recall maximum' FROM o WHERE recall > 1 UNION ALL SELECT o_orderkey, '$ required failure' FROM o WHERE o_orderstatus = 'P' "
    "UNION ALL SELECT o_orderkey, '$ additionalProperties' FROM o WHERE o_custkey % 10 = 0 UNION ALL SELECT o_orderkey, '$.evidence minItems' FROM o WHERE last IS NULL UNION ALL SELECT o_orderkey, '$.evidence[].page maximum' FROM o WHERE last > 5",
)
def _(spark, d):
    lines = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("page"))).alias("evidence"))
    # the lists are many times the columns that Spark judges them by, so they may not be broadcast
    o = load(spark, d, "orders").join(lines.hint("merge"), "o_orderkey", "left")
    none = F.array().cast("array<struct<page: int>>")
    body = F.to_json(F.struct(F.col("o_orderkey").alias("qid"), F.substring("o_orderpriority", 1, 1).alias("regime"), (F.col("o_totalprice") / 200000).alias("recall"), F.coalesce("evidence", none).alias("evidence"), F.when(F.col("o_custkey") % 10 == 0, F.lit(1)).alias("extra")))
    # a null that a schema allows has to be written out
    whole = F.when(F.col("o_orderstatus") == "P", body).otherwise(F.concat(F.expr("left(b, length(b) - 1)"), F.lit(',"failure":null}')))
    return V.violations(o.withColumn("b", body).withColumn("document", whole), ORDER_SCHEMA, "o_orderkey")


@query(
    "export_index",
    "WITH s AS (SELECT substr(o_orderpriority, 1, 1) AS dataset, o_orderkey, (row_number() OVER (PARTITION BY substr(o_orderpriority, 1, 1) ORDER BY o_orderkey) - 1) // 1000 AS shard FROM orders) SELECT dataset, CAST(shard AS INTEGER) AS shard, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM s GROUP BY 1, 2",
)
def _(spark, d):
    """Shards written, their index read back."""
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.substring("o_orderpriority", 1, 1).alias("dataset"), "o_orderstatus")
    path = shared_folder(spark, "export")
    S.export_explorer(rows, path, 1000)
    index = spark.read.schema("dataset string, shard int, n long, qids array<long>").json(f"{path}/index")
    return index.select("dataset", "shard", "n", F.get("qids", F.lit(0)).alias("first"), F.element_at("qids", -1).alias("last"))


@query("export_trees", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST((max(page) + 3) // 4 AS BIGINT) AS n_nodes, 'part 1' AS title FROM ({PAGES}) GROUP BY doc_id")
def _(spark, d):
    """Trees written, read back and flattened."""
    path = shared_folder(spark, "trees")
    _, tree = _tree(spark, d)
    S.export_trees(N.nested(tree.withColumn("summary", F.lit(None).cast("string"))).withColumn("doc_id", F.col("doc_id").cast("string")), path)
    nodes = N.flatten(spark.read.schema("doc_id string, tree string").json(path))
    return nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.min_by("title", "place").alias("title"))


@query("clustered_bootstrap")
def _(spark, d):
    """The mean line discount, its lines drawn by order."""
    return M.clustered_bootstrap(load(spark, d, "lineitem").withColumn("k", F.concat_ws(":", "l_orderkey", "l_linenumber")), "l_orderkey", "k", "l_discount", 100).select(F.round("mean", 6).alias("mean"), "n_clusters", "n_rows", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
