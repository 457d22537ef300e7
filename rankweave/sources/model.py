"""Directory entities over the driver's tables: venues, providers, reviews and so on.

Every entity is a DataFrame built from the star schema; ``CTES`` states the same
in SQL, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" for every query that looks at ages.
AS_OF = "2001-11-05 00:00:00"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


#: What a review has from its line alone.
SCORED = [
    "l_partkey provider_id",
    "l_suppkey venue_id",
    "case when l_tax = 0 then null else cast(l_quantity * 2 as int) end score",
    "cast(1 + (l_partkey + l_linenumber) % 8 as int) type_id",
    "cast(1 + l_partkey % 5 as int) body_id",
    "cast(1 + l_suppkey % 3 as int) level_id",
    "cast(1 + l_orderkey % 5 as int) p1",
    "cast(1 + l_partkey % 5 as int) p2",
    "cast(1 + l_suppkey % 5 as int) p3",
    "case l_returnflag when 'N' then 'approved' when 'A' then 'pending' else 'rejected' end status",
    "l_shipdate created_at",
]


class Model:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def regions(self) -> DataFrame:
        joined = self.table("nation").join(F.broadcast(self.table("region")), F.expr("n_regionkey = r_regionkey"))
        return joined.selectExpr("cast(n_nationkey as bigint) region_id", "n_name name", "lower(n_name) slug", "r_name grp")

    def areas(self) -> DataFrame:
        segments = F.posexplode(F.array(*[F.lit(s) for s in SEGMENTS])).alias("k", "segment")
        return self.regions().select("region_id", F.col("name").alias("region_name"), segments).selectExpr(
            "region_id * 5 + k area_id", "region_id", "concat(region_name, ' ', segment) name", "concat(lower(region_name), '-', lower(segment)) slug"
        )

    def venues(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey venue_id", "s_name name", "cast(s_nationkey as bigint) region_id", "s_acctbal >= 0 is_active", "case when s_suppkey % 5 <> 4 then timestamp '2000-01-01' end published_at"
        )

    def published(self) -> DataFrame:
        return self.venues().where("is_active and published_at is not null")

    def venue_areas(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey")
        urgent = self.table("orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
        k = F.expr("array_position(array('%s'), c_mktsegment) - 1" % "','".join(SEGMENTS))
        placed = self.table("customer").select("c_custkey", (F.col("c_nationkey") * 5 + k).cast("bigint").alias("area_id"))
        counts = lines.join(urgent, F.expr("l_orderkey = o_orderkey")).join(placed, F.expr("o_custkey = c_custkey")).groupBy(F.col("l_suppkey").alias("venue_id"), "area_id").agg(F.count("*").alias("n"))
        return counts.selectExpr("venue_id", "area_id", "cast(row_number() over (partition by area_id order by n desc, venue_id) as bigint) display_order")

    def providers(self) -> DataFrame:
        lines = self.table("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
        home = lines.groupBy("l_partkey").agg(F.expr("max_by(l_suppkey, struct(n, -l_suppkey))").alias("venue_id"))
        return self.table("part").join(home, F.expr("p_partkey = l_partkey"), "left").selectExpr(
            "p_partkey provider_id", "p_name name", "venue_id", "case when p_size <= 45 then 'active' else 'retired' end status", "18 + p_size age", "p_size size", "p_brand brand"
        )

    def members(self) -> DataFrame:
        return self.table("customer").selectExpr("c_custkey member_id", "c_name nickname", "c_acctbal balance", "c_mktsegment segment")

    def reviews(self, lines: DataFrame | None = None) -> DataFrame:
        lines = self.table("lineitem") if lines is None else lines
        return lines.join(self.table("orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey")).selectExpr(
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) review_id",
            "case when o_custkey % 10 = 0 then null else o_custkey end member_id",
            "cast(1 + o_custkey % 5 as int) p4",
            *SCORED,
        )

    def approved(self) -> DataFrame:
        """Approved reviews; the filter reaches the scan."""
        return self.reviews(self.table("lineitem").where("l_returnflag = 'N'"))

    def approved_scores(self) -> DataFrame:
        """Approved reviews without what only their orders know: id, member and ``p4``."""
        return self.table("lineitem").where("l_returnflag = 'N'").selectExpr(*SCORED)


_REVIEW = """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey review_id,
 CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END member_id, l_partkey provider_id, l_suppkey venue_id,
 CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_quantity * 2 AS INT) END score,
 CAST(1 + (l_partkey + l_linenumber) % 8 AS INT) type_id, CAST(1 + l_partkey % 5 AS INT) body_id, CAST(1 + l_suppkey % 3 AS INT) level_id,
 CAST(1 + l_orderkey % 5 AS INT) p1, CAST(1 + l_partkey % 5 AS INT) p2, CAST(1 + l_suppkey % 5 AS INT) p3, CAST(1 + o_custkey % 5 AS INT) p4,
 CASE l_returnflag WHEN 'N' THEN 'approved' WHEN 'A' THEN 'pending' ELSE 'rejected' END status, l_shipdate created_at
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

CTES = {
    "regions": "SELECT CAST(n_nationkey AS BIGINT) region_id, n_name AS name, lower(n_name) slug, r_name grp FROM nation JOIN region ON n_regionkey = r_regionkey",
    "areas": "SELECT region_id * 5 + k area_id, region_id, name || ' ' || segment AS name, lower(name) || '-' || lower(segment) slug FROM regions, (VALUES " + ", ".join(f"({k}, '{s}')" for k, s in enumerate(SEGMENTS)) + ") s(k, segment)",
    "venues": "SELECT s_suppkey venue_id, s_name AS name, CAST(s_nationkey AS BIGINT) region_id, s_acctbal >= 0 is_active, CASE WHEN s_suppkey % 5 <> 4 THEN TIMESTAMP '2000-01-01' END published_at FROM supplier",
    "published": "SELECT * FROM venues WHERE is_active AND published_at IS NOT NULL",
    "venue_areas": "SELECT venue_id, area_id, row_number() OVER (PARTITION BY area_id ORDER BY n DESC, venue_id) display_order FROM (SELECT l_suppkey venue_id, CAST(c_nationkey * 5 + list_position(["
    + ", ".join(f"'{s}'" for s in SEGMENTS)
    + "], c_mktsegment) - 1 AS BIGINT) area_id, count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)",
    "providers": "SELECT p_partkey provider_id, p_name AS name, venue_id, CASE WHEN p_size <= 45 THEN 'active' ELSE 'retired' END status, 18 + p_size age, p_size size, p_brand brand FROM part LEFT JOIN (SELECT l_partkey, l_suppkey venue_id FROM (SELECT l_partkey, l_suppkey, count(*) n FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) = 1) ON p_partkey = l_partkey",
    "members": "SELECT c_custkey member_id, c_name nickname, c_acctbal balance, c_mktsegment segment FROM customer",
    "reviews": _REVIEW,
    "approved": "SELECT * FROM reviews WHERE status = 'approved'",
}


def with_entities(body: str) -> str:
    """SQL with the entities in front; ``body`` may begin with further CTEs (``, name AS (...)``)."""
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items()) + "\n" + body
