"""Queries on the test tables by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import runtime
from tessera.operators import frontier
from tessera.plans import enumeration as plans
from tessera.sources.tables import table, views


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dmu_id (nation), x1 customers, x2 positive balances, y order value."""
    views(spark, sf_dir, "customer", "orders")
    return spark.sql(f"WITH {plans.UNITS} SELECT dmu_id, x1, x2, y FROM raw")


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "customer", "orders")
    return spark.sql(f"WITH {plans.INDICATORS} SELECT * FROM raw")


def dea_bcc_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frontier.dea_bcc(units(spark, sf_dir), "dmu_id", ["x1", "x2"], ["y"])
    return out.select("dmu_id", F.round("phi", 6).alias("phi"), F.round("eff", 6).alias("eff"), F.round("target_y", 4).alias("y_target"), "efficient")


def dea_bcc_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.dea_peers(units(spark, sf_dir), "dmu_id", ["x1", "x2"], ["y"])


def dea_bcc_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frontier.dea_scale(units(spark, sf_dir), "dmu_id", ["x1", "x2"], ["y"])
    return out.select("dmu_id", (F.round("vstar_min", 4) + 0.0).alias("vstar_min"), (F.round("vstar_max", 4) + 0.0).alias("vstar_max"), "rts")


def bod_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.bod(indicators(spark, sf_dir), "dmu_id", ["y1", "y2", "y3"]).select("dmu_id", F.round("ci", 6).alias("ci"))


def bod_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frontier.bod_weights(indicators(spark, sf_dir), "dmu_id", ["y1", "y2", "y3"])
    return out.select("dmu_id", "indicator", (F.round("w_min", 6) + 0.0).alias("w_min"), (F.round("w_max", 6) + 0.0).alias("w_max"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("dmu_id"), F.col("r_name").alias("region"))


def bod_score_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frontier.bod(indicators(spark, sf_dir).join(regions(spark, sf_dir), "dmu_id"), "dmu_id", ["y1", "y2", "y3"], by="region")
    return out.select("region", "dmu_id", F.round("ci", 6).alias("ci"))


#: As in the SQL's LIMITS.
BOUNDS = {"y1": (0.1, 0.5), "y2": (0.15, None)}
RATIOS = {("y2", "y3"): (0.5, 2.0)}


def bod_bounded_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.bod(indicators(spark, sf_dir), "dmu_id", ["y1", "y2", "y3"], bounds=BOUNDS, ratios=RATIOS).select("dmu_id", F.round("ci", 6).alias("ci"))


def bod_bounded_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frontier.bod_weights(indicators(spark, sf_dir), "dmu_id", ["y1", "y2", "y3"], bounds=BOUNDS, ratios=RATIOS)
    return out.select("dmu_id", "indicator", (F.round("w_min", 6) + 0.0).alias("w_min"), (F.round("w_max", 6) + 0.0).alias("w_max"))


def dea_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frontier.dea_bcc(units(spark, sf_dir).join(regions(spark, sf_dir), "dmu_id"), "dmu_id", ["x1", "x2"], ["y"], by="region")
    return out.select("region", "dmu_id", F.round("phi", 6).alias("phi"))


def dea_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets with a price of the output, which is taken as 1, for measures divided by their maxima."""
    raw = units(spark, sf_dir)
    tops = raw.agg(F.max("x1").alias("m1"), F.max("x2").alias("m2"), F.max("y").alias("my"))
    found = frontier.dea_facets(raw, "dmu_id", ["x1", "x2"], ["y"]).filter("u_y > 0").withColumn("one", F.lit(1)).join(F.broadcast(tops.withColumn("one", F.lit(1))), "one")
    unit = F.col("u_y") * F.col("my")
    return found.select((F.round(F.col("v_x1") * F.col("m1") / unit, 6) + 0.0).alias("v_x1"), (F.round(F.col("v_x2") * F.col("m2") / unit, 6) + 0.0).alias("v_x2"), (F.round(F.col("vstar") / unit, 6) + 0.0).alias("vstar"))


def dea_facet_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = units(spark, sf_dir)
    out = frontier.facet_scores(raw, frontier.dea_facets(raw, "dmu_id", ["x1", "x2"], ["y"]), "dmu_id", ["x1", "x2"], ["y"])
    return out.select("dmu_id", (F.round("vstar_min", 4) + 0.0).alias("vstar_min"), (F.round("vstar_max", 4) + 0.0).alias("vstar_max"), "rts")


def dea_facet_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = units(spark, sf_dir)
    return frontier.facet_peers(raw, frontier.dea_facets(raw, "dmu_id", ["x1", "x2"], ["y"]), "dmu_id", ["x1", "x2"], ["y"])


def dea_exact_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frontier.dea_exact(units(spark, sf_dir), "dmu_id", ["x1", "x2"], ["y"])
    return out.select("dmu_id", (F.round("vstar_min", 4) + 0.0).alias("vstar_min"), (F.round("vstar_max", 4) + 0.0).alias("vstar_max"), "rts")


def dea_exact_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.dea_exact(units(spark, sf_dir), "dmu_id", ["x1", "x2"], ["y"]).select("dmu_id", F.explode("peers").alias("peer_id"))


def dea_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frontier.dea_sensitivity(units(spark, sf_dir), "dmu_id", ["x1", "x2"], ["y"])
    return out.select("dmu_id", "dropped", F.round("eff", 6).alias("eff"), (F.round("delta", 6) + 0.0).alias("delta"))


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.concat(F.lit("/runs/user/"), F.col("user_id").cast("string")).alias("script"), "ts")
    return runtime.run_report(runs, root="/runs")


def path_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = runtime.script_path(F.regexp_replace("url", "^[a-z]+://[^/]*", ""))
    return table(spark, sf_dir, "pages").select("page_id", runtime.is_inside(path, "/en").alias("inside"), runtime.base_name(path).alias("name"))


QUERIES = {
    "dea_bcc_score": dea_bcc_score,
    "dea_bcc_peers": dea_bcc_peers,
    "dea_bcc_scale": dea_bcc_scale,
    "bod_score": bod_score,
    "bod_weights": bod_weights,
    "bod_score_by_region": bod_score_by_region,
    "bod_bounded_score": bod_bounded_score,
    "bod_bounded_weights": bod_bounded_weights,
    "dea_by_region": dea_by_region,
    "dea_facets": dea_facets,
    "dea_facet_scale": dea_facet_scale,
    "dea_facet_peers": dea_facet_peers,
    "dea_exact_scale": dea_exact_scale,
    "dea_exact_peers": dea_exact_peers,
    "dea_sensitivity": dea_sensitivity,
    "run_report": run_report,
    "path_containment": path_containment,
}

ORACLES = {
    "dea_bcc_score": plans.SCORE,
    "dea_bcc_peers": plans.PEERS,
    "dea_bcc_scale": plans.SCALE,
    "bod_score": plans.BOD,
    "bod_weights": plans.WEIGHTS,
    "bod_score_by_region": plans.BOD_BY,
    "bod_bounded_score": plans.BOUNDED,
    "bod_bounded_weights": plans.BOUNDED_WEIGHTS,
    "dea_by_region": plans.SCORE_BY,
    "dea_facets": plans.FACET_TABLE,
    "dea_facet_scale": plans.SCALE,
    "dea_facet_peers": plans.PEERS,
    "dea_exact_scale": plans.SCALE,
    "dea_exact_peers": plans.PEERS,
    "dea_sensitivity": plans.SENSITIVITY,
    "run_report": """
SELECT CAST(user_id AS VARCHAR) AS script, strftime(a, '%Y-%m-%d %H:%M:%S') AS started, strftime(b, '%Y-%m-%d %H:%M:%S') AS finished,
  CASE WHEN us >= 3600000000 THEN (CASE WHEN us // 3600000000 < 10 THEN '0' ELSE '' END) || CAST(us // 3600000000 AS VARCHAR) || ' h ' ELSE '' END
  || lpad(CAST(us % 3600000000 // 60000000 AS VARCHAR), 2, '0') || ' min ' || lpad(CAST(c // 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ' sec' AS total
FROM (SELECT *, (us % 60000000 + 5000) // 10000 AS c FROM (
  SELECT user_id, min(ts) AS a, max(ts) AS b, date_diff('microsecond', min(ts), max(ts)) AS us FROM events GROUP BY user_id) q) r""",
    "path_containment": """
SELECT page_id, coalesce(p = '/en' OR starts_with(p, '/en/'), false) AS inside, list_extract(string_split(p, '/'), -1) AS name
FROM (SELECT page_id, nullif(regexp_replace(url, '^[a-z]+://[^/]*', ''), '') AS p FROM pages) q""",
}
