"""Queries that write the driver's tables in the forms the readers take, and read them back; user functions over recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.scalars import parse_rate
from quillon.functions.shared import shared_folder
from quillon.functions.stats import long_form
from quillon.operators import columns, plugins
from quillon.plans.audit_queries import LONG, _R, _unpivot, features_long, query
from quillon.plans.views import FEATURES
from quillon.sources import tables


def _folder(read) -> str:
    return shared_folder(read.spark)


@query("io1_read_table", "SELECT c_custkey AS custkey, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer")
def _(read):
    """Tab-separated text whose names have spaces around them, NaN for missing numbers."""
    path = f"{_folder(read)}/customers.tsv"
    balance = F.when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    read("customer").select(F.col("c_custkey").alias(" custkey "), F.col("c_name").alias("name  "), balance.alias(" balance")).write.option("header", True).option("sep", "\t").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_table(read.spark, path)


@query("io2_read_table_lenient", "SELECT p_partkey AS partkey, p_brand AS brand, p_size AS size, p_retailprice AS price FROM part")
def _(read):
    """Text with commas under a name that ends in .txt."""
    path = f"{_folder(read)}/parts.txt"
    read("part").selectExpr("p_partkey AS partkey", "p_brand AS brand", "p_size AS size", "p_retailprice AS price").write.option("header", True).csv(path)
    return tables.read_table(read.spark, path, txt_separator=",")


@query("io3_trim_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(read):
    return tables.trim_columns(read("orders").selectExpr("o_orderkey AS ` o_orderkey`", "o_orderstatus AS `o_orderstatus  `", "CAST(o_totalprice AS DOUBLE) AS `\to_totalprice `"))


@query("io4_read_ids_as_string", "SELECT lpad(c_custkey::VARCHAR, 8, '0') AS subject_id, c_nationkey::VARCHAR AS site, c_acctbal::DOUBLE AS balance FROM customer")
def _(read):
    """Identifiers with leading zeros keep them, while other columns are read as numbers."""
    path = f"{_folder(read)}/ids.csv"
    read("customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("subject_id"), F.col("c_nationkey").alias("site"), F.col("c_acctbal").cast("double").alias("balance")).write.option("header", True).csv(path)
    return tables.read_table(read.spark, path, text=("subject_id", "site"))


@query("io5_list_media", "SELECT o_orderstatus AS status, 1::BIGINT AS n_files, true AS has_size FROM orders GROUP BY o_orderstatus")
def _(read):
    """Files below a folder tree by suffix: one .csv file per status, and Parquet files beside them that aren't listed."""
    folder = _folder(read)
    orders = read("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    orders.repartition("status").write.partitionBy("status").csv(f"{folder}/media")
    orders.write.parquet(f"{folder}/media/status=other")
    found = tables.list_media(read.spark, f"{folder}/media", (".CSV", ".wav"))
    return found.groupBy(F.regexp_extract("path", "status=([^/]*)", 1).alias("status")).agg(F.count("*").alias("n_files"), (F.min("size") > 0).alias("has_size"))


@query("io7_write_table", "SELECT n_nationkey AS nationkey, n_name AS name, n_regionkey AS regionkey, 'parquet' AS kind FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'csv' FROM nation UNION ALL SELECT s_suppkey, s_name, s_nationkey, 'suppliers' FROM supplier")
def _(read):
    """Partitioned Parquet, CSV over an earlier table, and an empty table that keeps its header."""
    folder, nations = _folder(read), read("nation").selectExpr("CAST(n_nationkey AS BIGINT) AS nationkey", "n_name AS name", "CAST(n_regionkey AS BIGINT) AS regionkey")
    tables.write_table(nations, f"{folder}/nations.parquet", partition_by="regionkey")
    tables.write_table(read("region"), f"{folder}/nations.csv", csv=True)
    tables.write_table(nations, f"{folder}/nations.csv", csv=True)
    tables.write_table(nations.where("false"), f"{folder}/none.csv", csv=True)
    tables.write_table(read("supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS nationkey", "s_name AS name", "CAST(s_nationkey AS BIGINT) AS regionkey"), f"{folder}/suppliers.parquet", partition_by="regionkey")
    parts = {"parquet": "nations.parquet", "csv": "nations.csv", "empty": "none.csv", "suppliers": "suppliers.parquet"}
    out = None
    for kind, name in parts.items():
        rows = tables.read_table(read.spark, f"{folder}/{name}").selectExpr("CAST(nationkey AS BIGINT) AS nationkey", "name", "CAST(regionkey AS BIGINT) AS regionkey", f"'{kind}' AS kind")
        out = rows if out is None else out.unionByName(rows)
    return out


HANDOFF = f"""{LONG}, v AS (SELECT record_key, feature, value FROM lf)"""


@query("io8_feature_handoff", f"WITH {HANDOFF} SELECT 'value' AS kind, v.feature, g.family, count(*) AS n_rows, count(value) AS n_valid FROM v JOIN registry g ON g.feature = v.feature GROUP BY v.feature, g.family UNION ALL SELECT 'registry', feature, family, 1, 1 FROM registry UNION ALL SELECT 'status', v.feature, CASE WHEN count(value) = count(*) THEN 'computed' ELSE 'partial' END, count(*), count(value) FROM v JOIN registry g ON g.feature = v.feature GROUP BY v.feature")
def _(read):
    """Values, registry and status of a modality written with a manifest, replaced once, and read back through it."""
    folder, registry = _folder(read), read("registry")
    long = features_long(read, True).join(F.broadcast(registry.select("feature")), "feature")  # one row per feature
    status = long.groupBy("feature").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_valid")).withColumn("status", F.when(F.col("n_rows") == F.col("n_valid"), "computed").otherwise("partial"))
    given = registry.select(F.col("feature").alias("feature_name"), F.col("family").alias("subsystem"), F.col("expected_low").alias("lower_bound"), F.col("expected_high").alias("upper_bound"))
    tables.write_feature_handoff(long.where("false"), given.where("false"), status.where("false"), folder, "acoustic")
    tables.write_feature_handoff(long, given, status, folder, "acoustic")
    found = tables.read_feature_handoff(read.spark, folder)
    values = found["values"].join(found["registry"].select("feature", "family"), "feature").groupBy("feature", "family").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_valid"))
    one = F.lit(1).cast("bigint")
    return (
        values.select(F.lit("value").alias("kind"), "feature", "family", "n_rows", "n_valid")
        .unionByName(found["registry"].select(F.lit("registry").alias("kind"), "feature", "family", one.alias("n_rows"), one.alias("n_valid")))
        .unionByName(found["status"].select(F.lit("status").alias("kind"), "feature", F.col("status").alias("family"), "n_rows", "n_valid"))
    )


_ML = "task, count(*) AS n_rows, round(sum(qty_mean), 4) AS qty_mean"


@query("io9_ml_export_tables", f"SELECT 'ids_predictors' AS name, 3 AS n_columns, 'all' AS task, count(*) AS n_rows, round(sum(qty_mean), 4) AS qty_mean FROM recordings UNION ALL SELECT 'ids_context_predictors', 4, {_ML} FROM recordings GROUP BY task UNION ALL SELECT 'predictors', 2, 'all', count(*), round(sum(qty_mean), 4) FROM recordings", digits=4)
def _(read):
    """The three projections written by task, each read back: that with context one task at a time, of which only its folder is read."""
    folder, rows = _folder(read), read.once("recordings")
    tables.write_ml_tables(rows, ["record_key"], ["task"], ["qty_mean", "n_lines"], folder, partition_by="task")
    out = None
    for name in ("ids_predictors", "ids_context_predictors", "predictors"):
        back = read.spark.read.parquet(f"{folder}/{name}")
        task = F.col("task") if "task" in back.columns else F.lit("all")
        part = back.groupBy(task.alias("task")).agg(F.count("*").alias("n_rows"), F.sum("qty_mean").alias("qty_mean")).select(F.lit(name).alias("name"), F.lit(len(back.columns)).alias("n_columns"), "task", "n_rows", "qty_mean")
        out = part if out is None else out.unionByName(part)
    return out


@query("m04_normalize_registry", """SELECT 'part_' || p_partkey AS feature, p_brand AS family, NULL::VARCHAR AS unit, NULL::VARCHAR AS formula, p_name AS meaning, NULL::VARCHAR AS tier, CASE WHEN p_size > 25 THEN 'ready' END AS status, p_size::DOUBLE AS expected_low, CASE WHEN p_partkey % 3 > 0 THEN round(p_retailprice, 2)::DOUBLE END AS expected_high FROM part""")
def _(read):
    """A registry with other names for its columns, and bounds that are text, some of it no number."""
    given = read("part").select(F.concat(F.lit("part_"), "p_partkey").alias("name"), F.col("p_brand").alias("domain"), F.col("p_name").alias("definition"), F.when(F.col("p_size") > 25, "ready").alias("status"), F.col("p_size").cast("string").alias("min_expected"), F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.round("p_retailprice", 2).cast("string")).alias("upper_bound"))
    return tables.normalize_registry(given)


@query("m10_part_bounds", """SELECT p_partkey AS part, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE ELSE 1e0 END AS expected_low, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(p_retailprice, 2)::DOUBLE END AS expected_high FROM part""")
def _(read):
    """Bounds of each part by the first of their names that reads as a number."""
    rows = read("part").select(F.col("p_partkey").alias("part"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("unknown").alias("low"), F.lit("1").alias("min_expected"), F.lit("").alias("max"), F.when(F.col("p_partkey") % 5 != 0, F.round("p_retailprice", 2)).alias("upper_bound"))
    return columns.expected_bounds(rows, ["low", "min_expected"], ["max", "upper_bound"]).select("part", "expected_low", "expected_high")


@query("f04_first_available_pair", "SELECT record_key, round(price_sum / nullif(qty_sum, 0), 6) AS ratio FROM recordings")
def _(read):
    """The ratio of the first pair of columns that the table has."""
    rows = read("recordings")
    a, b = columns.first_available(rows.columns, [("price_total", "qty_total"), ("price_sum", "qty_count"), ("price_sum", "qty_sum"), ("total_price", "n_lines")])
    return rows.select("record_key", F.try_divide(a, b).alias("ratio"))


@query("f18_parse_rate", """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_linenumber = 4 THEN NULL ELSE l_quantity::INT / (l_linenumber - 4.0) END WHEN 1 THEN round(l_quantity::INT / (l_linenumber * 1.0), 6) WHEN 2 THEN l_quantity::INT + 0.5 END AS rate FROM lineitem""")
def _(read):
    """`a/b`, numbers and other text; a zero below is missing."""
    n, line = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    text = F.when(line % 4 == 0, F.concat_ws("/", n, line - 4)).when(line % 4 == 1, F.concat(F.lit(" "), n, F.lit(" / "), line)).when(line % 4 == 2, F.concat(n, F.lit(".5"))).otherwise("variable")
    return read("lineitem").select("l_orderkey", "l_linenumber", parse_rate(text).alias("rate"))


@query("u01_feature_plugin", f"""WITH r AS (SELECT recording_id, count(*) AS n, count(value) AS k, max(value) - min(value) AS span, avg(value) AS mean FROM frames GROUP BY recording_id), f AS ({_unpivot('r', 'recording_id, n', ['span', 'mean'])})
SELECT recording_id, feature, CASE WHEN recording_id % 7 = 3 THEN NULL ELSE round(value, 6) END AS value, CASE WHEN recording_id % 7 = 3 THEN 'failed' WHEN value IS NULL THEN 'missing' ELSE 'computed' END AS status, CASE WHEN recording_id % 7 = 3 THEN 'ValueError: recording ' || recording_id || ' is odd' ELSE '' END AS note FROM f
UNION ALL SELECT recording_id, 'none', NULL, CASE WHEN recording_id % 7 = 3 THEN 'failed' ELSE 'missing' END, CASE WHEN recording_id % 7 = 3 THEN 'ValueError: recording ' || recording_id || ' is odd' ELSE '' END FROM r""")
def _(read):
    """A user's function over each recording's rows: what it doesn't give is missing, and where it raises, that recording's features alone have failed."""

    def compute(rows):
        recording = int(rows["recording_id"].iloc[0])
        if recording % 7 == 3:
            raise ValueError(f"recording {recording} is odd")
        x = rows["value"].dropna()
        return {"span": float(x.max() - x.min()), "mean": float(x.mean())} if len(x) else {}

    return plugins.apply_feature_plugin(read("frames").select("recording_id", "value"), "recording_id", ["span", "mean", "none"], compute)


@query("u02_statistic", f"WITH {LONG} SELECT feature, round(max(value) - min(value), 6) AS spread, round(max(value), 6) AS top FROM lf GROUP BY feature")
def _(read):
    """A user's reducer beside a built-in one; partial results by a part of the rows keep it from taking a whole feature at once."""
    spread = plugins.register_statistic(lambda x: float(x.max()) if len(x) else None)
    low = plugins.register_statistic(lambda x: float(x.min()) if len(x) else None)
    parts = features_long(read).withColumn("part", F.pmod(F.xxhash64("record_key"), F.lit(64))).groupBy("feature", "part").agg(spread("value").alias("high"), low("value").alias("low"))
    return parts.groupBy("feature").agg((F.max("high") - F.min("low")).alias("spread"), F.max("high").alias("top"))


@query("u03_rules", f"WITH {LONG} SELECT record_key, 'size' AS family, feature, {_R('value')}, CASE feature WHEN 'qty_mean' THEN 40e0 ELSE 2e0 END AS threshold, CASE feature WHEN 'qty_mean' THEN 'high' ELSE 'low' END AS direction, CASE feature WHEN 'qty_mean' THEN 'large orders' ELSE 'short orders' END AS warning, CASE WHEN feature = 'qty_mean' AND value > 80 OR feature = 'n_lines' AND value < 1 THEN 'strong_review' ELSE 'review' END AS severity FROM lf WHERE feature = 'qty_mean' AND value > 40 OR feature = 'n_lines' AND value < 2")
def _(read):
    """A user's thresholds as a table."""
    return plugins.apply_rules(long_form(read("recordings"), "record_key", FEATURES), [("size", "qty_mean", "high", 40.0, "large orders"), ("size", "n_lines", "low", 2.0, "short orders")])
