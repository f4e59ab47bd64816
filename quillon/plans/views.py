"""Canonical inputs as views over the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FEATURES = ["total_price", "qty_sum", "qty_mean", "discount_mean", "tax_mean", "price_sum", "price_sd", "n_lines", "flat"]
QC_METRICS = ["qadd_returns", "qgain_discount_sd", "qrev_tax_max", "qchan_price_ratio", "qdist_heavy"]

#: Landmarks of the face view.
POINTS = (0, 1, 8, 10, 13, 14, 17, 33, 61, 78, 133, 152, 243, 263, 291, 308, 362, 463)


def _landmark(i: int) -> str:
    gone = f"value IS NULL AND frame % 2 = {i % 2}"
    return (
        f'CASE WHEN {gone} THEN NULL ELSE {0.5 + i % 7 * 0.05:.2f}e0 + coalesce(value, 5e1) / 1e3 * {i % 3 - 1}e0 END AS "{i}_x", '
        f'CASE WHEN {gone} THEN NULL ELSE {0.4 + i % 5 * 0.06:.2f}e0 + coalesce(value, 5e1) / 8e2 * {i % 4 - 1}e0 END AS "{i}_y", {i % 2 * 0.01 + 0.001:.3f}e0 * frame AS "{i}_z"'
    )


FACE = f"""
        SELECT recording_id, frame, time_s, detected, {", ".join(map(_landmark, POINTS))} FROM frames"""

VIEWS = {
    "recordings": """
        SELECT o.o_orderkey AS record_key, o.o_custkey AS subject_id, o.o_orderpriority AS task,
          concat(CAST(year(o.o_orderdate) AS STRING), 'Q', CAST(quarter(o.o_orderdate) AS STRING)) AS session_id,
          CAST(o.o_orderdate AS DATE) AS recording_date, c.c_mktsegment AS diagnosis, o.o_orderstatus AS device, round(c.c_acctbal, 4) AS severity_score,
          CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE round(o.o_totalprice, 4) END AS total_price,
          CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE l.qty_sum END AS qty_sum, l.qty_mean,
          CASE WHEN o.o_orderkey % 5 < 3 THEN NULL ELSE l.discount_mean END AS discount_mean,
          l.tax_mean, l.price_sum, l.price_sd, CAST(l.n_lines AS DOUBLE) AS n_lines, 1e0 AS flat
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN (
          SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 4) AS qty_sum, round(avg(l_quantity), 4) AS qty_mean, round(sum(l_discount), 2) / count(*) AS discount_mean,
            round(sum(l_tax), 2) / count(*) AS tax_mean, round(sum(l_extendedprice), 2) AS price_sum, round(stddev_samp(l_extendedprice), 2) AS price_sd
          FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "qc": """
        SELECT l_orderkey AS record_key, round(avg(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END), 4) AS qadd_returns, round(stddev_samp(l_discount), 4) AS qgain_discount_sd,
          max(l_tax) AS qrev_tax_max, round(max(l_extendedprice) / min(l_extendedprice), 4) AS qchan_price_ratio, round(avg(CASE WHEN l_quantity > 45 THEN 1e0 ELSE 0e0 END), 4) AS qdist_heavy
        FROM lineitem GROUP BY l_orderkey""",
    "quality": """
        SELECT l_orderkey AS record_key, 3e-1 * round(sum(l_quantity), 2) / count(*) AS qadd_speech_pause_level_diff_db, round(sum(l_discount), 2) / count(*) AS qadd_pause_hum50_ratio, max(l_tax) AS qadd_pause_hum60_ratio,
          CASE WHEN l_orderkey % 9 = 4 THEN NULL ELSE (max(l_quantity) - min(l_quantity)) / 4 END AS qgain_speech_rms_db_std, min(l_quantity) / 2 AS qrev_post_offset_tail_db_above_floor,
          CASE WHEN l_orderkey % 4 = 0 THEN round(sum(l_tax), 2) / count(*) / 4 ELSE 0e0 END AS qdist_near_clipped_sample_fraction, (max(l_discount) - min(l_discount)) / 3 AS qtemp_waveform_continuity_break_score
        FROM lineitem GROUP BY l_orderkey""",
    "registry": """
        SELECT * FROM (VALUES ('total_price', 'articulatory', 1000e0, 400000e0), ('qty_sum', 'timing', 1e0, CAST(NULL AS DOUBLE)), ('qty_mean', 'timing', 5e0, 45e0), ('discount_mean', 'rhythm', CAST(NULL AS DOUBLE), 8e-2),
          ('price_sum', 'articulatory', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)), ('price_sd', 'phonatory', 0e0, 30000e0)) AS t(feature, family, expected_low, expected_high)""",
    "frames": """
        SELECT user_id AS recording_id, frame, round(frame * 4e-2 + (frame % 3) * 5e-3, 4) AS time_s, CASE WHEN frame % 11 = 5 OR frame % 37 IN (20, 21, 22) THEN NULL ELSE round(value, 4) END AS value, event_type, detected
        FROM (SELECT user_id, value, event_type, event_type <> 'error' AS detected, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame FROM events) e""",
    "samples": """
        SELECT recording_id, frame AS pos, CASE WHEN frame BETWEEN 30 AND 36 THEN 0e0 WHEN frame BETWEEN 40 AND 44 THEN 1e0 ELSE greatest(-1e0, least(1e0, (coalesce(value, 0e0) - 50) / 60)) END AS x, detected FROM frames""",
    "face": FACE,
    "metadata": """
        SELECT c.c_custkey AS subject_id, n.n_name AS site, r.r_name AS region_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE c.c_custkey % 10 <> 0""",
}


def _needs(sql: str) -> list[str]:
    """Views that a statement names, those that they are made of first."""
    found = {v for v in VIEWS if re.search(rf"\b{v}\b", sql)}
    for v in [*found]:
        found |= {u for u in VIEWS if u != v and re.search(rf"(FROM|JOIN) {u}\b", VIEWS[v])}
    return [v for v in VIEWS if v in found]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a table as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace('"', "`")
    used = [t for t in (*TABLES, *VIEWS) if re.search(rf"(FROM|JOIN) {t}\b", sql)]
    return spark.sql(re.sub(r"(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 {\2}", sql) if used else sql, **{t: view(spark, sf_dir, t) for t in used})


def oracle(sql: str) -> str:
    """A query over views as one DuckDB statement: the views it names come as common table expressions in front."""
    made = re.findall(r"\b(\w+)(?: ?\([\w, ]*\))? AS (?:MATERIALIZED )?\(\s*(?:SELECT|WITH|VALUES)\b", sql)
    if repeated := {n for n in made if made.count(n) > 1}:
        raise ValueError(f"named twice: {sorted(repeated)}")
    names = _needs(sql)
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in names)
    body = sql.strip()
    if not head:
        return body
    if re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {head},\n" + re.sub(r"^WITH\s+RECURSIVE\s+", "", body, flags=re.I)
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {head},\n" + re.sub(r"^WITH\s+", "", body, flags=re.I)
    return f"WITH {head}\n{body}"
