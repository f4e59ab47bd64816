"""User functions: per recording, per feature, and thresholds as a table."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.audit import qc_threshold_warnings, rules_table

RESULT = "feature string, value double, status string, note string"


def apply_feature_plugin(df: DataFrame, key: str, features: list[str], compute: Callable[[pd.DataFrame], dict[str, float | None]]) -> DataFrame:
    """(key, feature, value, status, note): compute(rows of one recording) -> values; one that raises marks its features failed, others go on.

    A recording's rows meet in one task, so a recording has to fit there.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            got, note = compute(rows), ""
        except Exception as e:  # noqa: BLE001  a plug-in's failure is a result
            got, note = None, f"{type(e).__name__}: {e}"
        values = [None if got is None else got.get(f) for f in features]
        status = ["failed" if got is None else "computed" if v is not None else "missing" for v in values]
        return pd.DataFrame({key: rows[key].iloc[0], "feature": features, "value": pd.array(values, dtype="Float64"), "status": status, "note": note})

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, {RESULT}")


def register_statistic(reduce: Callable[[pd.Series], float]) -> Callable[[str], Column]:
    """A column function that reduces a group's values with a Python function."""

    @F.pandas_udf("double")
    def statistic(values: pd.Series) -> float:
        return reduce(values.dropna())

    return statistic


def apply_rules(qc_long: DataFrame, rules: list[tuple[str, str, str, float, str]]) -> DataFrame:
    """Warnings of a user's rules: (family, feature, 'high' or 'low', threshold, warning)."""
    return qc_threshold_warnings(qc_long, rules_table(qc_long, tuple(rules)))
