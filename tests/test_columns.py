"""Tasks and names of files."""

import random

from pyspark.sql import functions as F

from quillon.operators import columns


def plain_task(text):
    if text is None:
        return None
    tokens = [t for t in "".join(c if c.isascii() and c.isalnum() else "_" for c in text).upper().split("_") if t]
    own = [columns.TASK_ALIASES[t] for t in tokens if t in columns.TASK_ALIASES]
    return own[0] if own else next((task for alias, task in columns.TASK_ALIASES.items() if alias in "".join(tokens)), None)


def test_tasks_equal_a_plain_reading_of_tokens(spark):
    rng = random.Random(5)
    parts = [*columns.TASK_ALIASES, "x", "s1", "pa", "Ta", "2", "", "my", "vowel", "A", "é", "\n"]
    texts = [None, "", "_", "VOWEL_A", "a.READING-x", *("".join(rng.choice(parts) + rng.choice(["", "_", "-", " ", ".", "__"]) for _ in range(rng.randint(1, 4))) for _ in range(3000))]
    got = {r.t: r.task for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", columns.task_of(F.col("t")).alias("task")).collect()}
    assert got == {t: plain_task(t) for t in texts}


def test_tasks_read_a_text_by_a_few_expressions_whatever_the_aliases(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(columns.task_of(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") <= 8 and "lambda" not in plan  # the alias of the column repeats its four
