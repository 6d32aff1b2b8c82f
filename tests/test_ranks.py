import random

import pytest
from pyspark.sql import functions as F

from wavemill.operators.ranks import row_numbers
from wavemill.operators.relational import rank_signatures


@pytest.mark.parametrize("rows", [10, 333, 10_000])
def test_numbers_run_over_all_ranges(spark, rows):
    rng = random.Random(1)
    data = [(rng.choice([None, 1, 2, 3]), i) for i in range(2000)]
    got = row_numbers(spark.createDataFrame(data, "a int, b int").repartition(7), [F.desc("a"), F.col("b")], "n", rows).collect()
    want = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == want and sorted(r.n for r in got) == list(range(1, 2001))


def test_no_window_without_a_key(spark):
    signed = spark.createDataFrame([(f"f{i}", f"s{i % 300}", 3) for i in range(1000)], "path string, unordered_signature string, n_names int")
    ranked = rank_signatures(signed, "path", rows=50)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" in plan and "Window [row_number()" in plan and "[__range" in plan.split("row_number()")[-1]
    got = {r.signature_id: (r.unordered_signature, r.n_files) for r in ranked.collect()}
    want = sorted({f"s{i}": 4 if i < 100 else 3 for i in range(300)}.items(), key=lambda x: (-x[1], x[0]))
    assert got == {f"SIG-{i:03d}": x for i, x in enumerate(want, 1)}
    assert row_numbers(signed.where("false"), [F.col("path")], "n").count() == 0
