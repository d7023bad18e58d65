"""Error bounds of the mergeable sketches against the exact forms."""

import math

import pytest
from pyspark.sql import functions as F

from relaylens.operators import sketches
from relaylens.params import INFLOW


def ledger(spark, parties, days):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.xxhash64("id"), F.lit(days)).cast("int"))
    rows = spark.range(parties * 3).select((F.col("id") % max(1, parties)).alias("party_id"), day.alias("day"))
    return rows.withColumn("direction", F.lit(INFLOW))


@pytest.mark.parametrize("parties", [0, 1, 1500, 60_000])
def test_payers_within_the_stated_error(spark, parties):
    got = sketches.payers_of(sketches.payers_by_day(ledger(spark, parties, 20))).first()[0] or 0
    error = 0 if parties <= 2**(sketches.LG_K - 3) else 3 * 1.04 / math.sqrt(2**sketches.LG_K) * parties
    assert abs(got - parties) <= error


def test_days_merge_to_months(spark):
    """A month's sketch is made of its days' alone; each within the error."""
    rows = ledger(spark, 5000, 60)
    got = {r.month: r.payers for r in sketches.payers_of(sketches.payers_by_day(rows), F.trunc("day", "month").alias("month")).collect()}
    want = rows.groupBy(F.trunc("day", "month").alias("month")).agg(F.count_distinct("party_id").alias("n")).collect()
    assert len(want) == 2
    for r in want:
        assert abs(got[r.month] - r.n) <= 3 * 1.04 / math.sqrt(2**sketches.LG_K) * r.n


@pytest.mark.parametrize("k, n", [(200, 50_000), (4096, 50_000), (4096, 3000)])
def test_quantiles_within_the_stated_rank_error(spark, k, n):
    rows = spark.range(n).select(
        (F.col("id") % 30).alias("day"), (F.abs(F.xxhash64("id")) % 259_200).alias("secs"), F.lit(1).alias("step_index"), F.lit("s").alias("step"), F.lit("m").alias("measure")
    )
    by_day = rows.groupBy("day", "step_index", "step", "measure").agg(F.kll_sketch_agg_bigint("secs", F.lit(k)).alias("secs_sketch"), F.count(F.lit(1)).alias("n"))
    probs = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)
    got = sketches.time_to_convert_of(by_day, probs).first()
    values = sorted(r.secs for r in rows.select("secs").collect())
    bound = 0 if n <= k else 2.3 / k**0.9
    assert got.n == n
    for p, v in zip(probs, got[4:]):
        below = sum(x < v for x in values) / n
        upto = sum(x <= v for x in values) / n
        assert below - bound - 1 / n <= p <= upto + bound + 1 / n, (p, v)
