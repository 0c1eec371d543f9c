"""The class prior of the quality classifier covers all rows outside the held-out fold."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm.common import fold


def test_binned_prior():
    r = np.random.default_rng(3)
    good, bad = r.normal(2, 1, 4000), r.normal(-2, 1, 30_000)
    for share in (0.2, 0.7):
        u = np.concatenate([r.normal(2, 1, int(20_000 * share)), bad[: int(20_000 * (1 - share))]])
        counts = np.bincount(quality.bins(u), minlength=quality.BINS)
        assert abs(quality.binned_prior(good, counts) - share) < 0.05
    assert quality.binned_prior(good, np.zeros(quality.BINS, np.int64)) == 0.5


def test_prior_counts_all_rows(spark, monkeypatch):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("Words of text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality")).limit(40)
    totals = []
    real = quality.binned_prior
    monkeypatch.setattr(quality, "binned_prior", lambda p, counts: totals.append(int(counts.sum())) or real(p, counts))
    quality.fit(docs, labels, most=50)
    assert totals == [docs.where(fold("doc_id", 5) != 0).count()]
