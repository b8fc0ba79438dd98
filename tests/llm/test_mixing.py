"""op3 against brute force: exponent, weights, quotas, epochs and the order inside a source."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.llm import op3_mixing as op3

SOURCES = {"hot": 400, "a": 60, "b": 25, "c": 8, None: 5}


def table(spark):
    rows = [(1000 * j + k, s, "w " * ((7 * k + j) % 9 + 1)) for j, (s, n) in enumerate(SOURCES.items()) for k in range(n)]
    rows += [rows[0], rows[0], (9999, "empty", ""), (9998, "empty", None)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string"), rows


def measures(tokens, alpha):
    total = sum(tokens.values())
    power = {s: (n / total) ** alpha for s, n in tokens.items()}
    w = {s: p / sum(power.values()) for s, p in power.items()}
    budget = max(tokens[s] / w[s] for s in tokens)  # the smallest that shows all
    return w, budget, -sum(x * math.log(x) for x in w.values()), max(budget * w[s] / tokens[s] for s in tokens)


@pytest.mark.parametrize("entropy,epochs", [(0.8, None), (None, 1.7), (0.9, 1.5), (0.6, 50.0)])
def test_exponent_weights_and_quotas_equal_brute_force(spark, entropy, epochs):
    df, rows = table(spark)
    tokens = defaultdict(int)
    for _, s, t in rows:
        tokens[s] += len((t or "").split())
    del tokens["empty"]
    alphas = np.linspace(0, 1, 20_001)
    found = [measures(tokens, a) for a in alphas]
    want = max((a for a, m in zip(alphas, found, strict=True) if m[2] >= entropy * math.log(len(tokens))), default=0.0) if entropy else 0.0
    if epochs:
        want = max(want, min(a for a, m in zip(alphas, found, strict=True) if m[3] <= epochs + 1e-12))
    out, mix = op3.mix_sources(df, entropy, epochs)
    assert abs(mix.alpha - want) < 1e-4
    w, budget, h, most = measures(tokens, mix.alpha)
    assert np.isclose(mix.budget, budget) and np.isclose(mix.entropy, h) and np.isclose(mix.epochs, most)
    for r in out.groupBy("source").agg(F.first("mix_weight").alias("w"), F.first("mix_quota").alias("q")).collect():
        assert np.isclose(r.w, w.get(r.source, 0.0)) and np.isclose(r.q, w.get(r.source, 0.0) * budget)


def test_order_equals_brute_force(spark):
    """Blocks in the order of their hashes, documents in a block in that of theirs, whole epochs and then the front of one more."""
    df, rows = table(spark)
    seed = op3.SEED
    out, mix = op3.mix_sources(df, 0.9, 1.5)
    got = [(r.source, r.mix_epoch, r.doc_id, r.mix_start) for r in out.collect()]
    keys = {(e, r.doc_id, r.source): (r.block_hash, r.block, r.inside) for e in (0, 1) for r in df.distinct().select("doc_id", "source", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(op3.BLOCKS)).cast("int").alias("block"), op3.source_key(df).alias("key")).withColumn("block_hash", F.xxhash64(F.lit(seed), F.lit(e), "key", "block")).withColumn("inside", F.xxhash64(F.lit(seed), F.lit(e), "doc_id")).collect()}
    want = []
    for s in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == s]
        total = sum(len((r[2] or "").split()) for r in mine)
        quota = next((r.mix_quota for r in out.where(F.col("source").eqNullSafe(F.lit(s))).limit(1).collect()), 0)
        for e in range(max(1, math.ceil(quota / total - 1e-9)) if total else 1):
            at = e * total
            for i, _, t in sorted(mine, key=lambda r: (*keys[e, r[0], s], r[0], len((r[2] or "").split()))):
                if not total or e < math.floor(quota / total + 1e-9) or at < quota:
                    want.append((s, e, i, at))
                at += len((t or "").split())
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_ties_of_equal_ids_and_texts(spark):
    df = spark.createDataFrame([(1, "s", "one two")] * 50 + [(2, "t", "x")], "doc_id long, source string, text string")
    out, _ = op3.mix_sources(df, None, 1.0)
    starts = sorted(r.mix_start for r in out.where("source = 's'").collect())
    assert starts == [2 * k for k in range(50)]
