"""Mixing sources to target weights: temperature mixing, realised as block permutations under a token budget.

A source's weight is its token share to the power alpha, normalised. alpha lies in [0, 1]: 1 keeps the
shares, 0 makes all sources equal. It is found by bisection on aggregates of the source table, which stays a DataFrame; each job tries
GRID exponents at once, so a few jobs do.

A source's quota is its weight times the budget. Its documents lie in blocks by a hash of the doc_id (of the text where that is null), as many that the largest source has about
BLOCK_DOCS documents a block; each epoch has its own order of blocks, and of documents in a block. What starts within the quota is emitted: whole epochs, then the front of one more.
Only sums of blocks are put in order across a source, so a source with a third of all rows is
spread over its blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read, skew_join, text_of

BLOCKS, BLOCK_DOCS, GRID, JOBS = 1024, 10_000, 32, 5
#: Up to so many sources the table of quotas (some 60 bytes each) is broadcast; beyond, that of the frequent ones.
MAX_BROADCAST = 50_000
ENTROPY_SHARE, MAX_EPOCHS, SEED = 0.97, 2.0, 17


@dataclass(frozen=True)
class Mix:
    alpha: float
    budget: float
    entropy: float  # of the weights, in nats
    epochs: float  # most often that a source is passed


def source_key(docs: DataFrame) -> Column:
    """The source as text, null as a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit("n"))


def words(docs: DataFrame) -> Column:
    """Tokens of a text: runs of characters that aren't blank."""
    return F.regexp_count(text_of(docs), F.lit(r"\S+")).cast("long")


def _measures(sources: DataFrame, total: int, alphas: list[float], budget: float | None) -> list[tuple[float, float, float]]:
    """(entropy, budget, most epochs) for each exponent, in one job."""
    p = F.col("tokens") / F.lit(float(total))
    aggs = []
    for k, a in enumerate(alphas):
        aggs += [F.sum(F.pow(p, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{k}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"m{k}"), F.min(F.pow(p, F.lit(a - 1))).alias(f"n{k}")]
    r = sources.agg(*aggs).first()
    out = []
    for k, a in enumerate(alphas):
        z = r[f"z{k}"]
        b = total * z / r[f"n{k}"] if budget is None else budget
        from math import log

        out.append((log(z) - a * r[f"l{k}"] / z, b, b / (total * z) * r[f"m{k}"]))
    return out


def find_exponent(sources: DataFrame, total: int, n: int, entropy_share: float | None, max_epochs: float | None, budget: float | None) -> Mix:
    """The least flattening that meets the entropy target, as far as the repetition limit allows; without a target, as much as the limit allows.

    Entropy and repetition fall as alpha rises. The target is entropy_share of the highest entropy, log(n)."""
    from math import log

    def bisect(holds) -> float:
        """The largest alpha (of GRID**JOBS steps) at which holds is true of the entropy or, turned round, the smallest."""
        lo, hi = 0.0, 1.0
        for _ in range(JOBS):
            grid = [lo + (hi - lo) * k / GRID for k in range(GRID + 1)]
            low = [holds(m) for m in _measures(sources, total, grid, budget)]
            k = max((i for i, x in enumerate(low) if x), default=0)
            lo, hi = grid[k], grid[min(k + 1, GRID)]
            if lo == hi:
                break
        return lo if holds.inner else hi

    alpha = 1.0 if max_epochs is None else 0.0
    if entropy_share is not None:
        def enough(m):
            return m[0] >= entropy_share * log(n) - 1e-12
        enough.inner = True
        alpha = bisect(enough)
    if max_epochs is not None:
        def too_often(m):
            return m[2] > max_epochs * (1 + 1e-12)
        too_often.inner = False
        if _measures(sources, total, [alpha], budget)[0][2] > max_epochs:
            alpha = max(alpha, bisect(too_often))
    entropy, b, epochs = _measures(sources, total, [alpha], budget)[0]
    return Mix(alpha, b, entropy, epochs)


def mix_sources(docs: DataFrame, entropy_share: float | None = ENTROPY_SHARE, max_epochs: float | None = MAX_EPOCHS, budget: float | None = None, seed: int = SEED, tokens: str | None = None) -> tuple[DataFrame, Mix]:
    """docs as they are to be shown, and the mix. A row is repeated for each epoch that shows it.

    tokens names a column that has each document's tokens; else the words of text are counted. Added columns: mix_tokens, mix_weight, mix_quota, mix_epoch (from 0), mix_block, mix_start (tokens of its source shown before
    it). Without a budget it is the smallest that shows every document at least once, so no document is lost; a smaller one leaves out
    what starts beyond the quota. Nulls in source make a source of their own; null texts have no tokens. A source without
    tokens has weight 0 and is shown once. Repeated rows are rows like others; ties in an order go by hashes, then doc_id, tokens and text. An
    empty table gives an empty table. Columns of the added names are replaced."""
    own = ("mix_tokens", "mix_weight", "mix_quota", "mix_epoch", "mix_block", "mix_start")
    named = [c for c in docs.columns if c not in own]
    n_blocks = max(BLOCKS, -(-docs.count() // BLOCK_DOCS))
    n_tokens = F.coalesce(docs[tokens].cast("long"), F.lit(0).cast("long")) if tokens else words(docs)
    each = F.xxhash64(F.lit(seed), docs["doc_id"], n_tokens, *([docs["text"]] if "text" in named else []))
    base = docs.select(F.struct(*(docs[c] for c in named)).alias("row"), source_key(docs).alias("key"), docs["doc_id"].alias("id"), each.alias("hash"), n_tokens.alias("mix_tokens"), F.pmod(F.when(docs["doc_id"].isNull(), each).otherwise(F.xxhash64(F.lit(seed), docs["doc_id"])), F.lit(n_blocks)).cast("int").alias("mix_block"))
    blocks = cut(base.groupBy("key", "mix_block").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("rows")))
    sources = cut(blocks.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")))
    head = sources.agg(F.sum("tokens").alias("t"), F.count_if(F.col("tokens") > 0).alias("n"), F.sum("rows").alias("rows"), F.count("*").alias("all")).first()
    total, n = head.t or 0, head.n
    mix = find_exponent(sources.where("tokens > 0"), total, n, entropy_share, max_epochs, budget) if total else Mix(1.0, 0.0, 0.0, 0.0)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(mix.alpha))).otherwise(0.0)
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(z)
    quota = weight * F.lit(mix.budget)
    full = F.when(F.col("tokens") > 0, F.floor(quota / F.col("tokens") + F.lit(1e-9))).otherwise(1).cast("int")
    passes = F.when(F.col("tokens") > 0, F.greatest(F.lit(1), F.ceil(quota / F.col("tokens") - F.lit(1e-9)))).otherwise(1).cast("int")
    plan = sources.select("key", F.col("tokens").alias("total"), "rows", weight.alias("mix_weight"), quota.alias("mix_quota"), full.alias("full"), passes.alias("passes"))
    epochs = F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("mix_epoch")
    order = Window.partitionBy("key", "mix_epoch").orderBy(F.xxhash64(F.lit(seed), "mix_epoch", "key", "mix_block"), "mix_block").rowsBetween(Window.unboundedPreceding, -1)

    def planned(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(plan), "key") if head["all"] <= MAX_BROADCAST else skew_join(df, plan, "key", "rows", head.rows or 0)

    places = planned(blocks.drop("rows")).select("key", "mix_block", "tokens", epochs).withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0).cast("long"))).drop("tokens")
    shown = planned(base).select("*", epochs).join(places, ["key", "mix_epoch", "mix_block"])
    inside = Window.partitionBy("key", "mix_epoch", "mix_block").orderBy(F.xxhash64(F.lit(seed), "mix_epoch", "id"), "id", "mix_tokens", "hash").rowsBetween(Window.unboundedPreceding, -1)
    within = F.col("before") + F.coalesce(F.sum("mix_tokens").over(inside), F.lit(0).cast("long"))
    out = shown.withColumn("within", within).withColumn("mix_start", F.col("mix_epoch") * F.col("total") + F.col("within"))
    stays = (F.col("mix_epoch") < F.col("full")) | (F.col("mix_start") < F.col("mix_quota"))
    return out.where(stays).select(*(F.col("row")[c].alias(c) for c in named), *own), mix


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    df, mix = mix_sources(docs.select("doc_id", "source", words(docs).alias("words")), tokens="words")  # texts needn't be shuffled
    return df.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_quota", "mix_epoch", "mix_block", "mix_start", F.lit(mix.alpha).alias("mix_alpha"))
