"""Token prices: which model's list holds, and from when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICES_BROADCAST = 100_000  # price rows up to which every task holds the list


def _small(prices: DataFrame) -> DataFrame:
    return F.broadcast(prices) if prices.limit(PRICES_BROADCAST + 1).count() <= PRICES_BROADCAST else prices


def price_models(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, price_model) for the distinct models: the list's exact model, else its longest that is a prefix.

    Every prefix of a model is an equi-join key, so the list may have any size.
    """
    cuts = models.where(F.col("model") != "").select("model").distinct().select("model", F.explode(F.transform(F.sequence(F.lit(1), F.length("model")), lambda i: F.substring(F.col("model"), F.lit(1), i))).alias("price_model"))
    listed = prices.select(F.col("model").alias("price_model")).distinct()
    return cuts.join(listed, "price_model").groupBy("model").agg(F.max_by("price_model", F.length("price_model")).alias("price_model"))


def resolve_prices(rows: DataFrame, prices: DataFrame, at: Column) -> DataFrame:
    """``rows`` (with ``model``) and the price columns of the resolved model's latest list not after ``at``.

    The model is chosen first, then the date: a chosen model without a list by
    then has no price, and no shorter prefix stands in.
    """
    names = ["input_per_mtok", "output_per_mtok", "cache_read_per_mtok", "cache_write_per_mtok"]
    keyed = rows.withColumn("__at", F.to_date(at))
    # one pass over the rows for their distinct models and days; every prefix of a model is an equi-join key
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.length("model")), lambda i: F.substring(F.col("model"), F.lit(1), i)))
    wanted = keyed.where(F.col("model") != "").select("model", "__at").distinct().select("model", "__at", cuts.alias("price_model"))
    dated = prices.select(F.col("model").alias("price_model"), "effective_from", *names)
    there = F.coalesce(F.col("effective_from") <= F.col("__at"), F.lit(False))
    found = wanted.join(_small(dated), "price_model").groupBy("model", "__at").agg(F.max_by(F.struct("price_model", "effective_from", *names, there.alias("there")), F.struct(F.length("price_model"), there, "effective_from")).alias("__price"))
    best = found.where("__price.there")
    out = keyed.join(best, ["model", "__at"], "left")
    return out.select(*rows.columns, F.col("__price.price_model").alias("price_model"), F.col("__price.effective_from").alias("price_date"), *[F.col(f"__price.{n}").cast("double").alias(n) for n in names])


def token_cost(input_: Column, output: Column, read: Column, write: Column) -> Column:
    """Cost of four kinds of tokens at the prices of the same row, in double arithmetic."""
    per = lambda n, p: n.cast("double") * F.col(p) / 1e6
    return per(input_, "input_per_mtok") + per(output, "output_per_mtok") + per(read, "cache_read_per_mtok") + per(write, "cache_write_per_mtok")


def import_prices(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new price table, outcome of each incoming row: inserted, updated or unchanged).

    Rows are keyed by model and date; of incoming rows with one key the last
    in the order of all columns counts.
    """
    key = ["model", "effective_from"]
    rest = [c for c in stored.columns if c not in key]
    incoming = incoming.groupBy(*key).agg(F.max(F.struct(*rest)).alias("r")).select(*key, "r.*")
    old = stored.select(*key, *[F.col(c).alias(f"__{c}") for c in rest], F.lit(True).alias("__there"))
    same = F.lit(True)
    for c in rest:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    outcome = incoming.join(old, key, "left").withColumn("outcome", F.when(F.col("__there").isNull(), "inserted").when(same, "unchanged").otherwise("updated")).select(*key, *rest, "outcome")
    table = stored.join(incoming.select(*key), key, "left_anti").unionByName(incoming.select(*stored.columns))
    return table, outcome
