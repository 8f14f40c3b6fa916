"""Pricing with a rate card that changes over time.

Card rates are dollars (or credits) a million tokens; `valid_from` null is from the beginning,
`valid_to` null without end.  The card is a small dimension that Spark broadcasts by its own size
check; its model names and change instants are read by the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COUNTERS

# Aliases of models, a share of dollars that serving costs (low, middle, high).
ALIASES = {"codex-auto-review": "gpt-5.3-codex"}
BANDS = {"counter": (0.40, 0.45, 0.50), "message": (0.45, 0.525, 0.60)}
_DATED = r"-([0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$"
MONEY = ("usd_uncached", "usd_cached", "usd_output", "usd", "credits")


def canonical_model(model: Column, known: list[str]) -> Column:
    """Lower case, cut at `[`; an alias, or the base of a dated snapshot that is `known`, else itself."""
    name = F.substring_index(F.lower(model), "[", 1)
    base = F.regexp_replace(name, _DATED, "")
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[name]
    return F.when(name.isin(*known), name).when(alias.isNotNull(), alias).when(base.isin(*known), base).otherwise(name)


def card_models(card: DataFrame) -> list[str]:
    return sorted(r.model for r in card.select("model").distinct().collect())


def pricing_period(ts: Column, card: DataFrame) -> Column:
    """Start of the rate period: the latest change at or before `ts`, else null."""
    changes = sorted(r.valid_from for r in card.select("valid_from").where("valid_from is not null").distinct().collect())
    held = F.lit(None).cast("timestamp")
    for change in changes:
        held = F.when(ts >= F.lit(change), F.lit(change)).otherwise(held)
    return held


def rate_join(df: DataFrame, card: DataFrame, at: str = "ts") -> DataFrame:
    """Left join on provider and canonical model, with `at` inside the rate's validity; adds r_*."""
    rates = card.select(*[F.col(c).alias(f"r_{c}") for c in card.columns])
    named = df.withColumn("canonical", canonical_model(F.col("model"), card_models(card)))
    valid = (F.col("r_valid_from").isNull() | F.coalesce(F.col(at) >= F.col("r_valid_from"), F.lit(False))) & (F.col("r_valid_to").isNull() | F.coalesce(F.col(at) < F.col("r_valid_to"), F.col("r_valid_from").isNull()))
    return named.join(rates, (F.col("provider") == F.col("r_provider")) & (F.col("canonical") == F.col("r_model")) & valid, "left")


def _dollars(kind: str, share: str = "") -> Column:
    tokens = {c: F.col(c).cast("double") if not share else F.least(F.greatest(F.lit(0), F.col(share + c)), F.col(c)).cast("double") for c in COUNTERS}
    if kind == "uncached":
        return tokens["input"] * F.col("r_input")
    if kind == "output":
        return tokens["output"] * F.col("r_output")
    return tokens["cached"] * F.col("r_cached_read") + tokens["cache_w5m"] * F.col("r_cache_w5m") + tokens["cache_w1h"] * F.col("r_cache_w1h")


def _bucket(kind: str) -> Column:
    """A cost bucket with its long-context premium: (multiplier - 1) on the share, if the rate has a threshold."""
    multiplier = F.col("r_lc_output_multiplier" if kind == "output" else "r_lc_input_multiplier")
    premium = _dollars(kind, "lc_") * F.greatest(F.lit(0.0), multiplier - 1)
    return (_dollars(kind) + F.when(F.col("r_lc_threshold").isNotNull(), F.coalesce(premium, F.lit(0.0))).otherwise(0.0)) / 1e6


def quote(df: DataFrame, card: DataFrame, at: str = "ts") -> DataFrame:
    """Adds usd_uncached, usd_cached, usd_output, usd, credits and priced.

    Without a rate the money is null; without all three credit rates the credits are null.  Prices
    are linear in the counters, so sums over rows of one period may be priced as a row.
    """
    joined = rate_join(df, card, at).withColumn("priced", F.col("r_model").isNotNull())
    joined = joined.withColumns({f"usd_{kind}": _bucket(kind) for kind in ("uncached", "cached", "output")})
    credits = (F.col("input") * F.col("r_credit_input") + F.col("cached") * F.col("r_credit_cached") + F.col("output") * F.col("r_credit_output")) / 1e6
    joined = joined.withColumns({"usd": F.col("usd_uncached") + F.col("usd_cached") + F.col("usd_output"), "credits": credits})
    return joined.drop(*[f"r_{c}" for c in card.columns])


def unpriced(df: DataFrame, card: DataFrame) -> DataFrame:
    """(provider, model, events) without a rate at their time."""
    return quote(df, card).where(~F.col("priced")).groupBy("provider", "model").agg(F.sum("event_count").alias("events"))


def serving_cost(usd: Column, provider: Column, midpoint: Column | None = None) -> tuple[Column, Column, Column]:
    """Low, middle and high serving cost: the provider's band, moved to `midpoint` and kept in 0 to 1."""

    def band(i: int) -> Column:
        return F.create_map(*[F.lit(x) for p, b in BANDS.items() for x in (p, b[i])])[provider]

    asked = band(1) if midpoint is None else F.when(midpoint.isNull() | F.isnan(midpoint) | (F.abs(midpoint) == float("inf")), band(1)).otherwise(midpoint)
    middle = F.least(F.greatest(asked, F.lit(0.0)), F.lit(1.0))
    ratios = (F.greatest(F.lit(0.0), middle - (band(1) - band(0))), middle, F.least(F.lit(1.0), middle + (band(2) - band(1))))
    sound = usd.isNotNull() & ~F.isnan(usd) & (usd > 0) & (usd < float("inf"))
    return tuple(F.when(sound, usd * r).otherwise(0.0) for r in ratios)


def withhold_provisional(df: DataFrame, provisional: Column) -> DataFrame:
    """Zero money columns where a result is provisional."""
    return df.withColumns({c: F.when(provisional, 0.0).otherwise(F.col(c)) for c in MONEY if c in df.columns})
