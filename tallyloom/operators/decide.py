"""Decisions on ranked candidates, and the states that follow from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MatchConfig


def confidence_color(score: Column, config: MatchConfig = MatchConfig()) -> Column:
    return F.when(score > config.green_over, "green").when(score >= config.yellow_from, "yellow").otherwise("red")


def cap(score: Column, config: MatchConfig = MatchConfig()) -> Column:
    return F.least(score, F.lit(config.automatic_cap))


def with_bonus(score: Column, verified: Column, config: MatchConfig = MatchConfig()) -> Column:
    return F.when(verified, F.least(F.lit(100.0), score + config.price_bonus)).otherwise(score)


def price_matches(price: Column, invoice_price: Column, config: MatchConfig = MatchConfig()) -> Column:
    return F.coalesce(F.abs(price - invoice_price) <= config.price_tolerance, F.lit(False))


def closest(candidates: Column) -> Column:
    """The best candidate that passes the guards, whatever its score."""
    return F.get(F.filter(candidates, lambda c: c["ok"]), 0)


def choose(candidates: Column, invoice_price: Column, config: MatchConfig = MatchConfig()) -> Column:
    """Of the candidates at the threshold, the best one of the invoice's price, or else the best.

    ``candidates`` is sorted by score; the guards are not asked: a price can lead to a row
    that they then reject.
    """
    return of_price(qualified(candidates, config), invoice_price, config)


def qualified(candidates: Column, config: MatchConfig = MatchConfig()) -> Column:
    """The candidates at the threshold, which no invoice's price changes."""
    return F.filter(candidates, lambda c: c["score"] >= config.threshold)


def of_price(fit: Column, invoice_price: Column, config: MatchConfig = MatchConfig()) -> Column:
    """Of qualified candidates the best one of the invoice's price, or else the best."""
    priced = F.filter(fit, lambda c: price_matches(c["price"], invoice_price, config))
    return F.coalesce(F.get(priced, 0), F.get(fit, 0))


def row_status(controlled: Column, confirmed: Column, ignored: Column, copied: Column, color: Column) -> Column:
    return (
        F.when(controlled, "controlled").when(confirmed, "confirmed").when(ignored, "ignored").when(copied, "copied").otherwise(color)
    )


def effective_name(edited: Column, suggested: Column) -> Column:
    return F.coalesce(F.nullif(edited, F.lit("")), suggested)
