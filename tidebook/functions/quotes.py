"""Quotes of an inventory-aware dealer (Avellaneda and Stoikov, 2008) and of a symmetric one."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DealerParams:
    """Risk aversion, volatility, decay of the fill rate with distance, base rate and horizon."""

    gamma: float = 0.1
    sigma: float = 2.0
    k: float = 1.5
    a: float = 140.0
    horizon: float = 1.0


def reservation_price(mid: Column, inventory: Column, t: Column, p: DealerParams) -> Column:
    left = F.greatest(F.lit(0.0), F.lit(p.horizon) - t)
    return mid - inventory * F.lit(p.gamma) * F.lit(p.sigma**2) * left


def optimal_spread(t: Column, p: DealerParams) -> Column:
    left = F.greatest(F.lit(0.0), F.lit(p.horizon) - t)
    return F.lit(p.gamma) * F.lit(p.sigma**2) * left + F.lit(2.0 / p.gamma * math.log(1.0 + p.gamma / p.k))


def inventory_quotes(mid: Column, inventory: Column, t: Column, p: DealerParams) -> tuple[Column, Column]:
    """(bid, ask) around the reservation price."""
    center, half = reservation_price(mid, inventory, t, p), optimal_spread(t, p) / 2
    return center - half, center + half


def symmetric_quotes(mid: Column, p: DealerParams) -> tuple[Column, Column]:
    """(bid, ask) around the mid, with the spread of half the horizon."""
    half = optimal_spread(F.lit(0.5 * p.horizon), p) / 2
    return mid - half, mid + half


def fill_probability(distance: Column, dt: float, p: DealerParams) -> Column:
    """Of at least one arrival within ``dt`` at a quote so far from the mid."""
    return F.lit(1.0) - F.exp(-F.lit(p.a) * F.exp(-F.lit(p.k) * F.greatest(F.lit(0.0), distance)) * F.lit(dt))


def limit_rates(levels: int, k: float, alpha: float) -> Column:
    """Arrival rates ``k / i ** alpha`` of the first ``levels`` ticks from the opposite touch."""
    return F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda i: F.lit(k) / F.pow(i.cast("double"), F.lit(alpha)))
