"""Trade-cost columns: slippage, size impact and fees of one simulated fill."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LedgerConfig


def trade_costs(
    bid: Column, ask: Column, side: Column, quantity: Column, multiplier: Column, is_option: Column,
    config: LedgerConfig = LedgerConfig(),
) -> dict[str, Column]:
    """Named columns of a fill's price, cost and cash effect."""
    buy = side == "BUY"
    price = F.when(buy, ask).otherwise(bid)
    units = quantity * multiplier
    bps = config.slippage_bps + config.impact_bps_per_10000 * (price * units) / 10_000
    slip = price * bps / 10_000
    fill = F.greatest(F.lit(0.0), F.when(buy, price + slip).otherwise(price - slip))
    gross = fill * units
    fees = gross * config.fee_bps / 10_000 + F.when(is_option, quantity * config.fee_per_contract).otherwise(0.0)
    return {
        "quote_price": price,
        "fill_price": fill,
        "slippage": F.abs(fill - price) * units,
        "gross_premium": gross,
        "fees": fees,
        "total_debit": F.when(buy, gross + fees),
        "net_credit": F.when(~buy, gross - fees),
    }
