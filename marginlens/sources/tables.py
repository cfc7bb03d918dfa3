"""The five star-schema tables as one lazy bundle."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    dim_sku: DataFrame
    dim_store: DataFrame
    fact_orders: DataFrame
    fact_returns: DataFrame
    fact_marketing_spend: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]

    def with_table(self, name: str, df: DataFrame) -> "Tables":
        return replace(self, **{name: df})

    @property
    def spark(self):
        return self.fact_orders.sparkSession
