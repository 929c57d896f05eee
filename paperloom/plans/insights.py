"""Answers to cross-document questions in one common shape.

An answer is rows (query, key, value, n_sources): one row per vendor, contract or document the answer
consists of. The source documents are a second table (query, key, path), never a list in one value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.operators import aggregate, matching

ANSWER = ["query", "key", "value", "n_sources"]


def _answer(name: str, df: DataFrame, key: Column, value: Column, n: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("query"),
        key.cast("string").alias("key"),
        value.cast("string").alias("value"),
        n.cast("bigint").alias("n_sources"),
    )


def insight_queries(as_of: Column, top: int = 1) -> dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]]:
    """Named questions over (invoices, agreements, purchase orders)."""

    def totals(inv, agr, po):
        df = aggregate.total_by_vendor(inv).filter(~F.col("is_total"))
        return _answer("total_by_vendor", df, F.col("vendor"), F.col("total_amount"), F.col("n_invoices"))

    def best(inv, agr, po):
        df = aggregate.top_vendors(inv, top)
        return _answer("top_vendor", df, F.col("vendor"), F.col("total_amount"), F.col("n_invoices"))

    def expiring(inv, agr, po):
        df = aggregate.expiring(agr, as_of)
        meta = F.col("metadata")
        return _answer("expiring_contracts", df, meta["agreement_id"], meta["expiry_date"], F.lit(1))

    def without_po(inv, agr, po):
        df = matching.unmatched_invoices(inv, po)
        return _answer("invoices_without_po", df, F.col("path"), F.col("metadata.po_number"), F.lit(1))

    def limits(inv, agr, po):
        df = matching.over_limit(inv, agr).filter("over_limit")
        return _answer("over_limit", df, F.col("agreement_id"), F.col("total"), F.col("n_invoices"))

    def contracts(inv, agr, po):
        df = matching.contract_asof(inv, agr)
        return _answer("contract_of_invoice", df, F.col("path"), F.col("agreement_id"), F.lit(1))

    return {
        "total_by_vendor": totals,
        "top_vendor": best,
        "expiring_contracts": expiring,
        "invoices_without_po": without_po,
        "over_limit": limits,
        "contract_of_invoice": contracts,
    }


def insight(name: str, invoices: DataFrame, agreements: DataFrame, orders: DataFrame, as_of: Column) -> DataFrame:
    """One named question."""
    return insight_queries(as_of)[name](invoices, agreements, orders)


def insights(names: list[str], invoices: DataFrame, agreements: DataFrame, orders: DataFrame, as_of: Column) -> DataFrame:
    """Several questions in one table."""
    return reduce(DataFrame.unionByName, [insight(n, invoices, agreements, orders, as_of) for n in names])
