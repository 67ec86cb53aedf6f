"""Inventory analytics on Spark: quality checks, KPIs, forecasts, advice and answers over a stock ledger."""
