"""Ledger analytics as Spark DataFrames: read bank exports, classify and link transactions, report on them."""
