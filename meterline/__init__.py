"""Metering and pricing of usage ledgers with Spark DataFrames."""
