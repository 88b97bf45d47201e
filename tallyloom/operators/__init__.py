"""Joins, scoring, decisions, merges and aggregates over DataFrames."""
