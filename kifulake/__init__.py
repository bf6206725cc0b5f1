"""Kifulake: game-record analytics on Spark DataFrames."""
