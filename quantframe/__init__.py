"""Spark jobs for market data and portfolio analytics."""
