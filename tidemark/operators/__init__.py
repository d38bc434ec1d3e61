"""Operators over DataFrames: joins, windows, cross-sections, portfolios, statistics, screens and audits."""
