"""Distributed building blocks: profiling, grouping, quantiles, ordering, skew handling."""
