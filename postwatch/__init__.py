"""Posting monitoring on Spark: map, clean, dedup, match, score and publish job postings.

Operators take and return DataFrames and are lazy.  The exceptions run jobs and say so: the
greedy dedup rounds, the size checks in front of broadcasts, and the sinks.
"""
