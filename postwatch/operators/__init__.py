"""DataFrame to DataFrame operators: filters, dedup, state, matching, scoring, publishing."""
