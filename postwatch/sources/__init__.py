"""Landed payloads, HTML pages and dimension files to the postings schema."""
