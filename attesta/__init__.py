"""Screening analytics on Spark: relational views, record rules, evidence fusion and streams over identity documents."""
