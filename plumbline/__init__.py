"""A PySpark engine that ingests reports, extracts claims, retrieves evidence and checks the claims."""
