"""Spark-first analytics over companies, tenders, buyers, owners and documents."""
