"""Leakage-safe game features and forecast evaluation as Spark DataFrame jobs."""
