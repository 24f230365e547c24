"""Metric views, KPIs, reports and checks."""
