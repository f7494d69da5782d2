"""Provenance-checked document analytics on Spark."""
