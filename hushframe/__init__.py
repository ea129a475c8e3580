"""Masking of personal and payment data in tables and streams, on Spark."""
