"""Composite reports and the cleaning run, built from operators."""
