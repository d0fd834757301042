"""Batch jobs composed from the operators."""
