"""Micro-batch linkage of arriving records."""
