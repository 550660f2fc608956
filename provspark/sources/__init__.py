"""Readers, sinks and the synthetic example tables."""
