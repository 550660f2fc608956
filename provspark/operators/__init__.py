"""Operators over tracked frames and persisted artifacts."""
