"""Operators over graph tables: pure functions from frames to frames."""
