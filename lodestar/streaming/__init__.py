"""Windowed views of the latency log as it grows."""
