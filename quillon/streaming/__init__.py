"""Scoring of streams: the same plan, since every row is scored by itself."""

from .score import score_stream, start_scoring  # noqa: F401
