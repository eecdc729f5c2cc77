"""Structured Streaming realisation of epoch telemetry and policies."""
