"""Structured Streaming: rule evaluation over streams."""
