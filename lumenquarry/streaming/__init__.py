"""Structured Streaming: incremental reconciliation and event windows."""
