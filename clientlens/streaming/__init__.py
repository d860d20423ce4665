"""Structured Streaming forms of the audit, alert and admission operators."""
