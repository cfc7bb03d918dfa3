"""Shared measures as Column expressions (no UDFs)."""
