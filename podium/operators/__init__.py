"""Reusable DataFrame operators: paging, size-checked joins, fact helpers."""
