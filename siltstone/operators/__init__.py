"""Joins, closures, paging, tables, checks and entitlements."""
