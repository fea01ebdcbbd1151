"""Lakehouse data jobs as PySpark DataFrame code: layers, paging, streams and access entitlements."""
