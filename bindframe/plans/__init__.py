"""Queries of the binding-data operators over the driver's tables, with their SQL."""
