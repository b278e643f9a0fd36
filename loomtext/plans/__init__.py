"""Queries over the driver's tables and the per-document trace."""
