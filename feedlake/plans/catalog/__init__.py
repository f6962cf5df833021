"""Registered queries, grouped by area.  Importing this package registers them all."""

from feedlake.plans.catalog import categories, composites, filters, history, ingest, profile, trends, vectors  # noqa: F401
