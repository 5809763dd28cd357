"""Imports every catalog module so that all queries are registered."""

from recipeflow.plans import catalog_chat, catalog_log, catalog_model, catalog_stream, catalog_text  # noqa: F401
