"""recipeflow: recipe-assistant data work as Spark DataFrame jobs.

Sub-packages:

- ``functions``  Column -> Column expressions (text normalisation, parsing,
  rendering, lookups).  Narrow: no exchange.
- ``operators``  DataFrame -> DataFrame operators (chat log, model map,
  translation memory, audit, counters).
- ``sources``    readers for the driver tables, chat documents, derived views.
- ``plans``      composite pipelines and the registered query catalog.
- ``streaming``  Structured Streaming forms of the chat-log operators.
"""

from recipeflow.session import get_spark, work_dir  # noqa: F401

__all__ = ["get_spark", "work_dir"]
