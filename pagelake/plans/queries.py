"""All queries of the package (the corpus operators register their own)."""

from . import queries_native, queries_records, queries_render  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
