"""All queries of this subpackage."""

from __future__ import annotations

from loomwork.llm import queries_archive, queries_lines, queries_mixed, queries_text  # noqa: F401
from loomwork.llm.registry import QUERIES, SQL  # noqa: F401
