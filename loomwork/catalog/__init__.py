from loomwork.catalog import (  # noqa: F401
    basics, bitsets, linkage, numbers, profiling, scans, streams, trees,
)
from loomwork.catalog.registry import QUERIES, SQL  # noqa: F401
