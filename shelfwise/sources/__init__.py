"""Table schemas, readers, catalog registration, mart writer, batch loads and rejects."""

from .batches import compact_mart, current_loads, mart_log, read_mart, refresh_mart  # noqa: F401
from .loader import (  # noqa: F401
    Tables, delivered, load_tables, preview, register, register_marts, table_counts, write_mart, write_marts,
)
from .rejects import load_with_rejects, read_with_rejects  # noqa: F401
from .schema import SCHEMAS  # noqa: F401
