"""Named queries bound to the driver tables, and their DuckDB oracle SQL."""
