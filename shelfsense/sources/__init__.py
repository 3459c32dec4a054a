"""Readers and writers (S1, S5, S6) and the synthetic-table mapping."""

from shelfsense.sources.tables import (  # noqa: F401
    read_table, write_table, replace_partitions, recover_table, write_pipe_text, read_pipe_text, split_pipe_text,
    load_tables,
)
from shelfsense.sources.synthetic import (  # noqa: F401
    synthetic_sales, synthetic_properties, synthetic_brands, synthetic_flags,
)
