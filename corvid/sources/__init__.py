"""Sources and sinks (SC1-SC6, SK1-SK2)."""

from corvid.sources.readers import (latest_partition, latest_snapshot, load_value_from_path, read_csv_strings, read_parquet,
                                    read_table, refresh_table, spread_for_cpu)
from corvid.sources.sinks import write_csv, write_parquet

__all__ = ["latest_partition", "latest_snapshot", "load_value_from_path", "read_csv_strings", "read_parquet",
           "read_table", "refresh_table", "spread_for_cpu", "write_csv", "write_parquet"]
