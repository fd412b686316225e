"""Sources and sinks: Parquet tables, JSON sidecars, prediction/metric writers."""
