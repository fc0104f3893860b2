"""Where results go: partitioned tables, CSV of fixed order and precision, workbooks, metadata, rasters."""
