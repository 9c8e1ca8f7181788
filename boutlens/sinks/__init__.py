"""Writers: replaced partitions, merged tables, exports, append-only logs."""
