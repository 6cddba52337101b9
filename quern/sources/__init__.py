"""Where tables come from: the catalog of immutable table versions, Parquet and literal rows."""
