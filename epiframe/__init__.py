"""Episode analytics on Spark: windows, gates, geometry, normalizers, blends and metrics over frame tables."""
