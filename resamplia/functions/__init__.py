"""Column expressions: metrics, recodes, time and label text."""
