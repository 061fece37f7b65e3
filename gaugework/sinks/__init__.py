"""Where results go: run records, series, reports, annotations, JSON lines."""
