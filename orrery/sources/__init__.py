"""Reading files into chunks, and tables kept as snapshots."""
