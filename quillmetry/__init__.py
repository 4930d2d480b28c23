"""Text profiling and writing diagnostics as Spark DataFrame plans."""
