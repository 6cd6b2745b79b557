"""Bootstrap scoring of predictions, and analysis of run times and CPU samples, as Spark plans."""
