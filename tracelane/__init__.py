"""Process analytics over event logs as Spark plans."""
