"""Options backtesting as Spark batch jobs."""
