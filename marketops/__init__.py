"""DataFrame-in, DataFrame-out operators for market-event data on Spark."""
