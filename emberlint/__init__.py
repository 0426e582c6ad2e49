"""Analytics over compiler diagnostics on Spark."""
