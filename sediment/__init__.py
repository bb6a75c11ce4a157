"""An analytics engine for versioned key-value logs on Spark."""
