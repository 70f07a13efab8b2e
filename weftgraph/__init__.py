"""Analytics over knowledge graphs and document collections, on Spark."""
