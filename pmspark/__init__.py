"""Analytics over binary-outcome markets, and training-data operators, as Spark jobs."""
