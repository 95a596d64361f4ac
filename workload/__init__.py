"""Fleet data sets derived from the given tables, and the registered queries."""
