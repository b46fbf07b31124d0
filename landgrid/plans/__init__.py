"""Query conditions, grid covers, the query service, and the registered queries."""
