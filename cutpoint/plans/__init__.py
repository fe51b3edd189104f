"""How operators are put together: running sums at any size, and the search dispatch."""
