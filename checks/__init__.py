"""The test tables as an order star, the registered queries and their SQL oracles."""
