"""DataFrame to DataFrame operators. Column names are parameters, so native tables and others can feed them."""
