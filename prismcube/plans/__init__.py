"""From a request to a DataFrame: resolving, choice of the table, metrics and lowering."""
