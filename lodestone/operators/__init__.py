"""DataFrame to DataFrame operators: ranking, filters, lanes, graphs, evaluation."""
