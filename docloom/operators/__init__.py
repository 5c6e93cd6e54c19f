"""DataFrame operators: joins, grouping, windows and state over documents, reports and turns."""
