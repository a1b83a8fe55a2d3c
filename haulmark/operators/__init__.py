"""DataFrame operators: joins, aggregates, windows, graphs, allocation, replay, quality, journals."""
