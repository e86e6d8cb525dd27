"""DataFrame operators: joins, intervals, ranks, metrics, statistics, splits, graphs, motifs."""
