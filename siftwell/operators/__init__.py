"""DataFrame operators: indexes, retrieval, fusion, feeds, comparisons."""
