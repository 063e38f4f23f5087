"""DataFrame transformations: chunking, scoring, fusion, metrics, statistics, serving."""
