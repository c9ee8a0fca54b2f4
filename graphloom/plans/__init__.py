"""Query specification, predicate normalisation, compilation to DataFrames and explain."""
