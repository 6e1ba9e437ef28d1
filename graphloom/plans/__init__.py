"""Query text to algebra to DataFrames."""
