"""Graphs, delimited files, graph JSON and change feeds as DataFrames."""
