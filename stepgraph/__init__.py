"""stepgraph: bulk-synchronous, stateful dataflow over many runs at once, on Spark DataFrames."""

__version__ = "0.1.0"
