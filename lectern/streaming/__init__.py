"""streaming of the document dataflow engine."""
