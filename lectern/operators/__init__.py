"""operators of the document dataflow engine."""
