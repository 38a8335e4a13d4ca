"""sources of the document dataflow engine."""
