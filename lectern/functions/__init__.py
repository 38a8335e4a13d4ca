"""functions of the document dataflow engine."""
