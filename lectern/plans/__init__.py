"""plans of the document dataflow engine."""
