"""Lectern: a document dataflow engine on Apache Spark DataFrames."""
