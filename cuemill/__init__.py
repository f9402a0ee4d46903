"""Document, subtitle and transcript dataflow on Spark DataFrames."""
