"""memlattice: retrieval over long memories, expressed as Spark DataFrames."""
