"""symgraph: property graphs of source code, queried and prepared with Spark DataFrames."""
