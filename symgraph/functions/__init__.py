"""functions of symgraph."""
