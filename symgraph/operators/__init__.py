"""operators of symgraph."""
