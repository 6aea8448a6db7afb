"""streaming of symgraph."""
