"""sources of symgraph."""
