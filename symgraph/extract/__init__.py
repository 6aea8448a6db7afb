"""Extraction: source texts to nodes, edges, unresolved references and errors, by language."""

from symgraph.extract.run import errors, extract, nodes_of, references_of  # noqa: F401
