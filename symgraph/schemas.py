"""Vocabulary and schemas of the property graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of nodes.
NODE_KINDS = (
    "file directory package class interface trait function method property constant enum type_alias variable namespace module parameter import export "
    "decorator route component hook model event middleware listener provider controller css_class css_id css_variable css_keyframes css_media_query "
    "css_layer css_font_face scss_variable scss_mixin scss_function scss_placeholder tailwind_theme_token tailwind_utility"
).split()
# The kinds of edges.
EDGE_KINDS = (
    "contains defined_in member_of extends implements uses_trait has_type returns_type generic_of union_of intersection_of imports imports_type exports "
    "re_exports dynamic_imports depends_on calls instantiates dispatches_event listens_to routes_to renders passes_prop uses_hook provides_context "
    "consumes_context api_calls api_serves shares_type_contract co_changes_with css_uses_variable css_media_contains css_layer_contains "
    "css_keyframes_used_by scss_includes_mixin scss_extends scss_uses_variable scss_uses_function scss_forwards scss_nests tailwind_theme_defines "
    "tailwind_applies tailwind_source_scans imports_stylesheet css_module_import uses_css_class js_sets_css_variable js_reads_css_variable "
    "tailwind_class_uses_token"
).split()
# Importance of node kinds in the store's entry points; all others 0.5.
ENTRY_WEIGHTS = {
    "class": 1.0, "interface": 0.95, "trait": 0.9, "model": 0.9, "enum": 0.85, "controller": 0.85, "function": 0.8, "method": 0.75, "route": 0.7,
    "component": 0.7, "middleware": 0.65, "module": 0.6,
}
# Importance of node kinds in relevance and the analyser's entry points; all others 0.5.
RELEVANCE_WEIGHTS = {
    "class": 1.0, "interface": 0.95, "trait": 0.9, "enum": 0.85, "function": 0.8, "method": 0.75, "component": 0.9, "route": 0.85, "hook": 0.8,
    "model": 0.9, "middleware": 0.8, "event": 0.75, "module": 0.7, "namespace": 0.6, "file": 0.5, "directory": 0.3, "package": 0.4, "property": 0.5,
    "constant": 0.5, "type_alias": 0.7, "variable": 0.4, "parameter": 0.3, "import": 0.2, "export": 0.3, "decorator": 0.5,
}
# Kinds that the summary's ranking leaves out.
STYLE_KINDS = ["css_class", "css_id", "css_variable", "css_keyframes", "css_media_query", "css_layer", "css_font_face"]

NODES = (
    "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, language string, docblock string, "
    "source_text string, content_hash string, metadata string, pagerank double, community_id int"
)
EDGES = "source_id string, target_id string, kind string, confidence double, line_number int, metadata string"
FILES = (
    "file_path string, content_hash string, language string, plugin_name string, node_count int, edge_count int, parse_time_ms double, last_parsed timestamp"
)
REFS = "source_node_id string, reference_name string, reference_kind string, line_number int, language string, context map<string,string>"
ERRORS = "file_path string, line_number int, message string, severity string, node_type string"


def weight(kind: Column, weights: dict[str, float]) -> Column:
    """The importance of a node kind, 0.5 for a kind without one."""
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[kind], F.lit(0.5))


def valid_edge() -> Column:
    """Whether an edge has both ends, a known kind and a confidence between 0 and 1."""
    return F.col("source_id").isNotNull() & F.col("target_id").isNotNull() & F.col("kind").isin(EDGE_KINDS) & F.col("confidence").between(0.0, 1.0)
