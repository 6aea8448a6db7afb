"""What an extractor yields for one file."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Found:
    """Nodes, edges and references of one file; ids are path:line:kind:name."""

    path: str
    language: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)

    def node(self, kind: str, name: str, start: int, end: int | None = None, qualified: str | None = None, doc: str | None = None, parent: str | None = None, **meta) -> str:
        """Adds a node, contained in ``parent`` (the file if none), and returns its id."""
        id_ = f"{self.path}:{start}:{kind}:{name}"
        self.nodes.append({"id": id_, "kind": kind, "name": name, "qualified_name": qualified or name, "start_line": start, "end_line": end or start, "docblock": doc, "metadata": meta})
        if kind != "file":
            self.edge(parent or self.nodes[0]["id"], id_, "contains", 1.0, start)
        return id_

    def edge(self, source: str, target: str, kind: str, confidence: float, line: int | None = None, **meta) -> None:
        self.edges.append({"source_id": source, "target_id": target, "kind": kind, "confidence": confidence, "line_number": line, "metadata": meta})

    def ref(self, source: str, name: str, kind: str, line: int, **context) -> None:
        if name:
            self.refs.append({"source_id": source, "name": name, "kind": kind, "line_number": line, "metadata": context})

    def error(self, line: int | None, message: str, severity: str = "error", node_type: str | None = None) -> None:
        self.errors.append({"line_number": line, "message": message, "severity": severity, "node_type": node_type})
