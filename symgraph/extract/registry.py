"""Extension points: extractors by language, framework detectors, text embedders."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from symgraph.extract.records import Found

Extractor = Callable[[str, str, str], Found]
Detector = Callable[[str, str, Found], None]

_extractors: dict[str, Extractor] = {}
_detectors: dict[str, tuple[tuple[str, ...], Detector]] = {}
_embedders: dict[str, Callable[[list[str]], list[list[float]]]] = {}
GROUP = "symgraph.plugins"


def extractor(*languages: str) -> Callable[[Extractor], Extractor]:
    """Registers ``f(path, text, language) -> Found`` for languages; the last registration holds."""

    def add(f: Extractor) -> Extractor:
        _extractors.update(dict.fromkeys(languages, f))
        return f

    return add


def detector(name: str, *languages: str) -> Callable[[Detector], Detector]:
    """Registers ``f(path, text, found)``, which adds a framework's nodes and edges to what was found."""

    def add(f: Detector) -> Detector:
        _detectors[name] = (languages, f)
        return f

    return add


def embedder(name: str, f: Callable[[list[str]], list[list[float]]]) -> None:
    _embedders[name] = f


def extractor_for(language: str | None) -> Extractor | None:
    return _extractors.get((language or "").lower())


def detectors_for(language: str) -> list[tuple[str, Detector]]:
    return [(n, f) for n, (langs, f) in _detectors.items() if language in langs]


def load_plugins() -> list[str]:
    """Imports what other packages offer under the entry-point group; each registers itself."""
    return [p.name for p in entry_points(group=GROUP) if p.load() is not None]
