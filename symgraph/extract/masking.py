"""Texts with comments and string contents blanked, so that declarations can be found by patterns."""

from __future__ import annotations

import bisect
import re

_COMMON = r"/\*[\s\S]*?(?:\*/|$)|//[^\n]*"
_STR = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_PATTERNS = {
    "javascript": re.compile(_COMMON + "|" + _STR + r"|`(?:[^`\\]|\\.)*`|(?<=[(=,:[!&|?{};\n])\s*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"),
    "php": re.compile(_COMMON + r"|\#(?!\[)[^\n]*|<<<[ \t]*(['\"]?)(\w+)\1\n[\s\S]*?\n[ \t]*\2\b|" + _STR.replace(r"[^\"\\\n]", r"[^\"\\]").replace(r"[^'\\\n]", r"[^'\\]")),
    "go": re.compile(_COMMON + r"|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)+'"),
    "rust": re.compile(_COMMON + r"|r#*\"[\s\S]*?\"#*|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\.[^']*)'"),
    "css": re.compile(r"/\*[\s\S]*?(?:\*/|$)|" + _STR),
    "scss": re.compile(r"/\*[\s\S]*?(?:\*/|$)|(?<![:\w])//[^\n]*|" + _STR),
}
_PATTERNS["typescript"] = _PATTERNS["javascript"]
_INK = re.compile(r"[^\s]")


def mask(text: str, language: str) -> str:
    """The text at the same offsets, comments blank and strings reduced to their quotes."""

    def blank(m: re.Match) -> str:
        s = m[0]
        lead = s[: len(s) - len(s.lstrip())]
        s = s[len(lead) :]
        if s[:1] in "\"'`" and len(s) > 1:
            return lead + s[0] + _INK.sub(" ", s[1:-1]) + s[-1]
        return lead + _INK.sub(" ", s)

    return _PATTERNS[language].sub(blank, text)


class Lines:
    """Line numbers of offsets."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)


def closing(masked: str, start: int, pair: str = "{}") -> int:
    """The offset of the bracket that closes the first one at or after ``start``, or the text's end."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(masked, start):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.start()
    return len(masked)
