"""Lexers: source text to token kinds, one pass each. A kind is a keyword, a sign or a class of tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Tokens:
    """kinds and, of each token, whether a line break stands before it, its offset, and the lexical faults."""

    kinds: list[str] = field(default_factory=list)
    fresh: list[bool] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    faults: list[tuple[int, str]] = field(default_factory=list)


# The keywords of each language that its grammar names.
KEYWORDS = {
    "javascript": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield async await of static get set from as",
    "typescript": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield async await of static get set from as satisfies interface type enum namespace module declare abstract implements public private protected readonly override keyof infer is asserts unique",
    "php": "abstract as break case catch class clone const continue declare default do echo else elseif enum extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface match namespace new print private protected public readonly require require_once return static switch throw trait try use var while yield from and or xor endif endwhile endfor endforeach endswitch array list unset isset empty",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type unsafe use where while",
    "python": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
}
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}

_NAME = r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*"
_NUM = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.(?!\.)\d*(?:_\d+)*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"
# a dot before a name is a call or a field
_NUM_RUST = _NUM.replace(r"(?:\.(?!\.)\d*(?:_\d+)*)?", r"(?:\.\d[\d_]*|\.(?![.\w]))?").replace(r"|\.\d[\d_]*)(", ")(")
_GAP = r"(?P<ws>[ \t\r\f\v ﻿]+)|(?P<nl>\n[ \t\r\n\f]*)"
_SLASHES = r"|(?P<lc>//[^\n]*)|(?P<bc>/\*(?:[^*]|\*(?!/))*\*/)|(?P<ubc>/\*)"

_SIGNS = {
    "javascript": r"=>|\.\.\.|\*\*=|<<=|>>>=|>>=|&&=|\|\|=|\?\?=|[-+*/%&|^]=|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\*\*|\+\+|--|<<|>>>|>>|\?\.(?!\d)|[-+*/%&|^~!<>=?:;,.@#]",
    "php": r"<=>|\*\*=|\.\.\.|<<=|>>=|\?\?=|[-+*/.%&|^]=|===|!==|==|!=|<>|<=|>=|&&|\|\||\?\?|\*\*|\+\+|--|<<|>>|=>|\?->|->|::|[-+*/%&|^~!<>=?:;,.@\\#]",
    "go": r"<<=|>>=|&\^=|\.\.\.|:=|<-|&\^|[-+*/%&|^]=|==|!=|<=|>=|&&|\|\||\+\+|--|<<|>>|[-+*/%&|^~!<>=:;,.]",
    "rust": r"<<=|>>=|\.\.=|\.\.\.|\.\.|=>|->|::|[-+*/%&|^]=|==|!=|<=|>=|&&|\|\||<<|[-+*/%&|^~!<>=?:;,.@#$]",
}
# type arguments may close several at once, so these languages get their right shifts as single signs
_SIGNS["typescript"] = re.sub(r">>>=\||>>=\||>>>\||>>\|", "", _SIGNS["javascript"])
_SIGNS["rust"] = _SIGNS["rust"].replace(">>=|", "")
_CLASS = {}
for _c, _s in (
    ("o", "* / % ** && || ?? == != === !== <= >= <=> <> ^ << >> >>> &^"),
    ("p", "+ -"),
    ("a", "+= -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??= .= &^="),
    ("u", "! ~"),
    ("c", "++ --"),
):
    _CLASS.update(dict.fromkeys(_s.split(), _c))

_STR = r"(?P<str>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<ustr>[\"'])"
_MASTER = {
    "javascript": re.compile(_GAP + _SLASHES + "|" + _STR + rf"|(?P<tick>`)|(?P<num>{_NUM}n?)|(?P<id>#?{_NAME})|(?P<br>[()\[\]{{}}])|(?P<op>{_SIGNS['javascript']})|(?P<bad>.)"),
    "php": re.compile(
        _GAP + _SLASHES + r"|(?P<hash>\#(?!\[)(?:(?!\?>)[^\n])*)|(?P<attr>\#\[[^\n]*\][ \t]*(?=\n|[a-z]))|(?P<close>\?>\n?)"
        + r"|(?P<here><<<[ \t]*(?P<q>[\"']?)(?P<tag>[A-Za-z_]\w*)(?P=q)\r?\n)|(?P<cast>\([ \t]*(?:int|integer|float|double|string|bool|boolean|array|object|binary|unset)[ \t]*\))"
        + rf"|(?P<str>\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`)|(?P<ustr>[\"'`])|(?P<var>\${{1,2}}{_NAME.replace('$', '')})|(?P<num>{_NUM})|(?P<id>\\?{_NAME.replace('$', '')}(?:\\{_NAME.replace('$', '')})*)|(?P<br>[()\[\]{{}}])|(?P<op>{_SIGNS['php']})|(?P<bad>.)"
    ),
    "go": re.compile(_GAP + _SLASHES + rf"|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)+')|(?P<ustr>[\"'`])|(?P<num>{_NUM}i?)|(?P<id>{_NAME.replace('$', '')})|(?P<br>[()\[\]{{}}])|(?P<op>{_SIGNS['go']})|(?P<bad>.)"),
    "rust": re.compile(
        _GAP + r"|(?P<lc>//[^\n]*)|(?P<ubc>/\*)"
        + rf"|(?P<str>(?:b|c|br|cr|r)?\#*\"(?:(?<=\#\")[\s\S]*?\"\#+|(?:[^\"\\]|\\[\s\S])*\")|b?'(?:[^'\\\n]|\\(?:u\{{[^}}]*\}}|x..|.))')|(?P<life>'{_NAME.replace('$', '')})|(?P<ustr>[\"'])|(?P<num>{_NUM_RUST}(?:_?[iuf](?:8|16|32|64|128|size))?)|(?P<id>(?:r\#)?{_NAME.replace('$', '')})|(?P<br>[()\[\]{{}}])|(?P<op>{_SIGNS['rust']})|(?P<bad>.)"
    ),
    "python": re.compile(
        r"(?P<ws>(?:[ \t\r\f﻿]|\\\r?\n)+)|(?P<nl>\n)|(?P<lc>\#[^\n]*)"
        + r"|(?P<str>(?:[rRbBuUfFtT]{0,2})(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'))|(?P<ustr>[\"'])"
        + rf"|(?P<num>{_NUM}[jJ]?)|(?P<id>{_NAME.replace('$', '')})|(?P<br>[()\[\]{{}}])|(?P<op>->|:=|\.\.\.|\*\*=|//=|<<=|>>=|[-+*/%&|^@]=|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%&|^~<>=:;,.@])|(?P<bad>.)"
    ),
    "css": re.compile(
        r"(?P<ws>[ \t\r\f﻿]+)|(?P<nl>\n[ \t\r\n\f]*)|(?P<bc>/\*(?:[^*]|\*(?!/))*\*/)|(?P<ubc>/\*)|(?P<lc>//[^\n]*)|(?P<cdo><!--|-->)"
        r"|(?P<url>url\(\s*[^\"'()\s{};][^\"'()\s]*\s*\))|(?P<str>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<ustr>[\"'])"
        r"|(?P<interp>\#\{)|(?P<hash>\#[\w\u0080-\U0010ffff-]+)|(?P<at>@[A-Za-z_-][\w-]*)|(?P<var>\$[A-Za-z_][\w-]*)|(?P<place>%[A-Za-z_][\w-]*)"
        r"|(?P<num>[+-]?(?:\d+\.\d+|\d+|\.\d+)(?:[eE][+-]?\d+)?(?:%|[A-Za-z]+\b)?)|(?P<id>-{0,2}[A-Za-z_\u0080-\U0010ffff\\](?:[\w\u0080-\U0010ffff-]|\\.)*)"
        r"|(?P<br>[()\[\]{}])|(?P<op>==|!=|<=|>=|\.\.\.|::|[~|^$*]=|[-+*/%<>=!~:;,.&|#])|(?P<bad>.)"
    ),
}
_MASTER["typescript"] = re.compile(_MASTER["javascript"].pattern.replace(_SIGNS["javascript"], _SIGNS["typescript"]))
_MASTER["scss"] = _MASTER["css"]
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_IDENT = re.compile(r"[\w$]")
# kinds after which a slash divides and a name can go on; after all others a slash begins a pattern
_ENDS = frozenset(("I", "N", "S", "Q", ")", "]", "}", "V", "c", "this", "super", "G"))
# Rules of style sheets that say nothing without a name or condition.
_AT_WITH = frozenset(("@include", "@extend", "@mixin", "@function", "@if", "@each", "@for", "@while", "@return", "@use", "@forward", "@import", "@media", "@supports", "@keyframes", "@namespace"))
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_JSX_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_JSX_GAP = re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*")


def _braces(text: str, k: int) -> int:
    """The offset after the brace that closes the one at k, or -1."""
    depth, n = 0, len(text)
    while k < n:
        c = text[k]
        if c == "`":
            k = _template(text, k)
            if k < 0:
                return -1
            continue
        if c in "\"'":
            m = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'").match(text, k)
            k = m.end() if m else k + 1
            continue
        if text.startswith("/*", k):
            k = text.find("*/", k)
            if k < 0:
                return -1
            k += 2
            continue
        depth += (c == "{") - (c == "}")
        k += 1
        if not depth:
            return k
    return -1


def _jsx(text: str, k: int, held: list[tuple[int, int]]) -> int:
    """The offset after the JSX element that begins at k, or -1 if there is none; held: the bounds of the expressions in it."""
    n = len(text)
    k += 1
    m = _JSX_NAME.match(text, k)
    name = m[0] if m else ""
    k = m.end() if m else k
    while True:  # attributes
        k = _JSX_GAP.match(text, k).end()
        if k >= n:
            return -1
        if text.startswith("/>", k):
            return k + 2 if name else -1
        if text[k] == ">":
            k += 1
            break
        if text[k] == "{":
            end = _braces(text, k)
            if end < 0 or not text[k + 1 : end - 1].strip().startswith("..."):
                return -1
            held.append((k + 1, end - 1))
            k = end
            continue
        m = _JSX_NAME.match(text, k)
        if not m or not name:
            return -1
        k = m.end()
        at = _JSX_GAP.match(text, k).end()
        if at < n and text[at] == "=":
            k = _JSX_GAP.match(text, at + 1).end()
            m = _JSX_QUOTED.match(text, k)
            if m:
                k = m.end()
            elif k < n and text[k] == "{":
                end = _braces(text, k)
                if end < 0:
                    return -1
                held.append((k + 1, end - 1))
                k = end
            elif k < n and text[k] == "<":
                k = _jsx(text, k, held)
                if k < 0:
                    return -1
            else:
                return -1
    while k < n:  # children
        c = text[k]
        if c == "{":
            end = _braces(text, k)
            if end < 0:
                return -1
            held.append((k + 1, end - 1))
            k = end
        elif text.startswith("</", k):
            end = re.compile(r"</\s*" + re.escape(name) + r"\s*>").match(text, k)
            return end.end() if end else -1
        elif c == "<":
            k = _jsx(text, k, held)
            if k < 0:
                return -1
        elif c in ">}":
            return -1
        else:
            k += 1
    return -1


def _pattern_closes(pattern: str) -> bool:
    """Whether the groups of a regular expression literal pair up."""
    depth, inside, k = 0, False, 1
    while k < len(pattern) - 1:
        c = pattern[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "/":
            break
        else:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                return False
        k += 1
    return not depth


def _template(text: str, k: int) -> int:
    """The offset after a template literal whose back tick stands at k, or -1 if it never ends."""
    k += 1
    n = len(text)
    while k < n:
        c = text[k]
        if c == "\\":
            k += 2
        elif c == "`":
            return k + 1
        elif c == "$" and text.startswith("${", k):
            depth, k = 1, k + 2
            while k < n and depth:
                c = text[k]
                if c == "`":
                    k = _template(text, k)
                    if k < 0:
                        return -1
                    continue
                if c in "\"'":
                    m = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'").match(text, k)
                    k = m.end() if m else k + 1
                    continue
                depth += (c == "{") - (c == "}")
                k += 1
        else:
            k += 1
    return -1


def _nested_comment(text: str, k: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, k):
        depth += 1 if m[0] == "/*" else -1
        if depth == 0:
            return m.end()
    return -1


def lex(text: str, language: str) -> Tokens:
    """The tokens of a text in the C-like languages and style sheets."""
    out = Tokens()
    kinds, fresh, at, faults = out.kinds, out.fresh, out.at, out.faults
    match, words = _MASTER[language].match, KEYWORDS.get(language, frozenset())
    js, php, go = language in ("javascript", "typescript"), language == "php", language == "go"
    style, angles = language in ("css", "scss"), language in ("typescript", "rust")
    k, n, new_line = 0, len(text), True
    if php:
        k = _html(text, 0, out)
    elif text.startswith("#!") and not text.startswith("#!["):
        k = text.find("\n") if "\n" in text else n

    def add(kind: str, where: int) -> None:
        kinds.append(kind)
        fresh.append(new_line)
        at.append(where)

    while k < n:
        m = match(text, k)
        group, start, k = m.lastgroup, k, m.end()
        if group == "ws" or group == "lc" or group == "attr":
            if group == "lc" and language == "css":
                faults.append((start, "stray"))
            continue
        if group == "hash" and php:
            continue
        if group == "nl" or group == "bc":
            if group == "nl" or "\n" in m[0]:
                new_line = True
                if go and kinds and kinds[-1] in ("I", "N", "S", ")", "]", "}", "c", "return", "break", "continue", "fallthrough"):
                    add(";", start)
            continue
        if group == "id":
            w = m[0]
            if kinds and kinds[-1] == "." and not (php and w == "class"):
                add("I", start)
            else:
                low = w.lower() if php else w
                add(low if low in words else "I", start)
        elif group == "op":
            s = m[0]
            if js and s in ("/", "/=") and not (kinds and kinds[-1] in _ENDS):
                r = _REGEX.match(text, start)
                if r:
                    add("S", start)
                    k = r.end()
                    if not _pattern_closes(r[0]):
                        faults.append((start, "stray"))
                else:
                    faults.append((start, "stray"))
                    add("o", start)
            elif js and s == "<" and not (kinds and kinds[-1] in _ENDS) and (end := _jsx(text, start, held := [])) > 0:
                # an element is a group of the expressions in it
                add("(", start)
                for a, b in held:
                    part = lex(text[a:b], language)
                    if part.kinds:
                        kinds += [*part.kinds, ","]
                        fresh += [*part.fresh, False]
                        at += [*(a + x for x in part.at), b]
                    faults += [(a + x, cause) for x, cause in part.faults]
                new_line = False
                add(")", end - 1)
                k = end
            elif php and s in ("->", "?->", "::"):
                add(".", start)
            elif php and s == ".":
                add("o", start)
            elif s == "?." or (language == "rust" and s == "::"):
                add("." if s == "?." else "::", start)
            elif s == "|":
                add("bar", start)
            elif s == "<" and angles and start and (_IDENT.match(text, start - 1) or text[start - 1] == ":" or not (kinds and kinds[-1] in _ENDS)):
                add("<t", start)
            elif s == "<<" and language == "rust" and not (kinds and kinds[-1] in _ENDS):
                add("<t", start)
                add("<t", start + 1)
            elif style and s == ":":
                add(":" if k < n and not text[k].isspace() else "k", start)
            else:
                add(_CLASS.get(s, s), start)
        elif group == "br":
            add(m[0], start)
        elif group == "str" or group == "url":
            add("S", start)
        elif group == "num":
            if _IDENT.match(text, k) and language not in ("css", "scss"):
                faults.append((start, "number"))
            add("N", start)
        elif language == "css" and group in ("var", "interp", "place"):
            faults.append((start, "stray"))
            add("?bad", start)
        elif group == "var" or group == "life" or group == "interp" or group == "hash" or group == "at" or group == "place":
            add("@i" if group == "at" and m[0].lower() in _AT_WITH else {"var": "V", "life": "L", "interp": "#{", "hash": "H", "at": "@x", "place": "%x"}[group], start)
        elif group == "cast":
            add("u", start)
        elif group == "tick":
            k = _template(text, start)
            if k < 0:
                faults.append((start, "string"))
                return out
            add("Q", start)
        elif group == "ustr":
            faults.append((start, "string"))
            add("S", start)
            k = n if php else (text.find("\n", start) if "\n" in text[start:] and text[start] != "`" else n)
        elif group == "ubc":
            end = _nested_comment(text, start) if language == "rust" else -1
            if end < 0:
                faults.append((start, "comment"))
                return out
            k = end
            continue
        elif group == "here" or group == "tag" or group == "q":
            end = re.compile(rf"^[ \t]*{m['tag']}\b", re.M).search(text, k)
            if not end:
                faults.append((start, "string"))
                return out
            add("S", start)
            k = end.end()
        elif group == "close":
            add(";", start)
            k = _html(text, k, out)
        elif group == "cdo":
            continue
        else:
            faults.append((start, "stray"))
            add("?bad", start)
        new_line = False
    if go and kinds and kinds[-1] != ";":
        add(";", n)
    return out


def _html(text: str, k: int, out: Tokens) -> int:
    """Passes over text outside <?php ... ?>; a short echo tag counts as echo."""
    m = re.compile(r"<\?(?:php\b|=)", re.I).search(text, k)
    if not m:
        return len(text)
    if m[0] == "<?=":
        out.kinds.append("echo")
        out.fresh.append(True)
        out.at.append(m.start())
    return m.end()


@dataclass
class Line:
    """A logical line: its indent, its tokens and the offset of its first."""

    indent: str
    kinds: list[str]
    at: int


_PY_CLASS = {**dict.fromkeys("** / // % << >> == != <= >= ^".split(), "o"), **dict.fromkeys("+= -= *= /= //= %= **= &= |= ^= <<= >>= @=".split(), "a"), "+": "p", "-": "p", "|": "bar"}


def lex_python(text: str) -> tuple[list[Line], list[tuple[int, str]], str]:
    """(logical lines, faults, brackets): brackets holds all brackets in order, or is empty if they pair up."""
    lines: list[Line] = []
    faults: list[tuple[int, str]] = []
    match, words, pair = _MASTER["python"].match, KEYWORDS["python"], {")": "(", "]": "[", "}": "{"}
    kinds: list[str] = []
    brackets: list[str] = []
    open_: list[str] = []
    k, n, begin, indent, paired = 0, len(text), 0, "", True
    while k < n:
        m = match(text, k)
        group, start, k = m.lastgroup, k, m.end()
        if group == "ws" or group == "lc":
            continue
        if group == "nl":
            if not open_ and kinds:
                lines.append(Line(indent, kinds, begin))
                kinds = []
            continue
        if not kinds and not open_:
            begin = start
            indent = text[text.rfind("\n", 0, start) + 1 : start].replace("\f", "")
        if group == "id":
            member = len(kinds) > 1 and kinds[-1] == "." and kinds[-2] in ("I", "S", "N", ")", "]", "}")
            kinds.append(m[0] if m[0] in words and not member else "N" if m[0] in ("None", "True", "False") and not member else "I")
        elif group == "op":
            kinds.append(_PY_CLASS.get(m[0], m[0]))
        elif group == "str":
            kinds.append("S")
        elif group == "num":
            if _IDENT.match(text, k) and not re.compile(r"(?:if|else|and|or|in|is|for|not)\b").match(text, k):
                faults.append((start, "number"))
            if re.fullmatch(r"0\d*[1-9]\d*", m[0].replace("_", "")):
                faults.append((start, "number"))
            kinds.append("N")
        elif group == "br":
            b = m[0]
            brackets.append(b)
            kinds.append(b)
            if b not in pair:
                open_.append(b)
            elif open_ and open_[-1] == pair[b]:
                open_.pop()
            else:
                paired = False
                if open_:
                    open_.pop()
        elif group == "ustr":
            faults.append((start, "string"))
            kinds.append("S")
            k = n if text.startswith(m[0] * 3, start) else (text.find("\n", start) if "\n" in text[start:] else n)
        else:
            faults.append((start, "stray"))
            kinds.append("?bad")
    if kinds:
        lines.append(Line(indent, kinds, begin))
    return lines, faults, "" if paired and not open_ else "".join(brackets)
