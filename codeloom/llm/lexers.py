"""Token streams for the bundled grammars: kinds (as numbered by the tables), offsets and line-break marks."""

from __future__ import annotations

import re
from functools import lru_cache

from . import grammars
from .glr import END, Tables


class LexError(ValueError):
    """A character sequence that is no token; ``at`` is its offset."""

    def __init__(self, at: int):
        super().__init__(at)
        self.at = at


# Operators by class; what is missing here is a token of its own. Fixed values.
_EC = {
    "BIN": "=== !== == != <= >= && || ?? % ^ << ** /", "SIGN": "+ -", "INC": "++ --",
    "ASSIGN": "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=",
    "": "=> ... ?. ; , . ( ) [ ] { } < > ? : = ! ~ * | & @",
}
_JV = {
    "BIN": "== != <= >= && || % ^ << /", "SIGN": "+ -", "INC": "++ --", "PRE": "! ~",
    "ASSIGN": "+= -= *= /= %= <<= >>= >>>= &= |= ^=", "": "-> :: ... ; , . ( ) [ ] { } < > ? : = * | & @",
}
_CS = {
    "BIN": "== != <= >= && || % /", "SIGN": "+ -", "INC": "++ --", "ASSIGN": "+= -= *= /= %= <<= >>= >>>= &= |= ^= ??=",
    "": "=> -> :: .. ?? ; , . ( ) [ ] { } < > ? : = * | & ^ ~ !",
}
_PY = {
    "BIN": "== != <= >= < > % & ^ << >> //", "SIGN": "+ -", "TILDE": "~",
    "ASSIGN": "+= -= *= /= //= %= **= <<= >>= &= |= ^= @=", "": "-> := ... ; , . ( ) [ ] { } : = * ** / | @",
}

_SPACE = r"[ \t\f\v ﻿  ]+"
_NUM_EC = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?"
_NUM_JV = r"(?:0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?"
_NUM_CS = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)(?:[uU]?[lL]?|[lL][uU]|[fFdDmM])"
_NUM_PY = r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)[jJ]?"
_ID = r"[^\W\d][\w]*"


def _ops(table: dict[str, str]) -> str:
    every = sorted((o for row in table.values() for o in row.split()), key=len, reverse=True)
    return "|".join(map(re.escape, every))


@lru_cache(maxsize=None)
def _kit(lang: str):
    """Tables, the map from spelling to token kind, and the master pattern of a language."""
    t = grammars.tables(lang)
    table, words, lit = {
        "js": (_EC, grammars.JS_RESERVED + grammars.JS_SOFT, ()),
        "ts": (_EC, grammars.JS_RESERVED + grammars.JS_SOFT + grammars.TS_SOFT, ()),
        "tsx": (_EC, grammars.JS_RESERVED + grammars.JS_SOFT + grammars.TS_SOFT, ()),
        "java": (_JV, grammars.JAVA_RESERVED + grammars.JAVA_SOFT, ("true", "false", "null")),
        "cs": (_CS, grammars.CS_RESERVED + grammars.CS_SOFT, ("true", "false", "null")),
        "py": (_PY, grammars.PY_RESERVED + grammars.PY_SOFT, ()),
    }[lang]
    kind: dict[str, int] = {}
    for cls, row in table.items():
        for o in row.split():
            kind[o] = t.terminals.get(cls or o, -1)
    for w in words:
        kind[w] = t.terminals.get("LIT" if w in lit and "LIT" in t.terminals and w not in t.terminals else w, -1)
    for w in lit:
        if "LIT" in t.terminals:
            kind[w] = t.terminals["LIT"]
    ops = _ops(table)
    if lang in ("js", "ts", "tsx"):
        pat = rf"""(?P<w>{_SPACE})|(?P<n>[\r\n]+)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<num>{_NUM_EC}(?![\w$]))
        |(?P<str>"(?:[^"\\\r\n]++|\\(?:\r\n|[\s\S]))*+"|'(?:[^'\\\r\n]++|\\(?:\r\n|[\s\S]))*+')|(?P<c>//[^\r\n]*|/\*[\s\S]*?\*/)
        |(?P<priv>\#[^\W\d][\w$]*)|(?P<op>{ops})"""
    elif lang == "java":
        pat = rf"""(?P<w>{_SPACE})|(?P<n>[\r\n]+)|(?P<id>non-sealed\b|[^\W\d$][\w$]*|\$[\w$]*)|(?P<num>{_NUM_JV}(?![\w$]))
        |(?P<str>\"\"\"[ \t\f]*[\r\n](?:[^\\"]|\\[\s\S]|"(?!""))*\"\"\"|"(?!"")(?:[^"\\\r\n]++|\\.)*+"|""(?!")|'(?:[^'\\\r\n]|\\u+[\da-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)')
        |(?P<c>//[^\r\n]*|/\*[\s\S]*?\*/)|(?P<op>{ops})"""
    elif lang == "cs":
        pat = rf"""(?P<w>{_SPACE})|(?P<n>[\r\n]+)|(?P<id>@?[^\W\d]\w*)|(?P<num>{_NUM_CS}(?!\w))
        |(?P<str>@"(?:[^"]|"")*"|"(?!"")(?:[^"\\\r\n]++|\\.)*+"(?:u8)?|""(?!")|'(?:[^'\\\r\n]|\\u[\da-fA-F]{{4}}|\\x[\da-fA-F]{{1,4}}|\\.)')
        |(?P<c>//[^\r\n]*|/\*[\s\S]*?\*/)|(?P<op>{ops})"""
    else:
        pat = rf"""(?P<w>[ \t\f]+|\\\r?\n)|(?P<n>\r?\n|\r)|(?P<str>(?:[rRuUbBfF]|[rR][bBfF]|[bBfF][rR])?(?:\"\"\"(?:[^\\"]|\\[\s\S]|"(?!""))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''
        |"(?!"")(?:[^"\\\r\n]++|\\(?:\r\n|[\s\S]))*+"|""(?!")|'(?!'')(?:[^'\\\r\n]++|\\(?:\r\n|[\s\S]))*+'|''(?!')))
        |(?P<id>[^\W\d]\w*)|(?P<num>{_NUM_PY}(?=(?:and|else|for|if|in|is|not|or)\b|\W|\Z))|(?P<c>\#[^\r\n]*)|(?P<op>{ops})"""
    return t, kind, re.compile(pat, re.X)


_TPL = re.compile(r"[^`\\$]+|\\[\s\S]|\$(?!\{)|(?P<end>`)|(?P<open>\$\{)")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[a-z]*")


class Holes(list):
    """Embedded expressions of a text, as (kinds, starts, line breaks) of sentences that the tables recognise."""

    def add(self, t: Tables, kinds: list[int], starts: list[int], breaks: list[bool] | None, before: tuple[str, ...] = (), after: tuple[str, ...] = (";",)) -> None:
        """Puts a hole's tokens, END included, into brackets, between the tokens that make a statement of it."""
        head, tail = [*(t.terminals[x] for x in before), t.terminals["("]], [t.terminals[")"], *(t.terminals[x] for x in after)]
        at, end = starts[0], starts[-1]
        line = None if breaks is None else [False] * len(head) + breaks[:-1] + [False] * len(tail) + [True]
        self.append((head + kinds[:-1] + tail + [0], [at] * len(head) + starts[:-1] + [end] * (len(tail) + 1), line))


def _ecma_hole(text: str, at: int, lang: str, holes: Holes | None, need: bool, spread: bool = False) -> int:
    """Offset behind the brace that closes the one before ``at``; the expression between is put to the holes.  ``need``: it may not be empty; ``spread``: it may follow three dots."""
    stop: list[int] = []
    kinds, starts, breaks = ecma(text, lang, start=at, holes=holes, stop=stop)
    t = grammars.tables(lang)
    if spread and kinds[0] == t.terminals["..."]:
        kinds, starts, breaks, need = kinds[1:], starts[1:], breaks[1:], True
    if len(kinds) == 1 and need:
        raise LexError(starts[0])
    if len(kinds) > 1 and holes is not None:
        holes.add(t, kinds, starts, breaks)
    return stop[0]


def _template(text: str, at: int, lang: str, holes: Holes | None) -> int:
    """Offset behind the back tick that ends the template whose first one is before ``at``."""
    while True:
        m = _TPL.match(text, at)
        if m is None:
            raise LexError(at)
        at = m.end()
        if m.lastgroup == "end":
            return at
        if m.lastgroup == "open":
            at = _ecma_hole(text, at, lang, holes, True)


_JSX_OPEN = re.compile(r"<\s*(?:(?P<name>[A-Za-z_$][\w$.:-]*)|(?=>))")
_JSX_ATTR = re.compile(
    r"""\s+|/\*[\s\S]*?\*/|//[^\n]*|(?P<end>/\s*>)|(?P<gt>>)|(?P<brace>\{)|(?P<attr>[A-Za-z_$][\w$:.-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|(?P<val>\{)|(?P<el>(?=<))))?)"""
)
_JSX_TEXT = re.compile(r"[^<{}>]+|(?P<brace>\{)|(?P<close><\s*/\s*(?P<name>[\w$.:-]*)\s*>)|(?P<el>(?=<))")


def _jsx(text: str, at: int, lang: str, holes: Holes | None) -> int:
    """Offset behind the JSX element that starts at ``at``; embedded expressions go to the holes: as attributes they must be there, as children they may be empty."""
    open_tags: list[str] = []
    while True:
        m = _JSX_OPEN.match(text, at)
        if m is None:
            raise LexError(at)
        name, at = m.group("name") or "", m.end()
        while True:
            m = _JSX_ATTR.match(text, at)
            if m is None:
                raise LexError(at)
            at = m.end()
            if m.group("brace") or m.group("val"):
                at = _ecma_hole(text, at, lang, holes, True, spread=bool(m.group("brace")))
            elif m.group("el") is not None:
                at = _jsx(text, at, lang, holes)
            elif m.group("end"):
                break
            elif m.group("gt"):
                open_tags.append(name)
                break
        while open_tags:
            m = _JSX_TEXT.match(text, at)
            if m is None:
                raise LexError(at)
            at = m.end()
            if m.group("brace"):
                at = _ecma_hole(text, at, lang, holes, False, spread=True)
            elif m.group("close"):
                if open_tags.pop() != m.group("name"):
                    raise LexError(m.start())
            elif m.group("el") is not None:
                break
        if not open_tags:
            return at


_OPERAND_END = {")", "]", "}", "this", "super", "null", "true", "false", "++", "--"}


def _resume(text: str, at: int) -> int:
    """Where to go on behind a character sequence that is no token: the next line."""
    end = text.find("\n", at)
    return len(text) if end < 0 else end + 1


def ecma(text: str, lang: str, notes: list | None = None, tolerant: bool = False, start: int = 0, holes: Holes | None = None, stop: list | None = None) -> tuple[list[int], list[int], list[bool]]:
    """JavaScript and TypeScript.  ``notes`` collects (index of the next token, start, end) of comments;
    ``tolerant`` puts a token -1 where no token fits and goes on at the next line.  ``holes`` collects
    embedded expressions.  With ``stop`` the text from ``start`` is one, up to the brace that closes it,
    behind which ``stop`` is put."""
    t, kind, master = _kit(lang)
    match, term = master.match, t.terminals
    ID, NUM, STR, TPL, REGEX, JSX, PRIV, PREINC = (term.get(k, -1) for k in ("ID", "NUM", "STR", "TPL", "REGEX", "JSX", "PRIVATE", "PREINC"))
    kinds, starts, breaks = [], [], []
    pos, n, nl, operand, depth = start, len(text), False, False, 0
    if text.startswith("#!") and not start:
        pos = (text + "\n").index("\n")
    reserved = set(grammars.JS_RESERVED)
    while pos < n:
        try:
            ch = text[pos]
            if ch == "`":
                end, k, after = _template(text, pos + 1, lang, holes), TPL, True
            elif ch == "/" and not operand and text[pos + 1 : pos + 2] not in ("/", "*"):
                m = _REGEX.match(text, pos)
                if m is None:
                    raise LexError(pos)
                end, k, after = m.end(), REGEX, True
            elif ch == "<" and lang != "ts" and not operand and re.match(r"<\s*(?:[A-Za-z_$]|>)", text[pos : pos + 40]) and not re.match(r"<\s*[\w$]+\s*(?:,|\bextends\b)", text[pos : pos + 80]):
                end, k, after = _jsx(text, pos, lang, holes), JSX, True
            else:
                m = match(text, pos)
                if m is None:
                    raise LexError(pos)
                g, end = m.lastgroup, m.end()
                if g == "w":
                    pos = end
                    continue
                if g == "n":
                    nl, pos = True, end
                    continue
                if g == "c":
                    if notes is not None:
                        notes.append((len(kinds), pos, end))
                    if "\n" in m.group():
                        nl = True
                    pos = end
                    continue
                if g == "id":
                    s = m.group()
                    k = kind.get(s, ID)
                    after = s not in reserved or s in _OPERAND_END
                elif g == "op":
                    s = m.group()
                    if stop is not None and s in "{}":
                        depth += 1 if s == "{" else -1
                        if depth < 0:
                            stop.append(end)
                            break
                    if s == "?." and text[end : end + 1].isdigit():
                        s, end = "?", end - 1
                    k = PREINC if nl and s in ("++", "--") else kind[s]  # no line break before a postfix operator
                    after = s in _OPERAND_END and k != PREINC
                elif g == "num":
                    k, after = NUM, True
                elif g == "str":
                    k, after = STR, True
                else:
                    k, after = PRIV, True
            if k < 0:
                raise LexError(pos)
            kinds.append(k)
            starts.append(pos)
            breaks.append(nl)
            nl, operand, pos = False, after, end
        except (LexError, RecursionError) as e:  # templates nested without end are no token either
            at = getattr(e, "at", pos)
            if not tolerant:
                raise LexError(at) from None
            kinds.append(-1)
            starts.append(pos)
            breaks.append(nl)
            nl, operand, pos = True, False, _resume(text, max(pos, at if at < n else pos))
    else:
        if stop is not None:
            raise LexError(n)
    kinds.append(term[END])
    starts.append(pos if stop else n)
    breaks.append(True)
    return kinds, starts, breaks


_CS_INTERP = re.compile(r"""(?:\$+@?|@\$)(?="")(?P<raw>"{3,})|(?P<verb>\$@"|@\$")|(?P<plain>\$")|(?P<raw2>"{3,})""")


def _cs_hole(text: str, at: int, holes: Holes | None, braces: int = 1) -> int:
    """Offset behind the braces that close the hole whose opening ones are before ``at``: an expression, after a comma its width, after a colon its format."""
    t = grammars.tables("cs")
    while True:
        stop: list[int] = []
        kinds, starts, _ = curly(text, "cs", start=at, holes=holes, stop=stop)
        if len(kinds) == 1:
            raise LexError(starts[0])
        if holes is not None:
            holes.add(t, kinds, starts, None, ("ID", "="))
        at, ch = stop[0], text[stop[0] - 1]
        if ch == ",":
            continue
        if ch == ":":
            end = text.find("}", at)
            if end < 0:
                raise LexError(at)
            at = end + 1
        if text[at - 1 : at - 1 + braces] != "}" * braces:
            raise LexError(at)
        return at - 1 + braces


def _cs_string(text: str, at: int, holes: Holes | None) -> int:
    """Offset behind an interpolated or raw string at ``at``, or -1 if there is none."""
    m = _CS_INTERP.match(text, at)
    if m is None:
        return -1
    i, n = m.end(), len(text)
    if m.group("raw") or m.group("raw2"):
        q = m.group("raw") or m.group("raw2")
        braces = m.group().count("$") if m.group("raw") else 0
        while True:
            end = text.find(q, i)
            if end < 0:
                raise LexError(at)
            hole = text.find("{" * braces, i, end) if braces else -1
            if hole < 0:
                return end + len(q)
            while text.startswith("{", hole + braces):  # of more braces the last open the hole
                hole += 1
            i = _cs_hole(text, hole + braces, holes, braces)
    verb = bool(m.group("verb"))
    while i < n:
        ch = text[i]
        if ch == '"':
            if verb and text[i + 1 : i + 2] == '"':
                i += 2
                continue
            return i + 1
        if ch == "\\" and not verb:
            i += 2
        elif ch == "{":
            if text[i + 1 : i + 2] == "{":
                i += 2
            else:
                i = _cs_hole(text, i + 1, holes)
        elif ch in "\r\n" and not verb:
            break
        else:
            i += 1
    raise LexError(at)


def curly(text: str, lang: str, notes: list | None = None, tolerant: bool = False, start: int = 0, holes: Holes | None = None, stop: list | None = None) -> tuple[list[int], list[int], None]:
    """Java and C#; the other parameters as in ``ecma``; a C# hole also ends at a comma or colon outside of brackets."""
    t, kind, master = _kit(lang)
    match, term = master.match, t.terminals
    ID, LIT = term["ID"], term["LIT"]
    kinds, starts = [], []
    pos, n, fresh, depth = start, len(text), stop is None, 0
    if text[:1] == "\ufeff" and not start:
        pos = 1
    cs = lang == "cs"
    while pos < n:
        try:
            if cs:
                ch = text[pos]
                if ch in '$@"' and (end := _cs_string(text, pos, holes)) > 0:
                    kinds.append(LIT)
                    starts.append(pos)
                    pos, fresh = end, False
                    continue
                if ch == "#" and fresh:
                    pos = (text + "\n").index("\n", pos)
                    continue
            m = match(text, pos)
            if m is None:
                raise LexError(pos)
            g = m.lastgroup
            if g == "n":
                fresh = True
            elif g == "c":
                if notes is not None:
                    notes.append((len(kinds), pos, m.end()))
            elif g != "w":
                if g == "op":
                    k = kind[m.group()]
                    if stop is not None:
                        if m.group() in ("(", "[", "{"):
                            depth += 1
                        elif not depth and m.group() in ("}", ",", ":"):
                            stop.append(m.end())
                            break
                        elif m.group() in (")", "]", "}"):
                            depth -= 1
                elif g == "id":
                    k = kind.get(m.group(), ID)
                else:
                    k = LIT
                if k < 0:
                    raise LexError(pos)
                kinds.append(k)
                starts.append(pos)
                fresh = False
            pos = m.end()
        except (LexError, RecursionError) as e:
            at = getattr(e, "at", pos)
            if not tolerant:
                raise LexError(at) from None
            kinds.append(-1)
            starts.append(pos)
            pos, fresh = _resume(text, max(pos, at if at < n else pos)), True
    else:
        if stop is not None:
            raise LexError(n)
    kinds.append(term[END])
    starts.append(pos if stop else n)
    return kinds, starts, None


_LEADING_ZERO = re.compile(r"0[\d_]*[1-9][\d_]*")
_F_OPEN = re.compile(r"(?:[fF][rR]?|[rR][fF])(\"\"\"|\'\'\'|\"|\')")


def _f_field(text: str, at: int, holes: Holes | None, quote: str) -> int:
    """Offset behind the brace that closes the field whose opening one is before ``at``: an expression, perhaps = behind it, a conversion and a format, which may hold fields."""
    stop: list[int] = []
    kinds, starts, _ = python(text, start=at, holes=holes, stop=stop)
    t = grammars.tables("py")
    if len(kinds) > 2 and kinds[-2] == t.terminals["="]:
        del kinds[-2], starts[-2]
    if len(kinds) == 1:
        raise LexError(starts[0])
    if holes is not None:
        holes.add(t, kinds, starts, None, (), ("NL",))
    at = stop[0]
    if text[at - 1] == "!":
        m = re.compile(r"[rsa]\s*([:}])").match(text, at)
        if m is None:
            raise LexError(at)
        at = m.end()
    if text[at - 1] == "}":
        return at
    while at < len(text):
        ch = text[at]
        if ch == "{":
            at = _f_field(text, at + 1, holes, quote)
        elif ch == "}":
            return at + 1
        elif text.startswith(quote, at) or ch in "\r\n" and len(quote) == 1:
            break
        else:
            at += 1
    raise LexError(at)


def _f_string(text: str, m: re.Match, holes: Holes | None) -> int:
    """Offset behind the formatted string that ``m`` opens."""
    quote, at = m.group(1), m.end()
    while at < len(text):
        ch = text[at]
        if ch == "\\":
            at += 2
        elif text.startswith(quote, at):
            return at + len(quote)
        elif ch == "{":
            at = at + 2 if text.startswith("{{", at) else _f_field(text, at + 1, holes, quote)
        elif ch == "}":
            if not text.startswith("}}", at):
                break
            at += 2
        elif ch in "\r\n" and len(quote) == 1:
            break
        else:
            at += 1
    raise LexError(min(at, len(text)))


def python(text: str, lang: str = "py", notes: list | None = None, tolerant: bool = False, start: int = 0, holes: Holes | None = None, stop: list | None = None) -> tuple[list[int], list[int], None]:
    """Python, with NL, INDENT and DEDENT tokens as its language reference lays down; ``holes`` and ``stop`` as in ``ecma``, for the fields of formatted strings, which also end at a colon or an exclamation mark."""
    t, kind, master = _kit("py")
    match, term = master.match, t.terminals
    ID, NUM, STR, NL, IN, DE = (term[k] for k in ("ID", "NUM", "STR", "NL", "INDENT", "DEDENT"))
    kinds, starts = [], []
    pos, n, depth, fresh, levels = start or int(text[:1] == "\ufeff"), len(text), int(stop is not None), stop is None, [0]
    blank = re.compile(r"[ \t\f]*(?:#[^\r\n]*)?(?:\r?\n|\r|\Z)")
    while pos < n:
        try:
            if fresh and not depth:
                b = blank.match(text, pos)
                if b:
                    pos = b.end()
                    if b.end() == b.start():
                        break
                    continue
                lead = re.compile(r"[ \t\f]*").match(text, pos)
                width = len(lead.group().replace("\f", "").expandtabs(8))
                pos = lead.end()
                if width > levels[-1]:
                    levels.append(width)
                    kinds.append(IN)
                    starts.append(pos)
                while width < levels[-1]:
                    levels.pop()
                    kinds.append(DE)
                    starts.append(pos)
                if width != levels[-1]:
                    raise LexError(pos)
                fresh = False
            if text[pos] in "fFrR" and (m := _F_OPEN.match(text, pos)):
                kinds.append(STR)
                starts.append(pos)
                pos = _f_string(text, m, holes)
                continue
            if stop is not None and depth == 1 and (text[pos] in "}:" or text[pos] == "!" and text[pos + 1 : pos + 2] != "="):
                stop.append(pos + 1)
                break
            m = match(text, pos)
            if m is None:
                raise LexError(pos)
            g = m.lastgroup
            if tolerant and depth and g == "id" and m.group() in ("def", "class") and (own := re.compile(r"[ \t\f]*(?:async[ \t]+)?").fullmatch(text, text.rfind("\n", 0, pos) + 1, pos)):
                # no bracket holds a statement: one was left open before
                pos, fresh, depth = own.start(), True, 0
                width = len(re.match(r"[ \t\f]*", own.group()).group().replace("\f", "").expandtabs(8))
                levels[:] = sorted({0, width, *(x for x in levels if x < width)})
                kinds.append(-1)
                starts.append(pos)
                continue
            if g == "n":
                if not depth:
                    kinds.append(NL)
                    starts.append(pos)
                    fresh = True
            elif g != "w" and g != "c":
                s = m.group()
                if g == "op":
                    k = kind[s]
                    if s in "([{":
                        depth += 1
                    elif s in ")]}":
                        depth = max(0, depth - 1)
                elif g == "id":
                    k = kind.get(s, ID)
                else:
                    k = NUM if g == "num" else STR
                    if k == NUM and _LEADING_ZERO.fullmatch(s):
                        raise LexError(pos)
                kinds.append(k)
                starts.append(pos)
            pos = m.end()
        except LexError as e:
            if not tolerant:
                raise
            kinds.append(-1)
            starts.append(pos)
            pos, fresh, depth = _resume(text, max(pos, e.at)), True, 0
            levels[:] = sorted({*levels})
    if stop is not None:
        if not stop:
            raise LexError(n)
        return [*kinds, term[END]], [*starts, pos], None
    if kinds and not fresh:
        kinds.append(NL)
        starts.append(n)
    for _ in levels[1:]:
        kinds.append(DE)
        starts.append(n)
    kinds.append(term[END])
    starts.append(n)
    return kinds, starts, None


def first_error(text: str, lang: str) -> int:
    """-1 if ``text`` is a program of ``lang``, else the offset of its first unrecoverable token; embedded expressions count as the rest."""
    t: Tables = grammars.tables(lang)
    holes, first = Holes(), -1
    try:
        kinds, starts, breaks = (ecma if lang in ("js", "ts", "tsx") else python if lang == "py" else curly)(text, lang, holes=holes)
    except LexError as e:
        return e.at
    except RecursionError:  # expressions embedded in one another without end: no program that a parser takes
        return 0
    closers = frozenset((0, t.terminals["}"]))
    for kinds, starts, breaks in [(kinds, starts, breaks), *holes]:
        bad = t.recognise(kinds, breaks, closers)
        if bad >= 0 and (first < 0 or starts[bad] < first):
            first = starts[bad]
    return first
