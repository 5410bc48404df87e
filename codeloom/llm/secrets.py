"""Credentials in texts: detection regexes, the trigrams that they need, verification and redaction.

The trigrams are derived from the regexes (``required_trigrams``): every match of a regex contains all
trigrams of at least one of its alternatives.  ``gram_rows`` gives a text's postings, chunk by chunk;
``sourcefiles`` keeps them as a table of the whole collection and intersects it, so that ``verify``
runs a rule on a text only if the index holds all trigrams of one of the rule's alternatives for it.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

try:  # the regex parser has moved between versions
    from re import _constants as sre_c
    from re import _parser as sre_p
except ImportError:  # pragma: no cover
    import sre_constants as sre_c
    import sre_parse as sre_p

# Detection regexes; each but the last two finds the value itself. Fixed values.
RULES: dict[str, str] = {
    "key_id": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "provider": r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|npm_[A-Za-z0-9]{20,}|(?:sk|rk|tkn|pk)_(?:live|test)_[A-Za-z0-9]{16,}|xox[abeprs]-[A-Za-z0-9-]{16,}"
    r"|SG\.[\w.-]{20,}|(?:key|pat)-[A-Za-z0-9]{20,}|glpat-[\w-]{20,}|AIza[\w-]{30,})",
    "jwt": r"(?<![A-Za-z0-9])eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}",
    "pem": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----",
    "address": r"(?<![A-Za-z0-9])[A-Za-z][\w+.-]*(?::[A-Za-z]\w*)?://[^\s:/@\"'`<>{}$]*:[^\s/@\"'`<>{}$]+@[\w.-]+",
    "connection": r"(?i)(?<=;)\s*(?:password|pwd)\s*=\s*[^;\"'\s]+",
    "basic": r"(?i:\bbasic)\s+[A-Za-z0-9+/]{8,}={0,2}",
    "bearer": r"(?i:\bbearer)\s+[A-Za-z0-9_.~+/=-]{16,}",
    "header": r"(?i)(?:x-auth|x-api-key|x-token|authorization|api-key|private-token)[\w-]*[\"']?\s*:\s*[\"']?(?P<v>[^\s'\"]{6,})",
    "encoded": r"(?<![A-Za-z0-9+/])(?:QUtJQ|QVNJQ|Z2hwX|bnBtX|c2tf|dGtuX|eG94|U0cu|a2V5L|cGF0L|Z2xwYXQt|ZXlK|LS0tLS1CRUdJTiB)[A-Za-z0-9+/]{12,}={0,2}",
    "named": r"(?i)pass|pwd|kennwort|mot_?\W?de|contrase|clave|secret|token|refresh\W?_?tok|api\W?_?key|master\W?_?key|signing\W?_?key|access\W?_?key|private\W?_?key|encryption\W?_?key"
    r"|client\W?_?key|key\W?_?id|aws\W?_?key|tls\W?_?key|deploy\W?_?key|account\W?_?key|service\W?_?key|bearer|cred|login|hmac|salt|user\W?_?pw|_pw|root\W?_?pw|admin\W?_?pw|dbpw|db[.-]pw|authori[sz]ation",
}
_NAME = re.compile(r"[A-Za-z_$][\w$.\-]*")
_SPLIT = re.compile(r"([a-z0-9])([A-Z])")
# Words of names that hold credentials, and of names that only speak of them. Fixed values.
_CRED_NAME = re.compile(
    r"(?:^|_)(?:pass|passwd|passwort|password|passphrase|pwd|pw|kennwort|mot_de_passe|contrasena|clave|secret|token|tok|bearer|creds?|credentials?|login|salt|hmac|authorization"
    r"|(?:api|master|signing|access|private|encryption|client|aws|tls|deploy|account|service|root)_?key|key_?id)\d*(?:_|$)"
    r"|(?:root|admin|user|ftp|smtp|db|keystore|service)(?:pass|pw|login)\d*(?:_|$)|[a-z](?:passwd|password|pwd|secret|token|creds?)\d*(?:_|$)"
)
_OTHER_NAME = re.compile(
    r"(?:^|_)(?:label|hint|question|header|ttl|length|len|min|max|days|rotation|enabled|public|pub|cert|certificate|checksum|integrity|icon|logo|uuid|request|correlation|sha|hash|etag|url|uri|endpoint"
    r"|path|file|type|expiry|expires|expiration|count|limit|size|timeout|prefix|pattern|regex|manager|title|placeholder|message|help|policy|field|column|attempts|retries|rounds|strength)\d*(?:_|$)"
)
_NOT_ONE = re.compile(r"(?:^|_)(?:public|pub|cert|certificate|label|hint|hash|sha|checksum|icon|logo|min|max|title|placeholder|help|policy|request|correlation)\d*(?:_|$)")
_OPENS = (
    r"^(?:\$|\{|<|%\(|%[A-Z_]+%$|@@|\[|vault:|ENC\(|enc:|encrypted|arn:|ssm:|aws:|env:|file:|secretsmanager|ref\+|op://|keyring:|kms:|cipher|sops|AES\d*[:(]|\{cipher\}"
    r"|sha\d+[-:]|md5[-:]|ssh-(?:ed25519|rsa|dss)|ecdsa-|data:|-----BEGIN|\$2[aby]\$|argon2|pbkdf2|process\.env|os\.environ|getenv)"
    r"|^(?:x+|\*+|\.+|-+|_+|#+|•+|\?+|0+|1234567?8?9?0?)$|^(?:none|null|nil|undefined|true|false|yes|no|default|test|sample|foo|bar|password|passwort|secret|token|n/a|tbd|empty)$"
)
_HOLDS = r"change.?me|replace|your[-_ .]|[-_ .]here\b|example(?!\.)|dummy|place.?holder|todo|fixme|redact|mask|not.?set|unset|insert|fill.?in|<.*>|\$\{|\{\{|x{4,}|\*{3,}"
_PLACEHOLDER = re.compile(f"{_OPENS}|{_HOLDS}", re.I)
_LONG_PLACEHOLDER = re.compile(rf"{_OPENS}|(?<![A-Za-z0-9])(?:{_HOLDS})(?![A-Za-z0-9])", re.I)
_PATH = re.compile(r"(?:\.{0,2}|~)/[^+=]*")
_DENSE = re.compile(r"(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[a-z])(?=[A-Za-z0-9]*[A-Z])[A-Za-z0-9]{12}")  # no word of a path
LONG = 256  # characters from which a value holds short words by chance: there only whole words mark a placeholder
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)
_JOIN = re.compile(r"([\"'`])[ \t]*(?:\+|\.\.|\\)?[ \t]*\\?(?:\r?\n[ \t]*)?(?:\+[ \t]*)?\1")
_SETTINGS = re.compile(r"(?:[\w .]++=[^;\"'\n=]*;[ \t]*)+$")
_JOIN_OP = re.compile(r"[+\\]")
_LITERAL = re.compile(r"\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)'|`((?:\\.|[^`\\\n])*)`")
_CODE_EXT = frozenset("js jsx ts tsx mjs cjs py java cs go rb php kt scala c h cpp rs swift sh".split())
_COMMENT = re.compile(r"^\s*(?://|#|/?\*|--|<!--|;)")
_OPEN_CODE = re.compile(r"[\"'`\]]*\s*(?::\s*[\w<>\[\], ]+?\s*)?(?:=|:|\|\||\?\?|\(|=\s*\()\s*")
_OPEN_BLOCK = re.compile(r"[\"'`\]]*\s*:\s*[|>][+-]?\s*")
_CONFIG = re.compile(r"^\W*(?:(?:ENV|ARG|export|set|LABEL)\s+)?[\"'`]?(?P<n>[A-Za-z_][\w.\-]*)[\"'`]?\s*(?:=|:|\s)\s*(?P<v>\S.*?)?\s*$")


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", _SPLIT.sub(r"\1_\2", name).lower()).strip("_")


def credential_name(name: str) -> bool:
    s = snake(name)
    hits = list(_CRED_NAME.finditer(s))
    # what stands behind the credential's word tells what of it is meant; before it, only that it is public or of no use
    return bool(hits) and not _OTHER_NAME.search(s, max(0, hits[-1].end() - 1)) and not _NOT_ONE.search(s, 0, hits[-1].start() + 1)


def secretish(v: str) -> bool:
    """True for a value that a credential name can hold as a working secret."""
    v = v.strip().strip("\"'`")
    if len(v) < 6 or any(ch.isspace() for ch in v) or (_PLACEHOLDER if len(v) < LONG else _LONG_PLACEHOLDER).search(v):
        return False
    if "://" in v or _PATH.fullmatch(v) and not _DENSE.search(v) or _UUID.fullmatch(v) or "(" in v or v.endswith((")", ";")):
        return False
    if not re.search(r"\d", v):
        letters = re.sub(r"[^A-Za-z]", "", v)
        mixed = re.search(r"[a-z][A-Z]", v) or re.match(r"[^A-Z]*+[A-Z][^a-z]*+[a-z][^A-Z]*+[A-Z]", v)
        if not letters or not (re.search(r"[^\w.\-]", v) and len(v) >= 8 or mixed and len(v) >= 8):
            return False
        if re.fullmatch(r"[A-Z][a-z]+(?:-[A-Z][a-z]+)*", v):
            return False
    elif re.fullmatch(r"[\d.,:+-]+", v):
        return False
    if credential_name(v) and re.fullmatch(r"[A-Za-z]+(?:[_.\-][A-Za-z]+)*\d?", v):
        return False
    return not re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", v)


def _b64(s: str) -> str | None:
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True).decode("utf-8")
    except (ValueError, UnicodeDecodeError):
        return None


# --- joined view of a text ------------------------------------------------------------------------


def joined(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with string literals that are concatenated over ``+`` or line ends put together, and (offset in it, offset in the text) of each piece."""
    out, pieces, last, size = [], [(0, 0)], 0, 0
    for m in _JOIN.finditer(text):
        inner = m.group()[1:-1]
        if not _JOIN_OP.search(inner):
            continue
        if m.start() < last:
            continue
        out.append(text[last : m.start()])
        size += m.start() - last
        last = m.end()
        pieces.append((size, last))
    out.append(text[last:])
    return "".join(out), pieces


def _original(pieces: list[tuple[int, int]], at: int) -> int:
    import bisect

    k = bisect.bisect_right(pieces, (at, 1 << 60)) - 1
    return pieces[k][1] + at - pieces[k][0]


# --- verification ---------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def _compiled() -> dict[str, re.Pattern]:
    return {k: re.compile(v) for k, v in RULES.items()}


def _address_secret(v: str) -> bool:
    user, _, rest = v.partition("://")[2].partition(":")
    pw = rest.rsplit("@", 1)[0]
    return len(pw) >= 3 and not _PLACEHOLDER.search(pw) and not re.fullmatch(r"\d{1,5}", pw) and pw.lower() not in ("pass", "password", "pwd", "secret", "user", "geheim")


_KEY_JOINT = r"(?:\\[rn]|[\s\"'+`,;|\\>*#/-])*+"
_KEY_BEGINS = re.compile(rf"{_KEY_JOINT}(?:[A-Za-z0-9/+=]{_KEY_JOINT}){{24}}")
_KEY_GOES_ON = re.compile(rf"(?:(?:\\[rn]|[\s\"'+`,;|\\])*+[A-Za-z0-9/+=]{{16,}}+)*+")
_KEY_ENDS = re.compile(r"-----END [A-Z0-9 ]*-----")


def _key_block(text: str, at: int) -> int:
    """End of the key block whose BEGIN line ends ``at``: behind its END line, or of its lines where that is missing; -1 without a key."""
    end = text.find("-----END", at)
    if not _KEY_BEGINS.match(text, at, end if end >= 0 else len(text)):
        return -1
    close = _KEY_ENDS.match(text, end) if end >= 0 and text.find("-----BEGIN", at, end) < 0 else None
    return close.end() if close else _KEY_GOES_ON.match(text, at).end()


def verify(text: str, rules, ext: str) -> list[tuple[int, int, str]]:
    """(start, end, rule) of each credential in a (joined) text, by the given candidate rules."""
    rx, spans = _compiled(), []
    for rule in rules:
        if rule == "named":
            continue
        for m in rx[rule].finditer(text):
            a, b = m.span("v") if "v" in m.re.groupindex else m.span()
            v = text[a:b]
            if rule in ("key_id", "provider", "jwt"):
                if _PLACEHOLDER.search(v) and not rule == "jwt" and re.search(r"x{4,}|example|your", v, re.I):
                    continue
            elif rule == "pem":
                end = -1 if "ENCRYPTED" in v else _key_block(text, b)
                if end < 0:
                    continue
                b = end
            elif rule == "address":
                if not _address_secret(v):
                    continue
            elif rule == "connection":
                pw = re.split(r"(?i)(?:password|pwd)\s*=\s*", v)[-1]
                if _PLACEHOLDER.search(pw) or len(pw) < 4:
                    continue
                # the address begins with the settings before the password
                before = _SETTINGS.search(text[1 + max(text.rfind(ch, 0, a) for ch in "\"'\n") : a])
                a -= len(before.group().lstrip()) if before else 0
                a += len(text[a:b]) - len(text[a:b].lstrip())
            elif rule == "basic":
                plain_text = _b64(v.split()[-1])
                if not plain_text or ":" not in plain_text or _PLACEHOLDER.search(plain_text.split(":", 1)[1]):
                    continue
            elif rule == "bearer":
                if not secretish(v.split()[-1]) or not re.search(r"\d", v):
                    continue
            elif rule == "header":
                if v.lower() in ("basic", "bearer") or not secretish(v):
                    continue
            elif rule == "encoded":
                plain_text = _b64(v)
                if not plain_text or not any(rx[k].match(plain_text) for k in ("key_id", "provider", "jwt", "pem")):
                    continue
            spans.append((a, b, rule))
    if "named" in rules:
        gate = rx["named"]
        code = ext in _CODE_EXT
        lines = text.split("\n")
        at = 0
        for i, line in enumerate(lines):
            start, at = at, at + len(line) + 1
            if not gate.search(line):
                continue
            names = [m for m in _NAME.finditer(line) if gate.search(m.group()) and credential_name(m.group().rstrip(".-"))]
            if not names:
                continue
            first = names[0].end()
            if names[0].start() and line[names[0].start() - 1] in "\"'`" and line[first : first + 1] == line[names[0].start() - 1]:
                first += 1  # a quoted name: its closing quote opens no value
            if _COMMENT.match(line) and (code or "=" not in line or line.lstrip().startswith(("//", "*"))):
                for m in re.compile(r"\S+").finditer(line, first):
                    a, b = m.span()
                    while b > a and line[b - 1] in ";:.,)'\"`]}":
                        b -= 1
                    while a < b and line[a] in "('\"`[{":
                        a += 1
                    tok = line[a:b]
                    if len(tok) >= 8 and "(" not in tok and secretish(tok) and "=" not in tok.rstrip("=")[:-1]:
                        spans.append((start + a, start + b, "named"))
                continue
            rest, offset = line[first:], start + first
            if i + 1 < len(lines) and (_OPEN_CODE if code else _OPEN_BLOCK).fullmatch(rest.rstrip("\r")):
                rest = rest + "\n" + lines[i + 1]
            found = False
            for m in _LITERAL.finditer(rest):
                k = m.lastindex
                if secretish(m.group(k)):
                    spans.append((offset + m.start(k), offset + m.end(k), "named"))
                found = True
            if not found and not code:
                m = _CONFIG.match(line)
                if m and m.group("v") and credential_name(m.group("n")):
                    if secretish(m.group("v")):
                        spans.append((start + m.start("v"), start + m.end("v"), "named"))
                elif "\n" in rest:
                    v = rest.split("\n", 1)[1].strip()
                    if secretish(v):
                        k = rest.index("\n") + 1 + rest.split("\n", 1)[1].index(v)
                        spans.append((offset + k, offset + k + len(v), "named"))
            if code and not found:
                m = re.search(r"\$\{[\w.]+:([^}]*)\}", line)
                if m and secretish(m.group(1)):
                    spans.append((start + m.start(1), start + m.end(1), "named"))
            for m in re.finditer(r"\$\{([\w.]+):([^}\"']*)\}", line):
                if credential_name(m.group(1)) and secretish(m.group(2)):
                    spans.append((start + m.start(2), start + m.end(2), "named"))
    return spans


def _merge(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping spans put together under the rule of the first."""
    out: list[tuple[int, int, str]] = []
    for a, b, r in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, r))
    return out


# --- trigrams -------------------------------------------------------------------------------------


def _alternatives(tree, most: int = 512) -> list[tuple[str, ...]]:
    """Literal runs that every match of a parsed regex must hold, one tuple for each alternative; a NUL breaks a run."""
    alts = [""]
    for op, arg in tree:
        if op is sre_c.LITERAL:
            part = [chr(arg)]
        elif op is sre_c.IN:
            chars = [chr(a) for o, a in arg if o is sre_c.LITERAL]
            part = chars if len(chars) == len(arg) <= 6 else ["\0"]
        elif op is sre_c.BRANCH:
            part = [x for b in arg[1] for x in _alternatives(b, most)]
        elif op is sre_c.SUBPATTERN:
            part = _alternatives(arg[3], most)
        elif op in (sre_c.MAX_REPEAT, sre_c.MIN_REPEAT):
            low, high, sub = arg
            inner = _alternatives(sub, most)
            part = ["", *inner] if (low, high) == (0, 1) else inner if (low, high) == (1, 1) else [x + "\0" for x in inner] if low >= 1 and len(inner) <= 4 else ["\0"]
        elif op in (sre_c.ASSERT, sre_c.ASSERT_NOT, sre_c.AT):
            continue
        else:
            part = ["\0"]
        if len(alts) * len(part) > most:
            alts = [a + "\0" for a in alts]
        else:
            alts = [a + p for a in alts for p in part]
    return alts


def required_trigrams(pattern: str) -> list[frozenset[int]] | None:
    """Each match, in lower case, holds all trigrams of one of these sets; None if nothing can be derived."""
    out: set[frozenset[int]] = set()
    for alt in _alternatives(sre_p.parse(pattern)):
        grams: set[int] = set()
        for run in alt.lower().encode().split(b"\0"):
            grams |= {run[i] << 16 | run[i + 1] << 8 | run[i + 2] for i in range(len(run) - 2)}
        if not grams:
            return None
        out.add(frozenset(grams))
    return [s for s in out if not any(t < s for t in out)]


@lru_cache(maxsize=None)
def _needs() -> tuple[dict[str, list[frozenset[int]] | None], np.ndarray]:
    needs = {k: required_trigrams(v) for k, v in RULES.items()}
    table = np.zeros(1 << 24, dtype=bool)
    for sets in needs.values():
        for s in sets or ():
            table[list(s)] = True
    return needs, table


CHUNK, MARGIN = 6000, 64  # characters of a chunk of the index, and those that it shares with the next


def gram_rows(view: str) -> list[tuple[int, list[int]]]:
    """(chunk, trigrams that some rule needs) of each chunk of a joined text that holds any."""
    _, table = _needs()
    out = []
    for k, a in enumerate(range(0, len(view), CHUNK)):
        b = np.frombuffer(view[a : a + CHUNK + MARGIN].lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.int32)
        if len(b) >= 3:
            g = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
            g = np.unique(g[table[g]])
            if len(g):
                out.append((k, g.tolist()))
    return out


def alternatives() -> list[tuple[str, int, int, int]]:
    """(rule, alternative, trigram, trigrams of the alternative) of every rule; a rule without derivable trigrams would have none and is run everywhere."""
    return [(rule, k, t, len(s)) for rule, sets in _needs()[0].items() for k, s in enumerate(sets or ()) for t in sorted(s)]


def everywhere() -> list[str]:
    """The rules that no trigrams can be derived for."""
    return [rule for rule, sets in _needs()[0].items() if sets is None]


def find(text: str, ext: str, rules) -> list[tuple[int, int, str]]:
    """Credential spans of a text, in its offsets, by its candidate rules."""
    view, pieces = joined(text)
    return [(_original(pieces, a), _original(pieces, b - 1) + 1, r) for a, b, r in _merge(verify(view, rules, ext))]


def bare(value: str) -> tuple[int, str]:
    """(offset, text) of a configuration value within its blanks and quotes."""
    inner = value.strip()
    body = inner[1:-1] if len(inner) >= 2 and inner[0] == inner[-1] and inner[0] in "\"'" else inner
    return (value.index(body) if body else 0), body


def in_value(value: str, name: str, rules) -> list[tuple[int, int, str]]:
    """Credential spans of one configuration value under its name, by its candidate rules."""
    at, body = bare(value)
    spans = find(body, "value", [r for r in rules if r != "named"])
    if not spans and credential_name(name or "") and secretish(body):
        spans = [(0, len(body), "named")]
    return [(at + a, at + b, r) for a, b, r in spans]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by the rule's mark, or in parts where it goes over joints or line ends; quotes, joints, line ends and all around stay, and no length shows."""
    out, last = [], 0
    for a, b, rule in spans:
        out.append(text[last:a])
        value = text[a:b]
        if re.search(r"[\"'`]\s*\+|\n|\\n", value):
            out.append(re.sub(r"(?<!\\)[A-Za-z0-9/=]+", "xxxxxxxx", value))
        else:
            out.append(f"REDACTED_{rule.upper()}")
        last = b
    out.append(text[last:])
    return "".join(out)
