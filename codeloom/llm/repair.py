"""Re-Pair grammars over token sequences, in rounds that replace all locally best digrams at once.

``grammar_stats`` works on a batch of sequences together: each round counts the digrams of every
sequence, keeps those that occur at least twice, and replaces an occurrence if its digram is more
frequent than both neighbours'.  Symbols carry the number of tokens they stand for and a content
hash, so that a rule that two files infer has one name.  ``phrases`` pairs by the symbols' hashes
instead of their counts (locally consistent pairing), which gives equal stretches of different
files equal rules without any exchange between them: the grammar of a whole corpus, of which Spark
then counts the uses of each rule.
"""

from __future__ import annotations

import re

import numpy as np

_TOKEN = re.compile(
    r"""(?P<c>//[^\n]*|/\*[\s\S]*?\*/|(?<![\w"'])\#[^\n]*)|(?P<s>\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`)"""
    r"""|(?P<n>\d[\w.]*)|(?P<i>[^\W\d][\w$]*)|(?P<o>[^\s\w])"""
)
# Keywords keep their spelling in the abstract sequence; other names fall together. Fixed values.
KEYWORDS = frozenset(
    "abstract as async await break case catch class const continue def default delete do elif else enum except export extends final finally for foreach from function get if implements import in interface is lambda let "
    "namespace new not null or override package private protected public raise readonly return self set static struct super switch this throw throws try type typeof using var void while with yield".split()
)


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(class, spelling, offset) of each token; comments are left out."""
    return [(m.lastgroup, m.group(), m.start()) for m in _TOKEN.finditer(text) if m.lastgroup != "c"]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C15F39CC060)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def grammar_stats(seqs: list[np.ndarray]) -> list[dict]:
    """Of each sequence of uint64 symbols: tokens, final length, rules, the share of tokens under symbols of at least 8 tokens that occur again (reuse), and under symbols of at least 24 tokens, or a quarter of a short sequence (top).

    Rounds go on until no digram occurs twice in a sequence.
    """
    n = [len(s) for s in seqs]
    out = [{"n": k, "size": k, "rules": 0, "reuse": 0.0, "top": 0.0} for k in n]
    if not sum(n):
        return out
    owner = np.repeat(np.arange(len(seqs)), n)
    sym = np.concatenate([s.astype(np.uint64) for s in seqs])
    length = np.ones(len(sym), dtype=np.int64)
    covered = np.zeros(len(seqs))
    rules = np.zeros(len(seqs), dtype=np.int64)
    while len(sym) >= 2:
        same = owner[:-1] == owner[1:]
        code = _mix(_mix(sym[:-1], sym[1:]), owner[:-1].astype(np.uint64))
        code[~same] = 0
        _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
        freq = counts[inverse]
        freq[~same] = 0
        freq[freq < 2] = 0
        # rank by count, then by name, so that overlapping digrams never tie but with themselves
        rank = freq.astype(np.float64) + (code >> np.uint64(11)).astype(np.float64) / 2.0**53 * 0.5
        rank[freq == 0] = -1
        left = np.concatenate([[-1.0], rank[:-1]])
        right = np.concatenate([rank[1:], [-1.0]])
        pick = (freq > 0) & (rank >= left) & (rank >= right)
        # runs of one symbol: every other occurrence
        run = np.zeros(len(pick), dtype=np.int64)
        tie = pick & np.concatenate([[False], pick[:-1]])
        if tie.any():
            idx = np.arange(len(pick))
            start = np.where(pick & ~tie, idx, 0)
            np.maximum.accumulate(start, out=start)
            run = (idx - start) % 2
            pick &= run == 0
        # a digram must still be picked twice in its sequence
        code_p = code[pick]
        if not len(code_p):
            break
        _, inv2, cnt2 = np.unique(code_p, return_inverse=True, return_counts=True)
        keep = np.zeros(len(pick), dtype=bool)
        keep[np.flatnonzero(pick)[cnt2[inv2] >= 2]] = True
        if not keep.any():
            break
        pos = np.flatnonzero(keep)
        new = _mix(sym[pos], sym[pos + 1])
        new_len = length[pos] + length[pos + 1]
        first = np.unique(code[pos], return_index=True)[1]
        np.add.at(rules, owner[pos[first]], 1)
        sym[pos] = new
        length[pos] = new_len
        drop = np.ones(len(sym), dtype=bool)
        drop[pos + 1] = False
        sym, owner, length = sym[drop], owner[drop], length[drop]
    size = np.bincount(owner, minlength=len(seqs))
    long_ = length >= 8
    key = _mix(sym, owner.astype(np.uint64))
    _, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
    np.add.at(covered, owner[long_ & (cnt[inv] >= 2)], length[long_ & (cnt[inv] >= 2)])
    grouped = np.zeros(len(seqs))
    frame = np.clip(np.array(n) // 4, 12, 24)[owner]  # a short text can't repeat a long frame
    np.add.at(grouped, owner[length >= frame], length[length >= frame])
    for i, o in enumerate(out):
        if n[i]:
            o |= {"size": int(size[i]), "rules": int(rules[i]), "reuse": float(covered[i] / n[i]), "top": float(grouped[i] / n[i])}
    return out


def _hash_tokens(words: list[str]) -> np.ndarray:
    import zlib

    seen: dict[str, int] = {}
    out = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        h = seen.get(w)
        if h is None:
            b = w.encode("utf-8", "replace")
            seen[w] = h = zlib.crc32(b) << 32 | zlib.crc32(b, 0x5BD1E995)
        out[i] = h
    return _mix(out, out >> np.uint64(7))


def abstract(toks: list[tuple[str, str, int]]) -> np.ndarray:
    """Token classes: keywords and operators by spelling, names, numbers and strings by class."""
    return _hash_tokens([t if c == "o" or c == "i" and t in KEYWORDS else c for c, t, _ in toks])


def concrete(toks: list[tuple[str, str, int]]) -> np.ndarray:
    return _hash_tokens([t for _, t, _ in toks])


def phrases(sym: np.ndarray, levels: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(rule name, tokens it stands for) of each top symbol after ``levels`` rounds of locally consistent pairing."""
    length = np.ones(len(sym), dtype=np.int64)
    for level in range(levels):
        if len(sym) < 2:
            break
        salt = np.uint64(0x51ED270B * (level + 1))
        rank = _mix(sym, np.full(len(sym), salt))
        # a boundary before each local minimum: equal stretches get equal boundaries but for their ends
        inner = np.zeros(len(sym), dtype=bool)
        inner[1:-1] = (rank[1:-1] < rank[:-2]) & (rank[1:-1] <= rank[2:])
        inner[0] = True
        at = np.flatnonzero(inner)
        group = np.cumsum(inner) - 1
        head = sym[at].copy()
        offset = np.arange(len(sym)) - at[group]
        for k in range(1, int(offset.max()) + 1):
            m = np.flatnonzero(offset == k)
            head[group[m]] = _mix(head[group[m]], sym[m])
        length = np.add.reduceat(length, at)
        sym = head
    return sym, length


def data_mask(toks: list[tuple[str, str, int]], least: int = 12) -> list[bool]:
    """Which tokens lie in a run of at least ``least`` literals with nothing but punctuation between: tables and data, not code."""
    mask = [False] * len(toks)
    i, n = 0, len(toks)
    while i < n:
        j, literals = i, 0
        while j < n:
            c, t, _ = toks[j]
            if c in "sn":
                literals += 1
            elif not (t in ",[]{}():-+" or t in ("true", "false", "null", "None", "True", "False")):
                break
            j += 1
        if literals >= least:
            mask[i:j] = [True] * (j - i)
        i = max(j, i + 1)
    return mask
