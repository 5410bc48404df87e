"""Table-driven generalised LR recogniser.

``Tables(text, start)`` reads a grammar in a small EBNF (``rule = alt | alt ;`` with ``[x]``
optional, ``x*``, ``x+``, ``(a | b)`` and ``x % ','`` for a separated list) and computes LALR(1)
tables: the LR(0) automaton, then lookaheads as FOLLOW sets of the grammar whose symbols are the
automaton's transitions.  Entries with several actions stay: ``recognise`` runs on one linked stack
while the table is deterministic and on a graph-structured stack where it is not, so that the
bundled grammars can be written as their language reports state them.
"""

from __future__ import annotations

import re

_META = re.compile(r"\s+|#[^\n]*|'([^'\n]+)'|([A-Za-z_]\w*)|([=|;()\[\]*+%])")

END, AUTO = "$end", "$auto"


class _Reader:
    """EBNF text to plain productions."""

    def __init__(self, text: str):
        self.toks = [m.group().strip() for m in _META.finditer(text) if m.lastindex]
        self.pos, self.rules, self.fresh = 0, {}, 0
        while self.pos < len(self.toks):
            name = self.take()
            self.take("=")
            self.rules.setdefault(name, []).extend(self.alts())
            self.take(";")

    def take(self, want: str | None = None) -> str:
        tok = self.toks[self.pos]
        if want and tok != want:
            raise ValueError(f"grammar: {want} expected, found {self.toks[max(0, self.pos - 5): self.pos + 3]}")
        self.pos += 1
        return tok

    def new(self, alts: list) -> str:
        key = str(alts)
        if key not in self.__dict__.setdefault("known", {}):
            self.fresh += 1
            self.known[key] = name = f"_{self.fresh}"
            self.rules[name] = [[name if s == "@" else s for s in a] for a in alts]
        return self.known[key]

    def alts(self) -> list:
        out = [self.seq()]
        while self.toks[self.pos] == "|":
            self.pos += 1
            out.append(self.seq())
        return out

    def seq(self) -> list:
        out: list = []
        while self.toks[self.pos] not in ("|", ";", ")", "]"):
            tok = self.take()
            if tok == "(":
                item = self.new(self.alts())
                self.take(")")
            elif tok == "[":
                item = self.new([[], *self.alts()])
                self.take("]")
            else:
                item = tok
            while self.toks[self.pos] in ("*", "+", "%"):
                op = self.take()
                if op == "*":
                    item = self.new([[], ["@", item]])
                elif op == "+":
                    item = self.new([[item], ["@", item]])
                else:
                    sep = self.take()
                    item = self.new([[item], ["@", sep, item]])
            out.append(item)
        return out


class Tables:
    """LALR(1) action and goto tables with conflicts kept as tuples of actions.

    A positive action shifts to that state, a negative one reduces by that production, 0 accepts.
    """

    def __init__(self, text: str, start: str):
        rules = _Reader(text).rules
        self.terminals: dict[str, int] = {END: 0, AUTO: 1}
        nts = {n: i for i, n in enumerate(rules)}
        prods: list[tuple[int, tuple]] = [(-1, ())]

        def sym(s: str) -> int:
            if s in nts:
                return ~nts[s]
            if s[0] != "'" and not s.isupper() and s not in (END, AUTO):
                raise ValueError(f"grammar: {s} has no rule")
            return self.terminals.setdefault(s.strip("'"), len(self.terminals))

        by_nt: list[list[int]] = [[] for _ in nts]
        for n, alts in rules.items():
            for alt in {tuple(map(sym, a)): 0 for a in alts}:
                by_nt[nts[n]].append(len(prods))
                prods.append((nts[n], alt))
        top = len(nts)
        by_nt.append([0])
        prods[0] = (top, (~nts[start],))
        # LR(0) automaton
        kernels, trans, ids, items_of = [((0, 0),)], [], {((0, 0),): 0}, []
        k = 0
        while k < len(kernels):
            items, seen = list(kernels[k]), set()
            for p, d in items:
                rhs = prods[p][1]
                if d < len(rhs) and rhs[d] < 0 and rhs[d] not in seen:
                    seen.add(rhs[d])
                    items.extend((q, 0) for q in by_nt[~rhs[d]])
            moves: dict[int, list] = {}
            for p, d in items:
                rhs = prods[p][1]
                if d < len(rhs):
                    moves.setdefault(rhs[d], []).append((p, d + 1))
            row = {}
            for s, kern in moves.items():
                key = tuple(sorted(set(kern)))
                if key not in ids:
                    ids[key] = len(kernels)
                    kernels.append(key)
                row[s] = ids[key]
            trans.append(row)
            items_of.append([(p, d) for p, d in items if d == len(prods[p][1])])
            k += 1
        # LALR(1) lookaheads: FOLLOW in the grammar over nonterminal transitions
        nt_trans = {(q, s): i for i, (q, s) in enumerate((q, s) for q, row in enumerate(trans) for s in row if s < 0)}
        nullable: set[int] = set()
        changed = True
        while changed:
            changed = False
            for lhs, rhs in prods:
                if ~lhs not in nullable and all(s in nullable for s in rhs):
                    nullable.add(~lhs)
                    changed = True
        direct = [0] * len(nt_trans)
        into: list[set[int]] = [set() for _ in nt_trans]
        look: dict[tuple[int, int], list[int]] = {}
        for (q, s), i in nt_trans.items():
            r = trans[q][s]
            for t, _ in trans[r].items():
                if t >= 0:
                    direct[i] |= 1 << t
                elif t in nullable:
                    into[i].add(nt_trans[(r, t)])  # reads
        self._spread(direct, into)
        into = [set() for _ in nt_trans]
        for (q, s), i in nt_trans.items():
            for p in by_nt[~s]:
                rhs, at, path = prods[p][1], q, []
                for x in rhs:
                    path.append(at)
                    at = trans[at][x]
                look.setdefault((at, p), []).append(i)
                for j in range(len(rhs) - 1, -1, -1):
                    if rhs[j] < 0:
                        into[nt_trans[(path[j], rhs[j])]].add(i)
                    if rhs[j] not in nullable:
                        break
        end_at = nt_trans[(0, ~nts[start])]
        direct[end_at] |= 1
        self._spread(direct, into)
        self.action: list[dict] = []
        self.goto: list[dict] = []
        for q, row in enumerate(trans):
            acts: dict[int, list[int]] = {}
            for s, r in row.items():
                if s >= 0:
                    acts.setdefault(s, []).append(r)
            for p, _ in items_of[q]:
                if p == 0:
                    acts.setdefault(0, []).append(0)
                    continue
                mask = 0
                for i in look.get((q, p), ()):
                    mask |= direct[i]
                for t in range(len(self.terminals)):
                    if mask >> t & 1:
                        acts.setdefault(t, []).append(-p)
            self.action.append({t: a[0] if len(a) == 1 else tuple(a) for t, a in acts.items()})
            self.goto.append({~s: r for s, r in row.items() if s < 0})
        self.size = [len(r) for _, r in prods]
        self.left = [n for n, _ in prods]
        self.names = {i: n for n, i in self.terminals.items()}

    @staticmethod
    def _spread(sets: list[int], into: list[set[int]]) -> None:
        changed = True
        while changed:
            changed = False
            for i, froms in enumerate(into):
                m = sets[i]
                for j in froms:
                    m |= sets[j]
                if m != sets[i]:
                    sets[i] = m
                    changed = True

    def recognise(self, kinds: list[int], breaks: list[bool] | None = None, closers: frozenset = frozenset()) -> int:
        """-1 if the token kinds (ending in 0) form a sentence, else the index of the first token that no stack can take.

        breaks[i]: a line break precedes token i; there, and before the kinds in ``closers``, the
        automatic terminator may be put in when the token itself can't be taken.
        """
        action, goto, size, left = self.action, self.goto, self.size, self.left
        node: tuple | None = (0, None)
        heads: list | None = None
        i, n = 0, len(kinds)
        while i < n:
            tok = kinds[i]
            if heads is None:
                start = node
                while True:
                    act = action[node[0]].get(tok)
                    if act.__class__ is int:
                        if act > 0:
                            node = (act, node)
                            break
                        if act == 0:
                            return -1
                        k = size[-act]
                        base = node
                        while k:
                            base = base[1]
                            if base.__class__ is list:
                                break
                            k -= 1
                        if k:
                            heads = [start]
                            break
                        node = (goto[base[0]][left[-act]], base)
                        continue
                    heads = [start] if act is not None else []
                    if act is None:
                        node = start
                    break
                if heads is None:
                    i += 1
                    continue
                if not heads:
                    heads = None
                    if breaks is not None and (breaks[i] or tok in closers):
                        new = self._step([start], AUTO_KIND)
                        new = new and self._step(new, tok)
                        if new:
                            heads = new
                            i += 1
                            if tok == 0:
                                return -1
                    if heads is None:
                        return i
                else:
                    new = self._step(heads, tok)
                    if not new and breaks is not None and (breaks[i] or tok in closers):
                        new = self._step(heads, AUTO_KIND)
                        new = new and self._step(new, tok)
                    if not new:
                        return i
                    if tok == 0:
                        return -1
                    heads = new
                    i += 1
            else:
                new = self._step(heads, tok)
                if not new and breaks is not None and (breaks[i] or tok in closers):
                    new = self._step(heads, AUTO_KIND)
                    new = new and self._step(new, tok)
                if not new:
                    return i
                if tok == 0:
                    return -1
                heads = new
                i += 1
            if heads is not None and len(heads) == 1:
                node, heads = heads[0], None
        return n - 1

    def _step(self, heads: list, tok: int) -> list:
        """All stack tops after ``tok``; nodes are (state, parent or list of parents)."""
        action, goto, size, left = self.action, self.goto, self.size, self.left
        level: dict[int, tuple] = {}
        work: list[tuple] = []
        for h in heads:
            level[h[0]] = h
            work.append(h)
        fresh: dict[int, list] = {}
        done: set = set()
        shifts: dict[int, list] = {}
        while work:
            node = work.pop()
            acts = action[node[0]].get(tok)
            if acts is None:
                continue
            for act in (acts,) if acts.__class__ is int else acts:
                if act > 0:
                    parents = shifts.setdefault(act, [])
                    if not any(p is node for p in parents):
                        parents.append(node)
                elif act == 0:
                    return [node]
                else:
                    bases = [node]
                    for _ in range(size[-act]):
                        nxt: dict[int, tuple] = {}
                        for b in bases:
                            up = b[1]
                            for p in up if up.__class__ is list else (up,):
                                nxt[id(p)] = p
                        bases = list(nxt.values())
                    for b in bases:
                        state = goto[b[0]].get(left[-act])
                        if state is None:
                            continue
                        key = (state, id(b))
                        if key in done:
                            continue
                        done.add(key)
                        old = level.get(state)
                        if old is None:
                            up = [b]
                            level[state] = new = (state, up)
                            fresh[state] = up
                            work.append(new)
                        elif state in fresh:
                            fresh[state].append(b)
                            work.extend(level.values())  # a new path may run through any node of this level
                        else:
                            up = old[1]
                            if up is b or up.__class__ is list and any(p is b for p in up):
                                continue
                            up = [*(up if up.__class__ is list else [up]), b]
                            level[state] = new = (state, up)
                            fresh[state] = up
                            work.append(new)
        out = []
        for state, parents in shifts.items():
            live = [level.get(p[0], p) if p[0] in fresh and level[p[0]][1] is fresh[p[0]] else p for p in parents]
            live = list({id(p): p for p in live}.values())
            live = [p if p[1].__class__ is not list or len(p[1]) > 1 else (p[0], p[1][0]) for p in live]
            out.append((state, live[0] if len(live) == 1 else live))
        return out


AUTO_KIND = 1
