"""Table-driven parsing: grammars as text, SLR(1) tables, and a generalised LR recogniser.

A grammar file has rules `name : alternative | alternative ;`. 'x' is a token by its text, an upper-case
word a class of tokens, a lower-case word another rule; ( ), ?, * and + have their usual meaning.
Where a table has a conflict, the recogniser follows all actions at once; stacks share their lower parts,
and those that die at a token are dropped. Ambiguity is harmless, as only yes or no is asked.
"""

from __future__ import annotations

import pkgutil
import re
from functools import lru_cache
from itertools import product

END = "\0end"
_PART = re.compile(r"\s+|#[^\n]*|(?P<lit>'[^'\n]+')|(?P<word>[A-Za-z_]\w*)|(?P<op>[:;|()?*+])")


class Grammar:
    """Productions as (left side, tuple of symbols); symbols are ints, terminals have their text in `terminals`."""

    def __init__(self, text: str):
        self.words: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _PART.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at : at + 30]!r}")
            if m.lastgroup:
                self.words.append((m.lastgroup, m.group()))
            at = m.end()
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        self.made: dict[tuple, str] = {}
        self.at = 0
        order = []
        while self.at < len(self.words):
            name = self._take("word")
            self._take("op", ":")
            order.append(name)
            self.rules.setdefault(name, []).extend(self._alternatives())
            self._take("op", ";")
        self.start = order[0]
        self._number()

    def _peek(self) -> str:
        return self.words[self.at][1] if self.at < len(self.words) else ""

    def _take(self, kind: str, text: str | None = None) -> str:
        k, t = self.words[self.at]
        if k != kind or text not in (None, t):
            raise ValueError(f"grammar: {t!r} after {' '.join(w for _, w in self.words[max(0, self.at - 8) : self.at])}")
        self.at += 1
        return t

    def _alternatives(self) -> list[tuple[str, ...]]:
        out = self._sequence()
        while self._peek() == "|":
            self.at += 1
            out += self._sequence()
        return list(dict.fromkeys(out))

    def _sequence(self) -> list[tuple[str, ...]]:
        parts: list[list[tuple[str, ...]]] = []
        while self._peek() not in ("|", ";", ")", ""):
            if self._peek() == "(":
                self.at += 1
                item = self._alternatives()
                self._take("op", ")")
            else:
                k, t = self.words[self.at]
                self.at += 1
                item = [(t,)]
            while self._peek() in ("?", "*", "+"):
                op = self._peek()
                self.at += 1
                if op != "?":
                    item = [(self._repeated(item),)]
                if op != "+":
                    item = [(), *item]
            parts.append(item)
        return [tuple(s for piece in choice for s in piece) for choice in product(*parts)]

    def _repeated(self, item: list[tuple[str, ...]]) -> str:
        key = tuple(item)
        if key not in self.made:
            name = self.made[key] = f"_{len(self.made)}"
            self.rules[name] = [*item, *((name, *s) for s in item)]
        return self.made[key]

    def _number(self) -> None:
        self.left = {n: i for i, n in enumerate(["_start", *self.rules])}
        names = {s for alts in self.rules.values() for a in alts for s in a if s not in self.rules}
        bad = {s for s in names if s[0] != "'" and not s.isupper()}
        if bad:
            raise ValueError(f"grammar: no rule for {sorted(bad)}")
        base = len(self.left)
        self.terminals = {(s[1:-1] if s[0] == "'" else s): base + i for i, s in enumerate(sorted(names))}
        self.terminals[END] = base + len(names)
        number = lambda s: self.left[s] if s in self.rules else self.terminals[s[1:-1] if s[0] == "'" else s]
        self.productions = [(0, (self.left[self.start], self.terminals[END]))]
        self.productions += [(self.left[n], tuple(map(number, a))) for n, alts in self.rules.items() for a in alts]


class Tables:
    """action[state][terminal] is a state to shift to, ~production to reduce by, or a tuple of such; goto[state][left side]."""

    def __init__(self, g: Grammar):
        prods, n_left = g.productions, len(g.left)
        self.terminals, self.rhs = g.terminals, [(l, len(r)) for l, r in prods]
        by_left: list[list[int]] = [[] for _ in range(n_left)]
        for i, (l, _) in enumerate(prods):
            by_left[l].append(i)
        nullable: set[int] = set()
        first: list[set[int]] = [set() for _ in range(n_left)]
        changed = True
        while changed:
            changed = False
            for l, r in prods:
                before = len(first[l]), l in nullable
                for s in r:
                    if s >= n_left:
                        first[l].add(s)
                        break
                    first[l] |= first[s]
                    if s not in nullable:
                        break
                else:
                    nullable.add(l)
                changed |= before != (len(first[l]), l in nullable)
        follow: list[set[int]] = [set() for _ in range(n_left)]
        changed = True
        while changed:
            changed = False
            for l, r in prods:
                tail = set(follow[l])
                for s in reversed(r):
                    if s >= n_left:
                        tail = {s}
                        continue
                    size = len(follow[s])
                    follow[s] |= tail
                    changed |= len(follow[s]) != size
                    tail = first[s] | tail if s in nullable else set(first[s])
        opened: list[frozenset[int]] = []  # rules that a closure adds for a left side
        for l in range(n_left):
            todo, got = [l], {l}
            while todo:
                for p in by_left[todo.pop()]:
                    r = prods[p][1]
                    if r and r[0] < n_left and r[0] not in got:
                        got.add(r[0])
                        todo.append(r[0])
            opened.append(frozenset(got))
        starts = [[(p, 0) for l in got for p in by_left[l]] for got in opened]
        kernels = {frozenset([(0, 0)]): 0}
        order = [frozenset([(0, 0)])]
        self.action: list[dict] = []
        self.goto: list[dict[int, int]] = []
        i = 0
        while i < len(order):
            items = set(order[i])
            for p, d in order[i]:
                r = prods[p][1]
                if d < len(r) and r[d] < n_left:
                    items.update(starts[r[d]])
            moves: dict[int, set] = {}
            action: dict[int, list] = {}
            for p, d in items:
                l, r = prods[p]
                if d < len(r):
                    moves.setdefault(r[d], set()).add((p, d + 1))
                else:
                    for t in follow[l]:
                        action.setdefault(t, []).append(~p)
            goto = {}
            for s, kernel in moves.items():
                k = frozenset(kernel)
                if k not in kernels:
                    kernels[k] = len(order)
                    order.append(k)
                if s < n_left:
                    goto[s] = kernels[k]
                else:
                    action.setdefault(s, []).append(kernels[k])
            self.action.append({t: a[0] if len(a) == 1 else tuple(a) for t, a in action.items()})
            self.goto.append(goto)
            i += 1
        self.conflicts = sum(type(a) is tuple for s in self.action for a in s.values())


@lru_cache(maxsize=None)
def tables(name: str) -> Tables:
    """The tables of a bundled grammar, built once per process."""
    text = pkgutil.get_data(__package__, f"grammars/{name}.txt").decode()
    if name == "typescript":  # an extension of the rules for JavaScript
        text = pkgutil.get_data(__package__, "grammars/javascript.txt").decode() + text
    return Tables(Grammar(text))


class Parser:
    """Takes tokens one by one; `feed` says whether the text so far can still become a sentence."""

    def __init__(self, t: Tables):
        self.t = t
        self.heads = [(0, None)]

    def feed(self, token: str) -> bool:
        sym = self.t.terminals.get(token)
        if sym is None:
            return False
        action, goto, rhs = self.t.action, self.t.goto, self.t.rhs
        heads = self.heads
        if len(heads) == 1:
            cell = heads[0]
            while True:
                a = action[cell[0]].get(sym)
                if a is None:
                    return False
                if type(a) is tuple:
                    heads = [cell]
                    break
                if a >= 0:
                    self.heads = [(a, cell)]
                    return True
                left, n = rhs[~a]
                while n:
                    cell = cell[1]
                    n -= 1
                cell = (goto[cell[0]][left], cell)
        seen, shifted, work = {}, {}, list(heads)
        while work:
            cell = work.pop()
            a = action[cell[0]].get(sym)
            if a is None:
                continue
            for one in a if type(a) is tuple else (a,):
                if one >= 0:
                    shifted[one, id(cell)] = (one, cell)
                    continue
                left, n = rhs[~one]
                c = cell
                while n:
                    c = c[1]
                    n -= 1
                key = (goto[c[0]][left], id(c))
                if key not in seen:
                    seen[key] = new = (key[0], c)
                    work.append(new)
        if not shifted:
            return False
        self.heads = list(shifted.values())
        return True

    def can(self, token: str) -> bool:
        """Whether feed would succeed."""
        heads = self.heads
        ok = self.feed(token)
        self.heads = heads
        return ok
