"""Context-free grammars in EBNF: permissible adjacent tokens and recognition.

A grammar is text of rules ``name: body`` (one to a line, lines that start with white space go on). In a body, quoted
words are token classes, bare words are rules, with ``|``, parentheses, ``?``, ``*`` and ``+``. Several rules of
one name are alternatives; a rule that is used but not given matches nothing.
"""

from __future__ import annotations

import re

_SYMBOL = re.compile(r"\s*(?:('[^'\s]+')|([A-Za-z_]\w*)|([|()?*+]))")


class Grammar:
    def __init__(self, text: str, start: str):
        self.start = start
        self.rules: dict[str, set[tuple[str, ...]]] = {}
        self._made = 0
        for line in re.sub(r"\n[ \t]+", " ", text.strip()).split("\n"):
            line = line.strip()
            if line and not line.startswith("//"):
                name, _, body = line.partition(":")
                self._symbols = [m.group(1) or m.group(2) or m.group(3) for m in _SYMBOL.finditer(body.strip() + " ") if m.group().strip()]
                self._at = 0
                for option in self._options():
                    self.rules.setdefault(name.strip(), set()).add(option)
                assert self._at == len(self._symbols), (name, self._symbols[self._at :])
        self._analyse()

    # EBNF to plain rules; repetition becomes left recursion, which recognition takes in linear time.
    def _options(self) -> list[tuple[str, ...]]:
        out = [self._sequence()]
        while self._at < len(self._symbols) and self._symbols[self._at] == "|":
            self._at += 1
            out.append(self._sequence())
        return out

    def _sequence(self) -> tuple[str, ...]:
        out: list[str] = []
        while self._at < len(self._symbols) and self._symbols[self._at] not in ("|", ")"):
            s = self._symbols[self._at]
            self._at += 1
            if s == "(":
                options = self._options()
                assert self._symbols[self._at] == ")"
                self._at += 1
                s = self._new(*options)
            while self._at < len(self._symbols) and self._symbols[self._at] in ("?", "*", "+"):
                op = self._symbols[self._at]
                self._at += 1
                if op == "?":
                    s = self._new((), (s,))
                elif op == "*":
                    n = self._new(())
                    self.rules[n].add((n, s))
                    s = n
                else:
                    n = self._new((s,))
                    self.rules[n].add((n, s))
                    s = n
            out.append(s)
        return tuple(out)

    def _new(self, *options) -> str:
        self._made += 1
        name = f"_{self._made}"
        self.rules[name] = set(options)
        return name

    def _analyse(self) -> None:
        rules = self.rules
        names = set(rules) | {s for options in rules.values() for o in options for s in o if s[0] != "'"}
        nullable: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in names}
        last: dict[str, set[str]] = {n: set() for n in names}
        get = lambda table, s: {s[1:-1]} if s[0] == "'" else table[s]
        changed = True
        while changed:
            changed = False
            for name, options in rules.items():
                for option in options:
                    if name not in nullable and all(s in nullable for s in option):
                        nullable.add(name)
                        changed = True
                    for table, order in ((first, option), (last, option[::-1])):
                        before = len(table[name])
                        for s in order:
                            table[name] |= get(table, s)
                            if s not in nullable:
                                break
                        changed |= len(table[name]) != before
        self.nullable, self.first, self.last = nullable, first, last
        self._compile()

    def pairs(self) -> set[tuple[str, str]]:
        """All (a, b) such that some sentence may have token b right after token a. ``^`` and ``$`` are its ends."""
        out: set[tuple[str, str]] = set()
        get = lambda table, s: {s[1:-1]} if s[0] == "'" else table[s]
        for options in self.rules.values():
            for option in options:
                for i in range(len(option) - 1):
                    a = get(self.last, option[i])
                    for j in range(i + 1, len(option)):
                        out |= {(x, y) for x in a for y in get(self.first, option[j])}
                        if option[j] not in self.nullable:
                            break
        out |= {("^", x) for x in self.first[self.start]} | {(x, "$") for x in self.last[self.start]}
        return out | ({("^", "$")} if self.start in self.nullable else set())

    # Earley recognition over numbered dotted rules.
    def _compile(self) -> None:
        self._next: list[str | None] = []  # by dotted rule: the symbol after the dot
        self._left: list[str] = []
        self._begin: dict[str, list[tuple[int, frozenset | None]]] = {}
        for name, options in self.rules.items():
            for option in sorted(options):
                firsts: set[str] = set()
                empty = True
                for s in option:
                    firsts |= {s[1:-1]} if s[0] == "'" else self.first[s]
                    if s not in self.nullable:
                        empty = False
                        break
                self._begin.setdefault(name, []).append((len(self._next), None if empty else frozenset(firsts)))
                for s in option:
                    self._next.append(s)
                    self._left.append(name)
                self._next.append(None)
                self._left.append(name)

    def accepts(self, tokens: list[str]) -> bool:
        nxt, left, begin, nullable = self._next, self._left, self._begin, self.nullable
        n = len(tokens)
        waiting: list[dict[str, list[tuple[int, int]]]] = []
        current: list[tuple[int, int]] = [(s, 0) for s, _ in begin[self.start]]
        for i in range(n + 1):
            token = tokens[i] if i < n else "$"
            quoted = f"'{token}'"
            seen, wait, predicted, following, done = set(current), {}, {self.start} if i == 0 else set(), [], False
            waiting.append(wait)
            todo = current
            k = 0
            while k < len(todo):
                state, origin = todo[k]
                k += 1
                s = nxt[state]
                if s is None:
                    name = left[state]
                    if origin == 0 and name == self.start:
                        done = True
                    if origin != i:
                        for st, o in waiting[origin].get(name, ()):
                            item = (st + 1, o)
                            if item not in seen:
                                seen.add(item)
                                todo.append(item)
                elif s[0] == "'":
                    if s == quoted:
                        following.append((state + 1, origin))
                else:
                    wait.setdefault(s, []).append((state, origin))
                    if s not in predicted:
                        predicted.add(s)
                        for st, firsts in begin.get(s, ()):
                            if (firsts is None or token in firsts) and (st, i) not in seen:
                                seen.add((st, i))
                                todo.append((st, i))
                    if s in nullable:
                        item = (state + 1, origin)
                        if item not in seen:
                            seen.add(item)
                            todo.append(item)
            if i == n:
                return done
            if not following:
                return False
            current = following
        return False
