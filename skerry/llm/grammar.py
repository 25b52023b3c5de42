"""Shift-reduce tables from grammars in plain text, and a driver that parses line by line.

A grammar is text, one rule a line: ``name: alternative | alternative``. A symbol may carry ``?``,
``*`` or ``+``. Whatever is never on the left is a terminal. Tables are LALR(1) and keep every action
where several compete: the driver is a generalised one, so grammars may be ambiguous.

The driver remembers what a line of terminals does to the states on top of the stack. Source lines
repeat their shapes, so most lines cost one look-up instead of one step per token; the outcome is
the same as feeding the tokens one by one.
"""

from __future__ import annotations

END = "$"


def _rules(text: str) -> tuple[list[tuple[str, tuple[str, ...]]], str]:
    rules: list[tuple[str, tuple[str, ...]]] = []
    start, made = "", set()

    def symbol(s: str) -> str:
        if len(s) > 1 and s[-1] in "?*+":
            base, op = symbol(s[:-1]), s[-1]
            name = f"{base}{op}"
            if name not in made:
                made.add(name)
                if op == "?":
                    rules.extend([(name, ()), (name, (base,))])
                elif op == "*":
                    rules.extend([(name, ()), (name, (name, base))])
                else:
                    rules.extend([(name, (base,)), (name, (name, base))])
            return name
        return s

    for line in text.strip().splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        head, _, body = line.partition(":")
        start = start or head
        for alt in (" " + body + " ").split(" | "):
            rules.append((head, tuple(symbol(s) for s in alt.split())))
    rules = list(dict.fromkeys(rules))
    return [("<start>", (start,)), *rules], start


class Tables:
    """LALR(1) tables: per state a dict of terminal -> actions, each a shift (state + 1) or a
    reduction (-rule - 1)."""

    def __init__(self, text: str, soft: str = ""):
        rules, _ = _rules(text)
        by: dict[str, list[int]] = {}
        for i, (h, _) in enumerate(rules):
            by.setdefault(h, []).append(i)
        nullable: set[str] = set()
        first: dict[str, set[str]] = {h: set() for h in by}
        change = True
        while change:
            change = False
            for h, body in rules:
                for s in body:
                    new = first[s] if s in by else {s}
                    if not new <= first[h]:
                        first[h] |= new
                        change = True
                    if s not in nullable:
                        break
                else:
                    if h not in nullable:
                        nullable.add(h)
                        change = True
        bit: dict[str, int] = {END: 1}
        for _, body in rules:
            for x in body:
                if x not in by and x not in bit:
                    bit[x] = 1 << len(bit)
        firsts = {h: sum(bit[t] for t in v) for h, v in first.items()}

        def first_of(body: tuple[str, ...]) -> tuple[int, bool]:
            """(first terminals of a string of symbols, whether it may be empty)."""
            mask = 0
            for x in body:
                if x not in by:
                    return mask | bit[x], False
                mask |= firsts[x]
                if x not in nullable:
                    return mask, False
            return mask, True

        # leads[A]: the symbols that may stand at the very left of A, with the terminals that can
        # follow them inside A, and whether what follows A can follow them too
        leads: dict[str, dict[str, list]] = {}
        for h in by:
            got: dict[str, list] = {h: [0, True]}
            todo = [h]
            while todo:
                x = todo.pop()
                mask, open_ = got[x]
                for r in by[x]:
                    body = rules[r][1]
                    if not body or body[0] not in by:
                        continue
                    m, empty = first_of(body[1:])
                    if empty:
                        m |= mask
                    was = got.get(body[0])
                    new = [m | (was[0] if was else 0), (empty and open_) or bool(was and was[1])]
                    if was != new:
                        got[body[0]] = new
                        todo.append(body[0])
            leads[h] = got

        states: dict[frozenset, int] = {frozenset([(0, 0)]): 0}
        queue = [frozenset([(0, 0)])]
        moves_of: list[dict[str, int]] = []
        for kernel in queue:
            moves: dict[str, set] = {}
            heads: set[str] = set()
            for r, dot in kernel:
                body = rules[r][1]
                if dot < len(body):
                    moves.setdefault(body[dot], set()).add((r, dot + 1))
                    if body[dot] in by:
                        heads.update(leads[body[dot]])
            for h in heads:
                for r in by[h]:
                    if rules[r][1]:
                        moves.setdefault(rules[r][1][0], set()).add((r, 1))
            to = {}
            for x, k in moves.items():
                k = frozenset(k)
                if k not in states:
                    states[k] = len(states)
                    queue.append(k)
                to[x] = states[k]
            moves_of.append(to)
        # look-aheads: what starts inside a state, and what flows from one item to another
        ahead: dict[tuple, int] = {(0, 0, 0): 1}
        flow: dict[tuple, list] = {}
        empties: list[dict[int, list]] = []
        for n, kernel in enumerate(queue):
            null: dict[int, list] = {}
            gain: dict[str, list] = {}
            for r, dot in kernel:
                body = rules[r][1]
                if dot >= len(body):
                    continue
                src = (n, r, dot)
                flow.setdefault(src, []).append((moves_of[n][body[dot]], r, dot + 1))
                if body[dot] in by:
                    m, empty = first_of(body[dot + 1 :])
                    for x, (mask, open_) in leads[body[dot]].items():
                        g = gain.setdefault(x, [0, []])
                        g[0] |= mask | (m if open_ else 0)
                        if open_ and empty:
                            g[1].append(src)
            for x, (mask, sources) in gain.items():
                for r in by[x]:
                    body = rules[r][1]
                    if not body:
                        null[r] = [mask, sources]
                        continue
                    item = (moves_of[n][body[0]], r, 1)
                    ahead[item] = ahead.get(item, 0) | mask
                    for src in sources:
                        flow.setdefault(src, []).append(item)
            empties.append(null)
        todo = list(ahead)
        while todo:
            src = todo.pop()
            mask = ahead.get(src, 0)
            for item in flow.get(src, ()):
                was = ahead.get(item, 0)
                if mask | was != was:
                    ahead[item] = mask | was
                    todo.append(item)
        names = list(bit)
        self.action, self.goto = [], []
        for n, kernel in enumerate(queue):
            action: dict[str, tuple[int, ...]] = {}
            ends = [(r, ahead.get((n, r, d), 0)) for r, d in kernel if d == len(rules[r][1])]
            for r, (mask, sources) in empties[n].items():
                for src in sources:
                    mask |= ahead.get(src, 0)
                ends.append((r, mask))
            for r, mask in sorted(ends):
                while mask:
                    low = mask & -mask
                    t = names[low.bit_length() - 1]
                    action[t] = (*action.get(t, ()), -r - 1)
                    mask ^= low
            for x, to in moves_of[n].items():
                if x not in by:
                    action[x] = (to + 1, *action.get(x, ()))
            for w in soft.split():
                # a soft keyword may also be a name
                if "ID" in action:
                    action[w] = (*action.get(w, ()), *action["ID"])
            self.action.append(action)
            self.goto.append({x: to for x, to in moves_of[n].items() if x in by})
        self.size = [len(b) for _, b in rules]
        self.head = [h for h, _ in rules]

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("action", "goto", "size", "head")}


class Parser:
    """Feeds lines of terminals to one grammar's tables, following every possible action.

    The state is a set of stacks (tuples of table states); equal stacks fall together, which keeps
    the set small although the grammars are ambiguous. Where a line makes the set wide, the stacks are
    joined into a graph from there to the end of the file: it stands for any number of stacks with a
    node per state and token, so no stack is ever left out.
    """

    MOST = 30_000
    #: Stacks followed one by one; beyond, ``overflow`` is set and the rest of the file is followed as a graph.
    WIDEST = 4_000

    def __init__(self, tables: Tables):
        self.t = tables
        self.memo: dict[tuple, list] = {}
        self.reset()

    def reset(self) -> None:
        self.stacks: set[tuple[int, ...]] = {(0,)}
        #: state -> node of the graph, once there is one; a node is (state, list of the nodes below it)
        self.tops: dict[int, tuple[int, list]] | None = None
        self.overflow = False

    def feed(self, line: tuple[str, ...]) -> int:
        """-1 if some stack took the line, else the index of the token that none could take."""
        if self.tops is not None:
            return self._graph(line)
        new: set[tuple[int, ...]] = set()
        furthest = 0
        for stack in self.stacks:
            key = (stack[-1], line)
            for k, suffix, results, fail in self.memo.get(key, ()):
                if k == 1 or stack[-k:] == suffix:
                    break
            else:
                got = self._run(stack, line)
                if got is None:
                    return self._join(line)
                k, results, fail = got
                if len(self.memo) > self.MOST:
                    self.memo.clear()
                self.memo.setdefault(key, []).append((k, stack[-k:], results, fail))
            base = stack[:-k]
            for r in results:
                new.add(base + r)
            if len(new) > self.WIDEST:
                return self._join(line)
            if fail > furthest:
                furthest = fail
        if not new:
            return furthest
        self.stacks = new
        return -1

    def _join(self, line: tuple[str, ...]) -> int:
        """Go on from the stacks before ``line`` as a graph: equal lower parts of stacks are one node."""
        self.overflow = True
        made: dict[tuple[int, ...], tuple[int, list]] = {}
        self.tops = {}
        for stack in self.stacks:
            below = None
            for i in range(1, len(stack)):
                node = made.get(stack[:i])
                if node is None:
                    node = made[stack[:i]] = (stack[i - 1], [] if below is None else [below])
                below = node
            top = self.tops.setdefault(stack[-1], (stack[-1], []))
            if below is not None and not any(x is below for x in top[1]):
                top[1].append(below)
        self.stacks = set()
        return self._graph(line)

    def _graph(self, line: tuple[str, ...]) -> int:
        """``feed`` on the graph. A new edge may open new paths for any node of its level, so reductions run until
        they add none; nodes and edges of a level are finite, cycles of empty rules included."""
        action, goto, size, head = self.t.action, self.t.goto, self.t.size, self.t.head
        tops = self.tops
        for i, tok in enumerate(line):
            took = tok == END and any(-1 in action[s].get(tok, ()) for s in tops)
            edges = {(s, id(x)) for s, node in tops.items() for x in node[1]}
            grown = True
            while grown:
                grown = False
                for state, node in list(tops.items()):
                    for a in action[state].get(tok, ()):
                        if a > 0:
                            continue
                        if a == -1:
                            took |= tok == END
                            continue
                        r = -a - 1
                        at = {id(node): node}
                        for _ in range(size[r]):
                            at = {id(x): x for n in at.values() for x in n[1]}
                        for n in at.values():
                            to = goto[n[0]][head[r]]
                            if (to, id(n)) not in edges:
                                edges.add((to, id(n)))
                                tops.setdefault(to, (to, []))[1].append(n)
                                grown = True
            new: dict[int, tuple[int, list]] = {}
            for state, node in tops.items():
                for a in action[state].get(tok, ()):
                    if a > 0:
                        new.setdefault(a - 1, (a - 1, []))[1].append(node)
            if took:
                new = tops
            elif not new:
                return i
            tops = self.tops = new
        return -1

    def _run(self, stack: tuple[int, ...], line: tuple[str, ...]) -> tuple[int, list, int] | None:
        """(states of the stack that mattered, what replaces them, index of the token refused); None where it
        would take more than WIDEST stacks."""
        action, goto, size, head = self.t.action, self.t.goto, self.t.size, self.t.head
        low = len(stack) - 1
        now = {stack}
        for i, tok in enumerate(line):
            out: set[tuple[int, ...]] = set()
            seen = set(now)
            todo = list(now)
            while todo:
                st = todo.pop()
                for a in action[st[-1]].get(tok, ()):
                    if a > 0:
                        out.add((*st, a - 1))
                        continue
                    if a == -1:
                        if tok == END:
                            out.add(st)
                        continue
                    r = -a - 1
                    n = size[r]
                    cut = len(st) - n
                    if cut - 1 < low:
                        low = cut - 1
                    st2 = (*st[:cut], goto[st[cut - 1]][head[r]])
                    if st2 not in seen:
                        if len(seen) >= self.WIDEST:
                            return None
                        seen.add(st2)
                        todo.append(st2)
            if not out:
                return len(stack) - low, [], i
            now = out
        return len(stack) - low, [s[low:] for s in now], -1
