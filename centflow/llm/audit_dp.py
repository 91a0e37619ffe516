"""Cheapest repairs of a conversation's roles by dynamic programming over persistent audits.

An audit is the string of a repair's edits: one of K(eep), R(erole), D(elete) for every row and I(nsert) between
them. Costs add up, and of equal costs the ASCII-least audit is wanted. The states of the DP are those of the
automaton of ``(s?(ua)+)?``; for each only the best audit is kept.

Audits share their prefixes: an audit is a node that links to the node without its last edit. Every node knows its
depth, the rolling hash of its string and its ancestors 1, 2, 4, ... edits back. Two audits of equal cost are
compared by searching their longest common prefix: both are lifted to one depth, then as far as their hashes
differ. Equal hashes are not trusted: the common prefix is verified edit by edit until the two chains meet, which is
at once if they share the node.

Inserts stand right before the next row that stays, or at the end: a delete moved before an insert gives a less
audit. At most one is needed before a row, as two lead back to an equal state. So audits at the end of a row
have one last edit each for the same row, none is a prefix of another, and audits of different states differ. The
order of the best audits therefore survives whatever is appended, and stretches of a conversation can be solved
apart: ``stretch`` gives costs and order for every state before and after it, ``chain`` joins stretches.
"""

from collections.abc import Iterable
from dataclasses import dataclass, field

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 60
_ROLES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state that one user or assistant more leads to, and its role.
_NEXT = [(USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user")]
#: Inserts that a conversation needs at its end.
_TAIL = [0, 2, 1, 0]
_PRIME, _BASE = (1 << 61) - 1, 1_000_003

#: Why a row must go or costs more; a sound row has none.
BLANK, DUPLICATE, CUT, SOUND = "blank", "duplicate", "truncated", ""


@dataclass
class Audits:
    """Nodes of audits; node 0 is the empty one."""

    parent: list[int] = field(default_factory=lambda: [0])
    edit: list[str] = field(default_factory=lambda: [""])
    depth: list[int] = field(default_factory=lambda: [0])
    hash: list[int] = field(default_factory=lambda: [0])
    up: list[list[int]] = field(default_factory=lambda: [[]])

    def append(self, node: int, edits: str) -> int:
        for edit in edits:
            ancestors, k = [node] if self.depth[node] else [], 0
            while k < len(ancestors) and k < len(self.up[ancestors[k]]):
                ancestors.append(self.up[ancestors[k]][k])
                k += 1
            self.parent.append(node)
            self.edit.append(edit)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * _BASE + ord(edit)) % _PRIME)
            self.up.append(ancestors)
            node = len(self.parent) - 1
        return node

    def lifted(self, node: int, depth: int) -> int:
        """The ancestor (or the node itself) at a depth."""
        while (by := self.depth[node] - depth) > 0:
            ancestors = self.up[node]
            k = by.bit_length() - 1
            node = ancestors[k] if k < len(ancestors) else 0
        return node

    def less(self, x: int, y: int) -> bool:
        """Whether the audit of x comes before that of y."""
        shallow = min(self.depth[x], self.depth[y])
        a, b = self.lifted(x, shallow), self.lifted(y, shallow)
        if self.hash[a] == self.hash[b]:
            first = self._differ(a, b)
            return self.depth[x] < self.depth[y] if first is None else first
        # as far back as the hashes differ
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
        first = self._differ(self.parent[a], self.parent[b])
        return self.edit[a] < self.edit[b] if first is None else first

    def _differ(self, a: int, b: int) -> bool | None:
        """Verify that two audits of one depth and hash are equal (None); else whether a comes before b."""
        before = None
        while a != b:
            if self.edit[a] != self.edit[b]:
                before = self.edit[a] < self.edit[b]
            a, b = self.parent[a], self.parent[b]
        return before

    def text(self, node: int) -> str:
        edits = []
        while node:
            edits.append(self.edit[node])
            node = self.parent[node]
        return "".join(reversed(edits))


def _options(state: int, initial: str, fault: str) -> Iterable[tuple[int, int, str]]:
    """(next state, cost, edits) of what can be done with a row."""
    yield state, DELETE, "D"
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    inserted = _NEXT[state][0]
    moves = _ROLES.get(initial, {})
    if state in moves:
        yield moves[state], KEEP + more, "K"
    elif inserted in moves:
        yield moves[inserted], INSERT + KEEP + more, "IK"
    yield _NEXT[state][0], REROLE + more, "R"
    yield _NEXT[inserted][0], INSERT + REROLE + more, "IR"


#: The options of every state for a role's initial and a fault, computed once per worker.
_known: dict[tuple[str, str], list[list[tuple[int, int, str]]]] = {}


def _table(initial: str, fault: str) -> list[list[tuple[int, int, str]]]:
    if initial not in _ROLES:
        initial = ""
    if (initial, fault) not in _known:
        _known[initial, fault] = [list(_options(state, initial, fault)) for state in STATES]
    return _known[initial, fault]


def run(audits: Audits, rows: Iterable[tuple[str, str]], entry: int) -> tuple[list[int], list[int]]:
    """Best cost and audit of every state after rows (initial, fault), from one state with no edits."""
    costs, nodes = [NEVER] * 4, [0] * 4
    costs[entry] = 0
    for initial, fault in rows:
        table = _table(initial, fault)
        best, from_, edits = [NEVER] * 4, [-1] * 4, [""] * 4
        made = [-1] * 4
        for state in STATES:
            so_far = costs[state]
            if so_far >= NEVER:
                continue
            for to, cost, edit in table[state]:
                total = so_far + cost
                if total < best[to]:
                    best[to], from_[to], edits[to], made[to] = total, nodes[state], edit, -1
                elif total == best[to]:
                    if made[to] < 0:
                        made[to] = audits.append(from_[to], edits[to])
                    other = audits.append(nodes[state], edit)
                    if audits.less(other, made[to]):
                        from_[to], edits[to], made[to] = nodes[state], edit, other
        costs = best
        nodes = [made[s] if made[s] >= 0 else audits.append(from_[s], edits[s]) if best[s] < NEVER else 0 for s in STATES]
    return costs, nodes


def finished(costs: list[int], nodes: list[int], audits: Audits) -> tuple[int, int]:
    """Cost and audit of the whole conversation, with the inserts its end needs."""
    best, chosen = NEVER, -1
    for state in STATES:
        total = costs[state] + INSERT * _TAIL[state]
        if total > best or total >= NEVER:
            continue
        node = audits.append(nodes[state], "I" * _TAIL[state])
        if total < best or audits.less(node, chosen):
            best, chosen = total, node
    return best, chosen


def repair(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a whole conversation, of equal ones the ASCII-least audit."""
    audits = Audits()
    cost, node = finished(*run(audits, rows, START), audits)
    return cost, audits.text(node)


@dataclass
class Stretch:
    """Costs and places of the best audits of a stretch: [state before][state after]."""

    costs: list[list[int]]
    places: list[list[int]]


def stretch(rows: list[tuple[str, str]]) -> Stretch:
    """A stretch of a conversation for every state before it; places order the audits from one state."""
    costs, places = [], []
    for entry in STATES:
        audits = Audits()
        after, nodes = run(audits, rows, entry)
        place = [0] * 4
        for x in STATES:
            place[x] = sum(after[y] < NEVER and audits.less(nodes[y], nodes[x]) for y in STATES if y != x)
        costs.append(after)
        places.append(place)
    return Stretch(costs, places)


def chain(stretches: list[Stretch]) -> tuple[int, list[tuple[int, int]], int]:
    """Cost, (state before, state after) of each stretch, and inserts at the end, of the best whole repair."""
    costs, order = [0, NEVER, NEVER, NEVER], [0, 1, 2, 3]
    back = []
    for part in stretches:
        best, from_ = [NEVER] * 4, [-1] * 4
        for to in STATES:
            options = [(costs[s] + part.costs[s][to], order[s], s) for s in STATES
                       if costs[s] < NEVER and part.costs[s][to] < NEVER]
            if options:
                best[to], _, from_[to] = min(options)
        keys = sorted((order[from_[s]], part.places[from_[s]][s], s) for s in STATES if from_[s] >= 0)
        order = [4] * 4
        for place, (_, _, s) in enumerate(keys):
            order[s] = place
        costs = best
        back.append(from_)
    cost, _, state = min((costs[s] + INSERT * _TAIL[s], order[s], s) for s in STATES if costs[s] < NEVER)
    tail, path = _TAIL[state], []
    for from_ in reversed(back):
        path.append((from_[state], state))
        state = from_[state]
    return cost, path[::-1], tail


def between(rows: list[tuple[str, str]], entry: int, exit_: int) -> str:
    """The best audit of a stretch between two states."""
    audits = Audits()
    return audits.text(run(audits, rows, entry)[1][exit_])


def repaired(audit: str, rows: list[tuple[str, str]], state: int = START) -> Iterable[tuple[str, str]]:
    """(role, text) of what an audit makes of rows (role, text), from a state on."""
    at = 0
    for edit in audit:
        if edit == "I":
            state, role = _NEXT[state]
            yield role, ""
            continue
        role, text = rows[at]
        at += 1
        if edit == "K":
            state = _ROLES[role[:1]][state]
            yield role, text
        elif edit == "R":
            state, role = _NEXT[state]
            yield role, text
