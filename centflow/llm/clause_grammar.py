"""A weighted finite-state grammar of clauses: insult, threat, target, negation and reported speech.

Each part is a transducer of its own over the marks of a clause's words, and ``compose`` makes one automaton of
them, in this order: negation marks hits that a negation reaches; insult and threat each may pick one hit, whose
weight the path takes; target and reported speech watch the clause to its end and say in which class of clause
(kind, targeted, frame) the picked hit stands. A clause has one path for every hit, and the sum of the weights of all
paths that end in a class, by the forward algorithm, is what the clause carries in that class.
"""

import math
import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

#: Closed word classes of the grammar, in the languages of the corpus and plain English.
THREATS = "kill murder stab strangle shoot hang burn hurt destroy".split()
TARGETS = ("you your yours yourself he she they him her them his their "
           "du dich dir ihr euch dein deine tu toi vous ton votre usted ustedes te ti vosotros").split()
NEGATIONS = "not never no nor neither without isn aren wasn weren nicht kein keine nie niemals jamais nunca jamas".split()
REPORTS = ("said says say wrote writes called calls quoted quotes quote reported reports claimed claims according "
           "sagte schrieb dit disait dijo escribió").split()
#: Words that a negation reaches.
REACH = 3
FRAMES = ("plain", "negated", "reported")
CLASSES = [(kind, targeted, frame) for kind in ("insult", "threat") for targeted in (False, True) for frame in FRAMES]
_AT = {c: i for i, c in enumerate(CLASSES)}
#: Weights before anything is learned: a frame weakens what it holds, a target strengthens it.
PRIOR = [{"insult": 1.0, "threat": 0.7}[k] * (1.3 if t else 1.0) * {"plain": 1.0, "negated": 0.3, "reported": 0.3}[f]
         for k, t, f in CLASSES]
CLAUSE_ENDS = ".!?;:\n|"
_CLAUSE_ENDS = re.compile(f"[{CLAUSE_ENDS}]")
_WORD = re.compile(r"[^\W\d_]+")


#: Marks of words, and further marks between transducers: a hit that a negation reaches, a picked hit.
INSULT, THREAT, TARGET, NEGATION, REPORT, WORD = MARKS = ("insult", "threat", "target", "negation", "report", "word")
TARGETED, UNTARGETED = "targeted", "untargeted"


def reached(mark: str) -> str:
    return "negated " + mark


def picked(mark: str) -> str:
    return "picked " + mark


@dataclass
class Transducer:
    """A weighted transducer that reads and writes one mark a step; states are any hashable values.

    ``arcs[state][mark]`` lists (mark written, whether the path takes the word's weight, next state); a mark without an
    arc ends the path. ``ends[state]`` is what it writes at the end of the clause.
    """

    start: Any
    arcs: dict[Any, dict[Any, list[tuple[Any, bool, Any]]]] = field(default_factory=lambda: defaultdict(lambda: defaultdict(list)))
    ends: dict[Any, tuple] = field(default_factory=dict)

    def add(self, state: Any, read: Any, write: Any, to: Any, takes: bool = False) -> None:
        self.arcs[state][read].append((write, takes, to))


def negation(hits: Iterable[str] = (INSULT, THREAT)) -> Transducer:
    """A negation reaches the next REACH words; the state is how many are left."""
    t = Transducer(0)
    for left in range(REACH + 1):
        after = max(0, left - 1)
        for mark in MARKS:
            if mark == NEGATION:
                t.add(left, mark, WORD, REACH)
            else:
                t.add(left, mark, reached(mark) if left and mark in hits else mark, after)
        t.ends[left] = ()
    return t


def pick(hit: str, other: str) -> Transducer:
    """A path may pick one hit, reached by a negation or not, and none after or before a hit of the other kind."""
    t, kinds = Transducer(False), (hit, reached(hit))
    for done in (False, True):
        for mark in (TARGET, REPORT, WORD, other, reached(other)):
            t.add(done, mark, mark, done)
        for mark in kinds:
            t.add(done, mark, WORD, done)
        t.ends[done] = ()
    for mark in kinds:
        t.add(False, mark, picked(mark), True, takes=True)
    for mark in (picked(other), picked(reached(other))):
        t.add(False, mark, mark, True)
    return t


_PICKED = {picked(INSULT): (INSULT, False), picked(reached(INSULT)): (INSULT, True),
           picked(THREAT): (THREAT, False), picked(reached(THREAT)): (THREAT, True)}


def target() -> Transducer:
    """Whether the clause holds a target, before or after its hits, is written at its end."""
    t = Transducer(False)
    for seen in (False, True):
        t.add(seen, TARGET, WORD, True)
        for mark in (REPORT, WORD, *_PICKED):
            t.add(seen, mark, mark, seen)
        t.ends[seen] = (TARGETED if seen else UNTARGETED,)
    return t


def reported_speech() -> Transducer:
    """Keeps the picked hit and whether a verb of report came, and writes the class of clause at the end, if any."""
    t = Transducer((None, False, None))
    for hit in (None, *_PICKED.values()):
        for reports in (False, True):
            here = hit, reports, None
            t.add(here, REPORT, WORD, (hit, True, None))
            t.add(here, WORD, WORD, here)
            for mark, found in _PICKED.items():
                if hit is None:
                    t.add(here, mark, mark, (found, reports, None))
            for mark in (TARGETED, UNTARGETED):
                t.add(here, mark, WORD, (hit, reports, mark == TARGETED))
            for targeted in (False, True):
                frame = "reported" if reports else "negated" if hit and hit[1] else "plain"
                t.ends[hit, reports, targeted] = () if hit is None else ((hit[0], targeted, frame),)
            t.ends[here] = ()
    return t


def machines() -> list[Transducer]:
    """The transducers in the order in which each reads what the one before it writes."""
    return [negation(), pick(INSULT, THREAT), pick(THREAT, INSULT), target(), reported_speech()]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads as ``first`` and writes what ``second`` writes on reading that; reachable states only."""
    out = Transducer((first.start, second.start))
    todo, seen = [out.start], {out.start}
    while todo:
        p, q = state = todo.pop()
        for read, arcs in first.arcs[p].items():
            for between, takes, p2 in arcs:
                for write, takes2, q2 in second.arcs[q].get(between, ()):
                    out.add(state, read, write, (p2, q2), takes or takes2)
                    if (p2, q2) not in seen:
                        seen.add((p2, q2))
                        todo.append((p2, q2))
        if p in first.ends:
            written, at = [], q
            for between in first.ends[p]:
                # at the end of a clause every transducer here has one way on
                [(write, _, at)] = second.arcs[at][between]
                written.append(write)
            if at in second.ends:
                out.ends[state] = (*written, *second.ends[at])
    return out


def _automaton() -> tuple[int, list[dict[str, list[tuple[int, bool]]]], list[int | None], set[int]]:
    """The composed transducer by numbered states: start, arcs, number of the class at the end, and quiet states.

    A plain word leaves a quiet state as it is.
    """
    parts = machines()
    whole = parts[0]
    for part in parts[1:]:
        whole = compose(whole, part)
    number = {s: i for i, s in enumerate(whole.arcs)}
    arcs = [{read: [(number[to], takes) for _, takes, to in ways] for read, ways in whole.arcs[s].items()} for s in number]
    classes = [next((_AT[c] for c in whole.ends.get(s, ()) if c in _AT), None) for s in number]
    return number[whole.start], arcs, classes, {i for i, ways in enumerate(arcs) if ways[WORD] == [(i, False)]}


_START, _ARCS, _CLASS_AT, _QUIET = _automaton()


class Grammar:
    """The composed automaton with a lexicon of insult stems and their weights, which marks the words."""

    def __init__(self, stems: dict[str, float]) -> None:
        self.stems = stems
        self.lengths = sorted({len(s) for s in stems})
        self.marks = {w: m for m, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        starts = [re.escape(s) for s in sorted(stems)] + [f"{t}\\b" for t in THREATS]
        self.pattern = "(?:" + "|".join(starts) + ")"
        self._hits = re.compile(r"(?<![^\W\d_])" + self.pattern)

    def weight(self, word: str) -> float:
        """Weight of the heaviest stem that the word begins with, 0 without one."""
        return max((self.stems.get(word[:n], 0.0) for n in self.lengths if n <= len(word)), default=0.0)

    def mark(self, word: str) -> tuple[str, float]:
        """Mark and weight of a word; a stem goes before a word of the closed classes."""
        weight = self.weight(word)
        return (INSULT, weight) if weight else (self.marks.get(word, WORD), 1.0)

    def clause(self, words: Iterable[str], out: dict[int, float]) -> None:
        """Sum the weights of all paths over a clause of any length and add them to ``out``, by class of clause.

        The paths differ in their picked hit alone, so at most five states are held at a time.
        """
        held, quiet = {_START: 1.0}, True
        for word in words:
            mark, weight = self.mark(word)
            if quiet and mark == WORD:
                continue
            after: dict[int, float] = {}
            for state, value in held.items():
                for to, takes in _ARCS[state].get(mark, ()):
                    after[to] = after.get(to, 0.0) + (value * weight if takes else value)
            held, quiet = after, _QUIET.issuperset(after)
        for state, value in held.items():
            if _CLASS_AT[state] is not None:
                out[_CLASS_AT[state]] += value

    def features(self, text: str) -> list[float]:
        """Per class, the logarithm of one plus what the text's (lower-cased) clauses carry.

        Clauses are read from end mark to end mark, wherever these are; each is read once.
        """
        out: dict[int, float] = defaultdict(float)
        at, size = 0, len(text)
        for hit in self._hits.finditer(text):
            if hit.start() < at:
                continue
            start = max(at, 1 + max(text.rfind(mark, at, hit.start()) for mark in CLAUSE_ENDS))
            end = _CLAUSE_ENDS.search(text, hit.start())
            at = end.end() if end else size
            self.clause((m[0] for m in _WORD.finditer(text, start, at)), out)
        return [math.log1p(out.get(i, 0.0)) for i in range(len(CLASSES))]
