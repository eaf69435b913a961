"""Strings without which a pattern cannot fit, read off the pattern itself.

Looking for a set of strings with one automaton is many times cheaper than trying patterns, and
it loses nothing if each match of a pattern contains one of the strings. :func:`required` derives
them, so the two cannot drift apart. Strings are in lower case and are looked for in
``str.lower()`` of a text.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable

import ahocorasick

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    import re._constants as _c
    import re._parser as _p

#: A class of so few characters is spelt out.
_SPELT = 4


def _product(a: set[str], b: set[str]) -> set[str]:
    return {x + y for x in a for y in b}


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The stricter of two sets of strings: the longer shortest member, then the fewer members."""
    if a is None or b is None:
        return b if a is None else a
    return a if (min(map(len, a)), -len(a)) >= (min(map(len, b)), -len(b)) else b


def _spelt(items: list) -> set[str] | None:
    """Characters of a class of few, else null."""
    out: set[str] = set()
    for op, av in items:
        if op is _c.LITERAL:
            out.add(chr(av).lower())
        elif op is _c.RANGE and av[1] - av[0] < _SPELT:
            out |= {chr(x).lower() for x in range(av[0], av[1] + 1)}
        else:
            return None
    return out if len(out) <= _SPELT else None


def _of(tree) -> set[str] | None:
    """Strings of which every match of ``tree`` contains one; null if there are none."""
    best: set[str] | None = None
    run: set[str] = {""}

    def close() -> None:
        nonlocal best, run
        if "" not in run:
            best = _better(best, run)
        run = {""}

    for op, av in tree:
        exact: set[str] | None = None
        if op is _c.LITERAL:
            exact = {chr(av).lower()}
        elif op is _c.IN:
            exact = _spelt(av)
        elif op in (_c.SUBPATTERN, _c.ATOMIC_GROUP):
            inner = av[-1] if op is _c.SUBPATTERN else av
            exact = _whole(inner)
            if exact is None:
                close()
                best = _better(best, _of(inner))
                continue
        elif op is _c.BRANCH:
            exact = _whole([(op, av)])
            if exact is None:
                close()
                each = [_of(x) for x in av[1]]
                if all(x is not None for x in each):
                    best = _better(best, set().union(*each))
                continue
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT):
            low, high, inner = av
            if (low, high) == (0, 1):
                exact = _whole([(op, av)])
            if exact is None:
                close()
                if low >= 1:
                    best = _better(best, _of(inner))
                continue
        elif op in (_c.AT, _c.ASSERT, _c.ASSERT_NOT):
            continue  # takes no characters, so what is before and after stays together
        if exact is None or len(run) * len(exact) > 64:
            close()
            if exact is not None:
                run = set(exact)
            continue
        run = _product(run, exact)
    close()
    return best


def _whole(tree) -> set[str] | None:
    """All strings that ``tree`` fits, if they are few and plain; else null."""
    out = {""}
    for op, av in tree:
        if op is _c.LITERAL:
            one: set[str] | None = {chr(av).lower()}
        elif op is _c.IN:
            one = _spelt(av)
        elif op is _c.SUBPATTERN:
            one = _whole(av[-1])
        elif op is _c.BRANCH:
            each = [_whole(x) for x in av[1]]
            one = set().union(*each) if all(x is not None for x in each) else None
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and av[:2] == (0, 1):
            inner = _whole(av[2])
            one = None if inner is None else inner | {""}
        else:
            one = None
        if one is None or len(out) * len(one) > 64:
            return None
        out = _product(out, one)
    return out


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern outside its brackets."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
        i += 1
    return [*out, pattern[at:]]


def required(pattern: str) -> frozenset[str]:
    """Strings in lower case of which every match of ``pattern``, taken in lower case, contains one. A
    pattern without any is an error."""
    found = _of(_p.parse(pattern))
    if not found:
        raise ValueError(f"no string is required by {pattern}")
    return frozenset(found)


class Finder:
    """Looks for the strings that ``patterns`` require: which of them may fit a text."""

    def __init__(self, patterns: Iterable[str]) -> None:
        self._automaton = ahocorasick.Automaton()
        by: dict[str, set[int]] = {}
        for i, p in enumerate(patterns):
            for s in required(p):
                by.setdefault(s, set()).add(i)
        for s, who in by.items():
            self._automaton.add_word(s, tuple(sorted(who)))
        self._automaton.make_automaton()

    def any(self, text: str) -> bool:
        return next(self._automaton.iter(text.lower()), None) is not None

    def candidates(self, text: str) -> set[int]:
        """Numbers of the patterns that may fit ``text``."""
        out: set[int] = set()
        for _, who in self._automaton.iter(text.lower()):
            out.update(who)
        return out


def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.I)
