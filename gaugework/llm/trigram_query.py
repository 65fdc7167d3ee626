"""Boolean trigram queries derived from regular expressions.

A query is a list of clauses that must all hold; a clause is a list of sets of trigrams, one of which
must be present as a whole. No clause: the expression has no mandatory trigram, so it must scan fully.
Queries are over text with A-Z lower-cased; they admit every text that the expression matches.
"""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser as parser

Query = list[list[frozenset[str]]]
#: More spellings of one stretch than this are given up: the stretch then asks for nothing.
SPELLINGS = 64


def _spellings(node) -> set[str] | None:
    """All strings that a node stands for, or None if they are many or endless."""
    op, arg = node
    if op is c.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}
    if op is c.IN and all(x[0] is c.LITERAL for x in arg) and len(arg) <= 8:
        return {chr(x[1]).lower() if x[1] < 128 else chr(x[1]) for x in arg}
    if op is c.MAX_REPEAT and arg[1] <= 2:
        once, found = _sequence(arg[2]), set()
        if once is None:
            return None
        for times in range(arg[0], arg[1] + 1):
            grown = {""}
            for _ in range(times):
                grown = {a + b for a in grown for b in once}
            found |= grown
        return found if len(found) <= SPELLINGS else None
    if op is c.SUBPATTERN:
        return _sequence(arg[3])
    if op is c.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    return None


def _sequence(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        one = _spellings(node)
        if one is None or len(found) * len(one) > SPELLINGS:
            return None
        found = {a + b for a in found for b in one}
    return found


def _clauses(nodes) -> Query:
    """Runs of spelled-out nodes become clauses; what repeats at least once and groups are looked into."""
    query: Query = []
    run = {""}

    def close() -> None:
        nonlocal run
        if all(len(s) >= 3 for s in run):
            ways = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            query.append(sorted((w for w in ways if not any(v < w for v in ways)), key=sorted))
        run = {""}

    for node in nodes:
        one = _spellings(node)
        if one is not None and len(run) * len(one) <= SPELLINGS:
            run = {a + b for a in run for b in one}
            continue
        close()
        op, arg = node
        if one is not None:
            run = one
        elif op is c.SUBPATTERN:
            query += _clauses(arg[3])
        elif op is c.MAX_REPEAT and arg[0] >= 1:
            query += _clauses(arg[2])
    close()
    return query


def derive(pattern: str) -> Query:
    return _clauses(list(parser.parse(pattern, re.IGNORECASE if "(?i:" in pattern else 0)))


def trigrams(query: Query) -> set[str]:
    return {t for clause in query for way in clause for t in way}


def holds(query: Query, present: set[str]) -> bool:
    return all(any(way <= present for way in clause) for clause in query)
