"""Boolean trigram queries that every match of a regular expression must satisfy.

A query is True (no mandatory trigram: scan), a trigram, or ("and" | "or", parts).
Trigrams are lower case, for an index of lower-cased texts.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser

#: Alternatives of one literal run that are told apart; beyond it the run is given up.
MOST = 32


def _all(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    if not parts or True in parts:
        return True
    held = [trigrams_of(p) for p in parts]
    plain = [isinstance(p, str) or (p[0] == "and" and all(isinstance(x, str) for x in p[1])) for p in parts]
    kept = [p for i, p in enumerate(parts) if not any(i != j and plain[i] and plain[j] and held[j] < held[i] for j in range(len(parts)))]
    return kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _needs(strings: set[str]):
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _chars(items) -> set[str] | None:
    found = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            found.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < MOST:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _walk(nodes) -> tuple[list, set[str] | None]:
    """(queries of what is finished, strings of the run that is open at the end or None if it isn't literal)."""
    done, run, whole = [], {""}, True
    for kind, value in nodes:
        exact = None
        if kind is sre.LITERAL:
            exact = {chr(value).lower()}
        elif kind is sre.IN:
            exact = _chars(value)
        elif kind is sre.SUBPATTERN or kind is sre.BRANCH:
            options = [value[3]] if kind is sre.SUBPATTERN else value[1]
            walked = [_walk(o) for o in options]
            if all(w[1] is not None and not w[0] for w in walked):
                exact = set().union(*(w[1] for w in walked))
            else:
                done.append(_any([_all([*w[0], _needs(w[1] or {""})]) for w in walked]))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, item = value
            queries, strings = _walk(item)
            if (least, most) in ((0, 1), (1, 1)) and strings is not None and not queries:
                exact = strings | ({""} if least == 0 else set())
            elif least >= 1:
                if strings is not None and not queries and least <= 8:
                    joined = {""}
                    for _ in range(least):
                        joined = {a + b for a in joined for b in strings} if len(joined) * len(strings) <= MOST else {""}
                    done.append(_needs({a + b for a in run for b in joined} if len(run) * len(joined) <= MOST else run))
                else:
                    done += queries
        elif kind is sre.AT:
            continue
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
        else:
            done.append(_needs(run))
            run, whole = {""} if exact is None else exact, False
    if not whole:
        done.append(_needs(run))
    return [d for d in done if d is not True], run if whole else None


def trigram_query(pattern: str):
    """The query for `pattern`; True if it has no mandatory trigram."""
    done, run = _walk(_parser.parse(pattern))
    return _all([*done, _needs(run) if run is not None else True])


def trigrams_of(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))
