"""What a text must hold for an expression to match it: literals drawn from the expression.

The answer is a list of alternatives, all of which must hold: a line matches only if, for each of them, it has at least one of its
literals. Literals are lower-case ASCII, to be looked for in lower-case text; anything that gives none (classes,
options, look-arounds, letters beyond ASCII) is passed over, so the answer is never too strict.
"""

from __future__ import annotations

import functools
import re
from re import _constants as C, _parser

#: Literals of one alternative, at most; an expression with more gives no such alternative.
MOST = 64
#: Stands in a run of letters where the expression asks for a word edge; never a letter of a run.
EDGE = "\n"
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def _runs(nodes, found: list[frozenset[str]], least: int) -> None:
    """Alternatives of a sequence of parsed nodes, appended to ``found``."""
    run: list[str] = []

    def close() -> None:
        word = _edged("".join(run))
        if len(word.strip(EDGE)) >= least:
            found.append(frozenset([word]))
        run.clear()

    for op, arg in nodes:
        if op is C.LITERAL and arg < 128 and arg not in (10, 13):
            run.append(chr(arg).lower())
            continue
        if op is C.AT:  # an anchor takes no room
            if arg is C.AT_BOUNDARY:
                run.append(EDGE)
            continue
        if op is C.MAX_REPEAT or op is C.MIN_REPEAT or op is C.POSSESSIVE_REPEAT:
            low, high, body = arg
            if low == high == 1:
                _nested(body, run, close, found, least)
                continue
            close()
            if low:
                _runs(body, found, least)
            continue
        if op is C.SUBPATTERN:
            _nested(arg[3], run, close, found, least)
            continue
        if op is C.ATOMIC_GROUP:
            _nested(arg, run, close, found, least)
            continue
        close()
        if op is C.BRANCH:
            words: set[str] = set()
            for way in arg[1]:
                inner: list[frozenset[str]] = []
                _runs(way, inner, least)
                if not inner:
                    break
                words |= max(inner, key=lambda w: min(len(x.strip(EDGE)) for x in w))
            else:
                if len(words) <= MOST:
                    found.append(frozenset(words))
    close()


def _edged(run: str) -> str:
    """The letters of a run, with ``EDGE`` at an end where a word edge is asked of a word character."""
    word = run.replace(EDGE, "")
    left = run[:1] == EDGE and word[:1] in _WORD
    right = run[-1:] == EDGE and word[-1:] in _WORD
    return EDGE * (word != "" and left) + word + EDGE * (word != "" and right)


def _nested(body, run: list[str], close, found: list[frozenset[str]], least: int) -> None:
    """A group inside a sequence: plain letters go on with the run around it, anything else stands for itself."""
    if all(op is C.LITERAL and arg < 128 and arg not in (10, 13) for op, arg in body):
        run.extend(chr(arg).lower() for _, arg in body)
        return
    close()
    _runs(body, found, least)


def edged(pattern: str, least: int = 3) -> tuple[frozenset[str], ...]:
    """As ``required``, but a literal that only counts at a word edge has ``EDGE`` at that end."""
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ()  # an expression that only the JVM understands
    if tree.state.flags & re.VERBOSE:
        return ()
    found: list[frozenset[str]] = []
    _runs(tree, found, least)
    return tuple(dict.fromkeys(found))


@functools.lru_cache(maxsize=50_000)
def required(pattern: str, least: int = 3) -> tuple[frozenset[str], ...]:
    """Alternatives of literals of at least ``least`` letters; none if nothing is sure."""
    return tuple(dict.fromkeys(frozenset(w.strip(EDGE) for w in words) for words in edged(pattern, least)))


def grams(word: str, n: int = 3) -> set[str]:
    return {word[i : i + n] for i in range(len(word) - n + 1)}
