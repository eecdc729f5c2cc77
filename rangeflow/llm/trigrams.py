"""Boolean trigram queries of regular expressions (planning code, runs once on the driver).

A pattern is walked into the strings it must contain: literals grow runs,
alternations and small classes multiply them, and whatever may repeat or be
anything ends a run. Each way through the pattern is a set of trigrams that a
matching text must have; the query is an OR over the ways. A pattern with a
way that has no trigram cannot use an index.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser as parser

GAP = "\0"
#: Characters by how common they are in prose, the commonest first (others are rarer than these).
COMMON = " etaoinsrhldcumfgpwybvkjxqz"
#: A class of more characters than this ends a run; so many ways at most are told apart.
MOST_CHARS, MOST_WAYS = 8, 64


def _ways(tree) -> list[str] | None:
    """Strings with gaps, one for each way through; None if there are too many."""
    ways = [""]
    for op, arg in tree:
        if op is C.LITERAL:
            step = [chr(arg).lower()]
        elif op is C.IN:
            chars = _chars(arg)
            step = sorted(chars) if chars else [GAP]
        elif op is C.BRANCH:
            step = []
            for branch in arg[1]:
                step += _ways(branch) or [GAP]
        elif op is C.SUBPATTERN:
            step = _ways(arg[3]) or [GAP]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, body = arg
            once = _ways(body) or [GAP]
            if (least, most) == (0, 1):
                step = ["", *once]
            elif least == 0:
                step = [GAP]
            else:  # copies of one known string stay together
                times = least if len(once) == 1 else 1
                step = [x * times + ("" if times == most else GAP) for x in once]
        elif op is C.AT:
            continue
        else:
            step = [GAP]
        if len(ways) * len(step) > MOST_WAYS:
            step = [GAP]
        ways = list(dict.fromkeys(a + b for a in ways for b in step))
    return ways


def _chars(items) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            found.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < MOST_CHARS:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_CHARS else None


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of lower-case trigrams; None if a match may have no trigram."""
    clauses = []
    for way in _ways(parser.parse(pattern)) or [GAP]:
        grams = frozenset(run[i : i + 3] for run in way.split(GAP) for i in range(len(run) - 2))
        if not grams:
            return None
        clauses.append(grams)
    # a clause that contains another one adds nothing
    return [c for c in dict.fromkeys(clauses) if not any(d < c for d in clauses)]


def by_rarity(clause: frozenset[str]) -> list[str]:
    """The trigrams of a clause, the one to look for first in front: its first character lets a search skip most places."""
    rank = lambda c: COMMON.index(c) if c in COMMON else len(COMMON)
    first = max(sorted(clause), key=lambda t: (rank(t[0]), sum(map(rank, t))))
    return [first, *sorted(clause - {first}, key=lambda t: (-sum(map(rank, t)), t))]


def one_pass(grams: list[str]) -> str:
    """A Java expression whose group 1 is, at each place of a lower-case text, the trigram that starts there, if asked for.

    The trigrams are a tree by their characters, so that most places end at the first.
    """
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b, c in sorted(grams):
        tree.setdefault(a, {}).setdefault(b, []).append(c)
    one = lambda c: c if c.isalnum() else "\\" + c
    heads = "".join(map(one, tree))
    ways = [one(a) + "(?:" + "|".join(f"{one(b)}[{''.join(map(one, c))}]" for b, c in rest.items()) + ")" for a, rest in tree.items()]
    return f"(?=[{heads}])(?=({'|'.join(ways)}))"
