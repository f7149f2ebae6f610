"""Many patterns over many texts: an automaton over the letters that each pattern needs tells which patterns to try."""

from __future__ import annotations

import re
from re import _constants as codes
from re import _parser as parser

import ahocorasick

#: What a letter stands for besides its own cases, wherever case is ignored.
_ALIKE = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "K": "k"})


def folded(text: str) -> str:
    """The text in which needed letters are looked for."""
    return text.translate(_ALIKE).lower()


def needed(pattern: str) -> str:
    """The longest run of ASCII characters, in lower case, that every match of a pattern holds; empty if none is known."""
    runs: list[str] = []

    def walk(parts, run: str) -> str:
        for op, value in parts:
            if op is codes.LITERAL and value < 128:
                run += chr(value).lower()
            elif op is codes.SUBPATTERN and not value[1] and not value[2]:
                run = walk(value[3], run)
            elif op is codes.AT:
                continue
            else:
                runs.append(run)
                run = ""
                if op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT) and value[0] >= 1:
                    runs.append(walk(value[2], ""))
        return run

    runs.append(walk(parser.parse(pattern, re.IGNORECASE), ""))
    return max(runs, key=len)


class Finder:
    """Names of patterns by what they need: candidates(text) has all that may match it, in the order given, and some that do not."""

    def __init__(self, needs: list[str]):
        self.always = [i for i, n in enumerate(needs) if not n]
        by_need: dict[str, list[int]] = {}
        for i, n in enumerate(needs):
            if n:
                by_need.setdefault(n, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for n, owners in by_need.items():
            self.automaton.add_word(n, owners)
        if by_need:
            self.automaton.make_automaton()
        self.any = bool(by_need)

    def candidates(self, text: str) -> list[int]:
        found = set(self.always)
        if self.any:
            for _, owners in self.automaton.iter(folded(text)):
                found.update(owners)
        return sorted(found)
