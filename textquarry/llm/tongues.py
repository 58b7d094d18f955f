"""Languages told by the letter groups of their words, with a class for every language that isn't known."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from random import Random

VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
#: Probability of a letter group where nothing is known of it: as if drawn from so many letters.
_LETTERS = 30.0
_CACHE = 200_000


def disguised(text: str, r: Random) -> str:
    """``text`` in a language of no one: letters replaced by others of their kind, the same for the same, in this text."""
    out = dict(zip(VOWELS, r.sample(VOWELS, 5))) | dict(zip(CONSONANTS, r.sample(CONSONANTS, len(CONSONANTS))))
    return "".join(out.get(c, c) if c.islower() else out.get(c.lower(), c).upper() for c in text)


#: Weights of letter groups are whole multiples of one over this, so that their sum doesn't depend on the order.
_UNIT = 1 << 20


def letter_groups(word: str, times: int) -> Iterator[tuple[str, str, int]]:
    """``(up to two letters before, letter, weight)`` of a word found so many times; frequent words count, but not for all."""
    n = round((1 + math.log(times)) * _UNIT)
    padded = f"  {word} "
    for i in range(2, len(padded)):
        for k in range(3):
            yield padded[i - k : i], padded[i], n


class Tongues:
    """Log probabilities of words in each known language and, last, in any other.

    A word is a walk over its letters, each given the two before it, with
    counts of one, two and three letters mixed. The language of no one mixes
    what foreign examples hold with letters drawn at random, so a word of a
    language never seen is likelier there than in any that is known.
    """

    def __init__(self, names: list[str], groups: Iterable[tuple[int, str, str, int]]):
        """``groups``: for the number of a name, letter groups and the sum of their weights. The last name is the other language."""
        self.names = names
        counts: list[list[dict[str, Counter]]] = [[defaultdict(Counter) for _ in range(3)] for _ in names]
        for k, before, letter, n in groups:
            counts[k][len(before)][before][letter] += n / _UNIT
        self._models = [[{before: (c, math.fsum(c.values())) for before, c in g.items()} for g in m] for m in counts]
        self._known: dict[str, tuple[float, ...]] = {}

    def _log(self, model, word: str, floor: float) -> float:
        total, padded = 0.0, f"  {word} "
        for i in range(2, len(padded)):
            p = 1 / _LETTERS if ord(padded[i]) < 0x250 else 1 / 2000
            for k, most in ((0, 0.9), (1, 0.9), (2, floor)):
                held = model[k].get(padded[i - k : i])
                if held:
                    weight = most * held[1] / (held[1] + 4)
                    p = weight * held[0][padded[i]] / held[1] + (1 - weight) * p
            total += math.log(p)
        return total

    def word(self, word: str) -> tuple[float, ...]:
        """Log probabilities of a word by language, the other last; no word tells more than a few letters do."""
        found = self._known.get(word)
        if found is None:
            w = word[:24]
            raw = [self._log(m, w, 0.9) for m in self._models[:-1]]
            raw.append(self._log(self._models[-1], w, 0.5))
            best = max(raw)
            found = tuple(max(x - best, -6.0) for x in raw)
            if len(self._known) >= _CACHE:
                self._known.clear()
            self._known[word] = found
        return found
