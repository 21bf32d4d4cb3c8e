"""Search of a page for the lines most like a piece of code.

Kinds and forms are columns (see operators.code); here only the sequence matcher runs, and only where bounds leave it a chance:
first shared characters, then the longest common subsequence, of which the matcher's blocks are always a part.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np

from foliospark.functions.text import NEARLY, OVERLAP_WEIGHT


def overlap(a: str, b: str) -> float:
    """Weighed overlap of the words of two forms, neither empty."""
    one, two = set(a.split()), set(b.split())
    return OVERLAP_WEIGHT * len(one & two) / len(one | two)


def likeness(a: str, b: str, natural: bool) -> float:
    """Ratio of two forms; of natural language that is little alike the weighed overlap of words if it is more. 0 if either is empty."""
    if not a or not b:
        return 0.0
    ratio = 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
    return max(ratio, overlap(a, b)) if natural and ratio < NEARLY else ratio


def likeness_from(page: Lanes, seeds: Seeds, natural: bool, least: float) -> float | None:
    """likeness(a, b, natural) of a page's only lane and a prepared text if it is `least` or more, else None."""
    (a,), b = page.texts, seeds.text
    if not a or not b:
        return 0.0 if least <= 0 else None
    words = overlap(a, b) if natural else 0.0
    if words >= least:  # whatever the ratio
        return likeness(a, b, natural)
    n = len(a) + len(b)
    enough = lambda shared: 2.0 * shared / n >= least
    shortest = min(len(a), len(b))
    likely = seeds.frequent and enough(shortest // 2)  # the bound would hardly tell, and the matcher takes little
    if not enough(shortest) or not (likely or enough(page.common(b)[0])):
        return None
    shared = blocks(a, seeds, least * n / 2 - 1, page.places) if seeds.frequent else sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
    return 2.0 * shared / n if enough(shared) else None


def at_most(a: str, b: str, natural: bool) -> float:
    """A cheap bound that likeness never exceeds: shared characters whatever their order."""
    if not a or not b:
        return 0.0
    matcher = SequenceMatcher(None, a, b)
    value = min(matcher.real_quick_ratio(), matcher.quick_ratio())
    return max(value, OVERLAP_WEIGHT) if natural else value


class Seeds:
    """A text as the sequence matcher's second side, prepared once for many first sides: the places of the characters at which a block may begin.

    As in the matcher, characters that are frequent in a text of 200 or more begin no block.
    """

    def __init__(self, text: str) -> None:
        self.text, self.frequent = text, len(text) >= 200
        self.places = places_of(text, len(text) // 100 + 1 if self.frequent else len(text))


def places_of(text: str, most: int) -> dict[str, list[int]]:
    """Places of the characters that occur at most so many times in a text."""
    places: dict[str, list[int]] = {c: [] for c, n in Counter(text).items() if n <= most}
    for j, c in enumerate(text):
        if c in places:
            places[c].append(j)
    return places


def blocks(a: str, seeds: Seeds, least: float = 0, places: dict[str, list[int]] | None = None) -> int:
    """Number of characters in the matching blocks of the sequence matcher; -1 as soon as it can't reach `least`. places: those of all characters of a.

    All diagonal runs of seeds are found first; the matcher's search in a range is then a choice among the runs that lie in it.
    """
    b, width = seeds.text, len(seeds.text) + 1
    there = (places_of(a, len(a)) if places is None else places).get
    pairs = {i * width + j for c, js in seeds.places.items() for i in there(c, ()) for j in js}
    runs = []
    for at in pairs:
        if at - width - 1 not in pairs:
            n, end = 1, at + width + 1
            while end in pairs:
                n, end = n + 1, end + width + 1
            runs.append((n, -(at // width), -(at % width)))  # the longest, then the first, is the greatest
    found, left = 0, min(len(a), len(b))
    ranges = [(0, len(a), 0, len(b), runs)]
    while ranges:
        alo, ahi, blo, bhi, inside = ranges.pop()
        left -= min(ahi - alo, bhi - blo)
        n, i, j = max(inside) if inside else (0, -alo, -blo)
        i, j = -i, -j
        end_a, end_b = i + n, j + n
        while n and i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while end_a < ahi and end_b < bhi and a[end_a] == b[end_b]:
            end_a, end_b = end_a + 1, end_b + 1
        if end_a == i:
            continue
        found += end_a - i
        for lo, hi, low, high in ((alo, i, blo, j), (end_a, ahi, end_b, bhi)):
            # a range without runs can only have a block at the texts' begin: elsewhere it begins where the block before it had to end
            if lo < hi and low < high and ((within := clipped(inside, lo, hi, low, high)) or lo == low == 0):
                left += min(hi - lo, high - low)
                ranges.append((lo, hi, low, high, within))
        if found + left < least:
            return -1
    return found


class Lanes:
    """Texts without line breaks side by side in one bit vector: the longest common subsequence of another text with each of them takes one pass."""

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.spans, at = texts, [], 0
        for x in texts:
            self.spans.append((at, at + len(x)))
            at += len(x) + 1
        self.size = at

    @functools.cached_property
    def masks(self) -> dict[str, int]:
        codes = np.frombuffer("".join(x + "\n" for x in self.texts).encode("utf-32-le"), "<u4")
        there = np.unique(codes)
        bits = np.packbits(codes == there[:, None], axis=1, bitorder="little")
        return {chr(c): int.from_bytes(row.tobytes(), "little") for c, row in zip(there.tolist(), bits)}

    @functools.cached_property
    def places(self) -> dict[str, list[int]]:
        """Places of the characters of the first text."""
        return places_of(self.texts[0], len(self.texts[0]))

    def common(self, text: str) -> list[int]:
        """Length of the longest common subsequence of a text with each lane."""
        left = all_ = ((1 << self.size) - 1) ^ self.masks["\n"]  # a lane's carry ends in its line break
        for mask in map(self.masks.get, text):
            if mask:
                hit = left & mask
                left = (left + hit | left ^ hit) & all_
        missed = f"{left:0{self.size}b}"[::-1]
        return [hi - lo - missed.count("1", lo, hi) for lo, hi in self.spans]


def clipped(runs: list, alo: int, ahi: int, blo: int, bhi: int) -> list:
    """The parts of diagonal runs that lie in a range."""
    out = []
    for run in runs:
        n, i, j = run
        if -i < ahi and -j < bhi and n - i > alo and n - j > blo:
            if -i >= alo and -j >= blo and n - i <= ahi and n - j <= bhi:
                out.append(run)
            else:
                cut = max(alo + i, blo + j, 0)
                if (size := min(n, ahi + i, bhi + j) - cut) > 0:
                    out.append((size, i - cut, j - cut))
    return out


def first_best(bounds: list[float], exact: Callable[[int], float]) -> tuple[int, float]:
    """Place and value of the greatest exact(i), the first of equals; places are tried by falling bound until no bound is above the best."""
    best, at = -1.0, -1
    for i in sorted(range(len(bounds)), key=lambda k: (-bounds[k], k)):
        if bounds[i] < best:
            break
        value = exact(i)
        if value > best or (value == best and i < at):
            best, at = value, i
    return at, best


def best_window(size: int, code: str, natural: bool, lines: list[str], blank: list[bool], marked: list[bool]) -> tuple[int, int, float] | None:
    """(first line, lines, score) of the run of a page's lines most like a piece of code of `size` lines; None if all are blank.

    Runs have as many lines, two more, or one less, and are tried in this order; those of the same number count 1.1 times, those
    with a marked line 1.05 times. lines: forms; a run's form is the joined forms of its lines.
    """
    runs = [(at, n) for n in (size, size + 2, size - 1) if n > 0 for at in range(len(lines) - n + 1) if not all(blank[at : at + n])]
    if not runs:
        return None
    forms = [" ".join(filter(None, lines[at : at + n])) for at, n in runs]
    weights = [(1.1 if n == size else 1.0) * (1.05 if any(marked[at : at + n]) else 1.0) for at, n in runs]
    i, best = first_best([at_most(code, f, natural) * w for f, w in zip(forms, weights)], lambda i: likeness(code, forms[i], natural) * weights[i])
    return (*runs[i], best)


class PageLines:
    """A page's lines (forms, whether each is compared in the aggressive form, whether it is natural language), prepared once for many pieces of code."""

    def __init__(self, forms: list[str], hard: list[bool], natural: list[bool]) -> None:
        self.forms, self.hard, self.natural = forms, hard, natural
        self.sides = [(places, Lanes([forms[i] for i in places])) for side in (False, True) for places in [[i for i, h in enumerate(hard) if bool(h) == side]]]
        self.words = [set(f.split()) if n else None for f, n in zip(forms, natural)]

    def bounds(self, plain: str, hard: str) -> list[float]:
        """For each line a bound that its likeness to a wanted line, given in both forms, never exceeds."""
        out = [0.0] * len(self.forms)
        for (places, lanes), text in zip(self.sides, (plain, hard)):
            if places and text:
                words = set(text.split())
                for i, shared in zip(places, lanes.common(text)):
                    if self.forms[i]:
                        out[i] = 2.0 * shared / (len(self.forms[i]) + len(text))
                        if (own := self.words[i]) is not None and not own.isdisjoint(words):
                            out[i] = max(out[i], OVERLAP_WEIGHT * len(own & words) / len(own | words))
        return out


def best_run(wanted: list[dict], lines: list[dict]) -> tuple[int, float] | None:
    """(first line, mean likeness) of the run of a page's lines that is on average most like the wanted lines; None for one line or too few.

    wanted: plain and hard forms; lines: form, hard, natural. A page's line decides in which form two lines are compared.
    """
    if len(wanted) < 2 or len(lines) < len(wanted):
        return None
    return run_from([w["plain"] for w in wanted], [w["hard"] for w in wanted], PageLines(*([x[k] for x in lines] for k in ("form", "hard", "natural"))), 0.0)


def run_from(plain: list[str], hard: list[str], page: PageLines, least: float) -> tuple[int, float] | None:
    """best_run of a prepared page if its mean likeness is `least` or more, else None."""
    n, forms = len(plain), page.forms
    if n < 2 or len(forms) < n:
        return None
    bounds = [page.bounds(*forms_) for forms_ in zip(plain, hard)]
    means = [sum(bounds[j][at + j] for j in range(n)) / n for at in range(len(forms) - n + 1)]
    likely = [at for at, mean in enumerate(means) if mean >= least]
    if not likely:
        return None
    value = functools.cache(lambda i, j: likeness(forms[i], hard[j] if page.hard[i] else plain[j], page.natural[i]))
    place, score = first_best([means[at] for at in likely], lambda k: sum(value(likely[k] + j, j) for j in range(n)) / n)
    return (likely[place], score) if score >= least else None
