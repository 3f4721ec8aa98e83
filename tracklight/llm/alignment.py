"""Word-level edit distance by banded alignment."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def band_distance(a: Sequence, b: Sequence, k: int) -> int:
    """Edit distance of two sequences whose lengths differ by k at most, exact where it is k at most.

    The alignment stays within k of the main diagonal. A column of the band is held as the bits of whole numbers
    (vertical steps up and down), and one column is made from the last with a few operations on them.
    """
    m, width = len(a), 2 * k + 1
    full = (1 << width) - 1
    where: dict = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    up, down = full & ~((1 << k) - 1), 0  # bit t of column j is row j - k + t
    score = min(k, m)
    for j, word in enumerate(b, 1):
        same = where.get(word, 0)
        same = (same >> (j - k - 1) if j > k else same << (k + 1 - j)) & full
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        across_up = down | (full & ~(diagonal | up))
        across_down = diagonal & up
        if j + k <= m:  # the lowest cell of the band
            score += 1 - (diagonal >> (width - 1) & 1)
        else:  # the last row
            t = m - j + k
            score += (across_up >> t & 1) - (across_down >> t & 1)
        shifted = diagonal >> 1
        up = across_down | (full & ~(shifted | across_up))
        down = shifted & across_up
    return score


def distance_within(a: list, b: list, limit: int) -> int | None:
    """Edit distance of two word lists if it is ``limit`` at most, else None."""
    if abs(len(a) - len(b)) > limit:
        return None
    start, least = 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        distance = max(len(a), len(b))
        return distance if distance <= limit else None
    left, right = Counter(a), Counter(b)
    apart = max((left - right).total(), (right - left).total())
    if apart > limit:
        return None
    k = max(apart, abs(len(a) - len(b)), 4)
    while True:
        k = min(k, limit)
        distance = band_distance(a, b, k)
        if distance <= k:
            return distance
        if k == limit:
            return None
        k *= 4


def words_of(text: str) -> list[str]:
    return WORDS.findall(text)


def similar_words(x: list[str], y: list[str], least: float) -> bool:
    """Whether 1 - distance / length of the longer is at least ``least``, in words."""
    longest = max(len(x), len(y))
    return distance_within(x, y, int((1 - least) * longest + 1e-9)) is not None
