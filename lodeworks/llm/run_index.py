"""A run-length index of a text: suffix array, run-compressed Burrows-Wheeler transform, matching statistics.

Runs of the transform are where repetitive text is cheap: within a run, the longest match of a suffix
with its predecessor in the suffix array is one less than that of the suffix one place to the left.  So
matches are measured at the run ends that are sampled only, and streamed along the text for
all other places.
"""

from __future__ import annotations

import numpy as np

CHUNK = 7  # symbols of 9 bits in one word


def chunks(text: np.ndarray) -> np.ndarray:
    """The CHUNK symbols from each place on, as one comparable word; text has 9-bit symbols."""
    padded = np.concatenate([text, np.zeros(CHUNK, text.dtype)]).astype(np.uint64)
    word = np.zeros(len(text), np.uint64)
    for j in range(CHUNK):
        word = (word << np.uint64(9)) | padded[j : j + len(text)]
    return word


def suffix_array(text: np.ndarray, word: np.ndarray) -> np.ndarray:
    """By prefix doubling; only places whose group is not yet a single one are sorted again."""
    n = len(text)
    sa = np.argsort(word, kind="stable")
    rank = np.zeros(n, np.int64)

    def regroup(places: np.ndarray, slots: np.ndarray, changes: np.ndarray) -> np.ndarray:
        first = np.maximum.accumulate(np.where(changes, np.arange(len(places)), 0))
        rank[places] = slots[first]
        alone = changes & np.append(changes[1:], True)
        return places[~alone]

    active = regroup(sa, np.arange(n), np.diff(word[sa], prepend=word[sa[:1]] ^ np.uint64(1)) != 0)
    step = CHUNK
    while len(active) and step < n:
        ahead = active + step
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = (rank[active] << 32) | follow
        order = np.argsort(key, kind="stable")
        places, key = active[order], key[order]
        group = key >> 32
        begins = np.maximum.accumulate(np.where(np.diff(group, prepend=-1) != 0, np.arange(len(places)), 0))
        slots = group + np.arange(len(places)) - begins
        sa[slots] = places
        active = regroup(places, slots, np.diff(key, prepend=-1) != 0)
        step *= 2
    return sa


class RunIndex:
    def __init__(self, text: np.ndarray) -> None:
        self.text, self.word = text, chunks(text)
        self.sa = suffix_array(text, self.word)
        transform = text[self.sa - 1].astype(np.int32)
        transform[self.sa == 0] = -1  # nothing stands before the whole text: a run of its own
        self.heads = np.flatnonzero(np.diff(transform, prepend=-2) != 0)
        self.symbols, self.lengths = transform[self.heads], np.diff(self.heads, append=len(text))
        #: Sampled run ends: the text place of each run's head and of the suffix before it, the end of the run above.
        self.head_places, self.end_places = self.sa[self.heads], self.sa[self.heads - 1]

    def _common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many symbols agree from a and from b on, up to about most."""
        n, out = len(self.text), np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        done = 0
        while len(live) and done < most:
            x, y = a[live] + done, b[live] + done
            inside = (x < n) & (y < n)
            differ = self.word[np.minimum(x, n - 1)] ^ self.word[np.minimum(y, n - 1)]
            same = inside & (differ == 0)
            ended = ~same
            agree = sum((differ[ended] >> np.uint64(9 * j) == 0).astype(np.int64) for j in range(CHUNK))
            out[live[ended]] = done + np.where(inside[ended], agree, 0)
            live, done = live[same], done + CHUNK
        out[live] = done
        return out

    def matching_statistics(self, most: int, exact: int = 0) -> np.ndarray:
        """For each place of the text, how long its suffix matches the one before it in the suffix array.

        Measures at run ends stop at `most`; places that such a measure leaves below `exact` are measured themselves.
        """
        sampled = np.full(len(self.text), -1, np.int64)
        measured = self._common(self.head_places, self.end_places, most)
        measured[self.heads == 0] = 0
        sampled[self.head_places] = measured
        last = np.maximum.accumulate(np.where(sampled >= 0, np.arange(len(self.text)), -1))
        place = np.arange(len(self.text))
        match = np.where(last >= 0, np.maximum(0, sampled[last] - (place - last)), 0)
        short = np.flatnonzero((last >= 0) & (sampled[last] >= most) & (match < exact))
        if len(short):
            before = np.empty(len(self.text), np.int64)
            before[self.sa] = np.roll(self.sa, 1)
            match[short] = self._common(short, before[short], exact)
            match[self.sa[0]] = 0
        return match

    def groups(self, length: int, most: int) -> np.ndarray:
        """For each place of the suffix array, the number of its group of suffixes that share `length` symbols."""
        match = self.matching_statistics(most, length)[self.sa]
        return np.cumsum(match < length) - (len(match) > 0 and match[0] < length)
