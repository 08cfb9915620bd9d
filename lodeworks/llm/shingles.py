"""Sets of word-shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from lodeworks.llm.common import mix64

SEED = 42
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' 64-bit hashes (letters A-Z lowered, words parted by ASCII blanks), text after text, and where each text ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    if "" in words:  # blanks at an end of a text
        solid = codes != words.index("")
        ends = np.cumsum(solid)[ends - 1] * (ends > 0) if len(codes) else ends
        codes = codes[solid]
    return hashes[codes], ends


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `words` words; of all its words, if there are fewer."""
    return (s for s, _ in shingle_and_word_sets(texts, words))


def shingle_and_word_sets(texts: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of shingle_sets, and the hashes of each text's words, repeats included."""
    flat, ends = word_hashes(texts)
    runs = np.zeros(len(flat), np.uint64)  # of the run that begins at each word, across texts too; those are not used
    for k in range(words):
        part = np.zeros(len(flat), np.uint64)
        part[: max(0, len(flat) - k)] = flat[k:]
        runs = mix64(runs * FACTOR + part)
    begin = 0
    for end in ends.tolist():
        n = end - begin
        if n >= words:
            found = np.unique(runs[begin : end - words + 1])
        elif n:
            found = np.zeros(1, np.uint64)
            for w in flat[begin:end]:
                found = mix64(found * FACTOR + w)
            found = mix64(found + np.uint64(n))
        else:
            found = flat[:0]
        yield found, flat[begin:end]
        begin = end
