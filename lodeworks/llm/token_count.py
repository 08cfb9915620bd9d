"""Token counts by heap-and-linked-list byte-pair merging, without building token ids.

A word is a linked list of its byte symbols, the last one marked as the word's end.  A heap holds the
adjacent pairs that have a merge, by rank and then position; the lowest is popped again and again,
pairs that no longer stand are passed over, the right symbol is unlinked and the pairs with both
neighbours are pushed.  The word's count is its symbols at the start minus the merges made.

Texts are prepared as the vocabulary file says: special tokens' strings are found first (one token
each), then NFC, lower case, and words by the file's pattern, white space dropped.  Chunks with
characters beyond Latin letters are prepared by the library's own normaliser and pre-tokenizer, since
Unicode tables of other libraries may be older or newer; merges are counted here in any case.  Blanks never
belong to a word, so Arrow cuts texts at them and dictionary-encodes the chunks, and each distinct
chunk of a batch is counted once; a worker remembers a bounded number of words between batches.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.byte_bpe import byte_alphabet, slices
from lodeworks.llm.common import id_and_text

#: Words remembered by a worker; beyond that it starts anew.
REMEMBERED = 500_000
LIMIT = 2048
BEYOND_LATIN = "\u0250"


class MergeCounter:
    """Counts for a vocabulary file whose merges act on byte symbols with an end-of-word mark."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {pair: (rank, pair[0] + pair[1]) for rank, pair in enumerate(merges)}
        self.symbol = {b: c for c, b in byte_alphabet().items()}
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.known: dict[str, int] = {}
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if spec.get("post_processor") or not self.mark:
            raise ValueError("this vocabulary file needs other steps than the counter takes")

    def count_word(self, word: str) -> int:
        return self.count_symbols([self.symbol[b] for b in word.encode()])

    def count_symbols(self, symbols: list[str]) -> int:
        symbols[-1] += self.mark
        n = len(symbols)
        if n == 1:
            return 1
        merges = self.merges
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, left = [*range(1, n), -1], [*range(-1, n - 1)], n
        while heap:
            _, i, merged = heapq.heappop(heap)
            if (j := after[i]) < 0 or symbols[i] is None or symbols[i] + symbols[j] != merged or merges[symbols[i], symbols[j]][1] != merged:
                continue
            symbols[i], symbols[j] = merged, None
            k = after[i] = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                if m := merges.get((merged, symbols[k])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (k := before[i]) >= 0 and (m := merges.get((symbols[k], merged))):
                heapq.heappush(heap, (m[0], k, m[1]))
        return left

    def count_plain(self, text: str) -> int:
        """Of a text without special tokens' strings."""
        if not text.isascii() and max(text) >= BEYOND_LATIN:
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return sum(self.count_symbols(list(word)) for word, _ in pieces if word)
        known, total = self.known, 0
        for word in self.words.findall(unicodedata.normalize("NFC", text).lower()):
            n = known.get(word)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[word] = self.count_word(word)
            total += n
        return total

    def count_text(self, text: str) -> int:
        if self.special is None:
            return self.count_plain(text)
        found = len(self.special.findall(text))
        return found + sum(self.count_plain(part) for part in (self.special.split(text) if found else [text]))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Chunk by chunk: special tokens' strings have no blanks, and neither NFC nor lower case reaches over one."""
        if not len(texts):
            return np.zeros(0, np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offsets, coded = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        each = np.array([self.count_text(c) for c in coded.dictionary.to_pylist()], np.int64)
        return np.add.reduceat(each[coded.indices.to_numpy()], offsets[:-1])


_loaded: dict[str, MergeCounter] = {}


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of docs.

    Defined cases: null counts as empty (0 bytes, 0 tokens); repeated rows give repeated rows; an
    empty table gives an empty result; other columns are ignored.  Texts of any length are counted
    whole; one text must fit a worker's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if vocabulary_path not in _loaded:
            _loaded[vocabulary_path] = MergeCounter(vocabulary_path)
        counter = _loaded[vocabulary_path]
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                n_bytes = pc.binary_length(text).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n_bytes, pa.array(counter.count(text))], ["doc_id", "n_bytes", "n_tokens"])

    counted = id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
