"""Token identifiers of whole texts, as the tokenizers library gives them, encoded chunk by chunk.

The byte-level pattern starts a new piece at every single blank between two non-blank characters, so
a text may be cut there and each chunk (a blank and what follows it) be encoded alone.  A batch's
chunks are dictionary-encoded by Arrow, each distinct chunk is encoded once, and the documents' ids
are gathered from those.  The distinct chunks, joined by blanks, are encoded in one call with the
merge ranks of the same .json file by tiktoken's byte-pair encoder (a chunk starts at each id whose
bytes start with a blank), which is much faster than the library; every batch compares its first
documents with the tokenizers library and stops the job if they ever differ.
Texts with two blanks in a row are encoded whole, texts with the string of a special token whole and
by the library itself.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The byte-level pre-tokenizer's pattern (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COMPARED = 2
BATCH_BYTES = 24 << 20


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        alphabet = byte_alphabet()
        vocab = json.loads(self.library.to_str())["model"]["vocab"]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in added}
        self.blank_first = np.zeros(max(ranks.values()) + 1, bool)
        self.blank_first[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self.special, self.encoder = added, tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def one(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.encoder.encode_ordinary(text)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = pc.match_substring(texts, "  ")
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        offsets = lists.offsets.to_numpy()
        chunks = lists.flatten()
        coded = chunks.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        distinct = pc.if_else(pc.equal(coded.dictionary, ""), "_", coded.dictionary)  # a blank alone is set right below
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " ")[0].as_py() if len(distinct) else ""
        pool = self.encoder.encode_to_numpy(" " + joined) if len(distinct) else np.zeros(0, np.uint32)
        begins = np.flatnonzero(self.blank_first[pool])
        if len(begins) != len(distinct):
            raise ValueError("chunks and their first ids differ in number")
        n_distinct, lengths_by_code = len(distinct), np.diff(begins, append=len(pool))
        # Codes of their own: a text's first chunk, which has no blank before it; a blank with nothing behind it.
        firsts = [self.one(texts[i].as_py()) if w else self.encoder.encode_ordinary(first) for i, (first, w) in enumerate(zip(chunks.take(pa.array(offsets[:-1])).to_pylist(), whole.to_pylist()))]
        firsts.append(self.encoder.encode_ordinary(" "))
        empty = pc.index(coded.dictionary, "").as_py()
        if empty >= 0:
            codes[codes == empty] = n_distinct + len(texts)
        codes[offsets[:-1]] = np.arange(n_distinct, n_distinct + len(texts))
        lengths_by_code = np.concatenate([lengths_by_code, np.fromiter(map(len, firsts), np.int64, len(firsts))])
        pool = np.concatenate([pool, np.fromiter(chain.from_iterable(firsts), np.uint32)])
        starts_by_code = np.cumsum(lengths_by_code) - lengths_by_code
        lengths = lengths_by_code[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        flat = pool[np.arange(total) + np.repeat(starts_by_code[codes] - (ends - lengths), lengths)]
        counts = np.add.reduceat(lengths, offsets[:-1])
        at = 0
        for i in range(min(COMPARED, len(texts))):
            if flat[at : at + counts[i]].tolist() != self.library.encode(texts[i].as_py(), add_special_tokens=False).ids:
                raise ValueError("chunk-wise encoding differs from the tokenizers library")
            at += counts[i]
        return flat, counts


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One for each worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def slices(batch: pa.RecordBatch, most: int = BATCH_BYTES):
    """The batch in row ranges of about `most` bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def with_end(flat: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id behind each document."""
    ends = np.cumsum(counts)
    return np.insert(flat, ends, np.uint32(end_id)).astype(np.uint32), counts + 1
