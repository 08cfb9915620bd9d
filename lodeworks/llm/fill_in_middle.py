"""Fill-in-middle transformation: a text becomes prefix, suffix and middle, cut at token boundaries.

Tokens are blanks with the word behind them, or blanks at the end.  Their boundaries come from whole-text arithmetic
instead of a scan by pattern: bytes.translate turns the UTF-8 bytes into a mask of one digit a byte, which is read as one big integer
with bit i for byte i; a token starts where a blank has no blank before it (the mask and the complement of itself
shifted by one), and at byte 0.  bit_count() is the number of tokens, the k-th start is found by halving
the integer and counting the bits of the lower half.  All of it is linear in the text, in C.

Defined cases: a null text is an empty one, which is plain with n = 0; a null doc_id is hashed as no digits; repeated rows
and ids are rows of their own, equal ids and texts get equal results; an empty table gives an empty result; other columns are
ignored, whatever their names.  Any length of text does: a task holds a batch of about 8 MB of text, or one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.byte_bpe import slices
from lodeworks.llm.common import binary_column, id_and_text

BLANKS = b" \t\n\v\f\r"
#: Digit 1 for the bytes of the class, 0 for others.
BLANK_MASK = bytes(0x31 if b in BLANKS else 0x30 for b in range(256))
LEAD_MASK = bytes(0x30 if 0x80 <= b < 0xC0 else 0x31 for b in range(256))  # first bytes of code points

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80


def mask(text: bytes, digits: bytes) -> int:
    """Bit i is set if digits has 1 for byte i of the text (not empty)."""
    return int(text.translate(digits)[::-1], 2)


def token_starts(text: bytes) -> int:
    """Bit i is set if a token starts at byte i."""
    if not text:
        return 0
    blank = mask(text, BLANK_MASK)
    return (blank & ~(blank << 1)) | 1


def select(bits: int, k: int) -> int:
    """The place of the set bit that has k set bits below it; k is less than the number of set bits."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            bits, width = low, half
        else:
            bits, k, at, width = bits >> half, k - below, at + half, width - half
    return at


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else mask(text, LEAD_MASK).bit_count() if text else 0


def parts(text: bytes, h1: int, h2: int) -> tuple[int, int, int]:
    """The number of tokens, and the bytes at which prefix and middle end."""
    starts = token_starts(text)
    n = starts.bit_count()
    first, second = (select(starts, k) if k < n else len(text) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    return n, first, second


def arrange(text: bytes, form: str, first: int, second: int) -> bytes:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restore(output: bytes, form: str) -> bytes:
    """The text, from the output and its form alone.

    Only texts without any of the markers are rearranged, so the first place of each marker is the marker.
    """
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    if form == "psm":
        prefix, _, suffix = head.removeprefix(PREFIX).partition(SUFFIX)
    else:
        suffix, _, prefix = head.removeprefix(SUFFIX).partition(PREFIX)
    return prefix + middle + suffix


def decisions(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(text: bytes, doc_id: int | None, seed: int, fim_percent: int, spm_percent: int) -> tuple:
    """n, form, code points of prefix and middle (None if plain), output."""
    h1, h2, h3, h4 = decisions(doc_id, seed)
    n, first, second = parts(text, h1, h2)
    if not text or h3 % 100 >= fim_percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < spm_percent else "psm"
    return n, form, code_points(text[:first]), code_points(text[first:second]), arrange(text, form, first, second)


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, with_text: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256 of each row; without output if not with_text.

    restored_sha256 is of the text that restore() builds from output and form.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                data, ends = binary_column(piece, "text")
                rows = []
                for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    *head, output = transform(bytes(data[a:b]), doc_id, seed, fim_percent, spm_percent)
                    row = (doc_id, *head, hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, head[1])).hexdigest())
                    rows.append((*row, output) if with_text else row)
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(columns)])

    return id_and_text(docs).mapInArrow(run, schema)


def restored(rows: DataFrame) -> DataFrame:
    """rows of fill_in_middle, with the column text: the original texts, rebuilt from output and form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if o is None else restore(o.encode(), f).decode() for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    kept = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c.lower() != "text"))
    fields = ", ".join(f"`{name}` {kind}" for name, kind in kept.dtypes)
    return kept.mapInArrow(run, f"{fields}, text string")
