"""Documents as text: signals, noise, clean-up, chunks with anchors, page offsets, sections."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodeworks.functions.text import ascii_lower, squeeze

# Fixed values of the noise, paragraph and chunk rules.
NOISE_WORDS = ["proceedings", "arxiv", "copyright", "preprint", "conference", "journal"]
CAPTION_STARTS = ["fig.", "figure ", "table "]
REFERENCE_TAIL = 30_000
REPEATS, SHORT_LINE, NOISE_BYTES, NOISE_CHARS, JOINED_CHARS, EXCERPT = 3, 18, 3, 90, 96, 240
# Profiles: bytes of a chunk, bytes of overlap, chunks at once, tokens of an answer.
CHUNK_PROFILES = {"fast": (4500, 300, 3, 1000), "balanced": (6500, 500, 2, 1600), "strict": (5500, 700, 1, 1800)}
MODES = {"": "clean", "clean": "clean", "none": "raw", "raw": "raw", "light": "light"}
SPACE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of text that a task has as Python objects at once.
PIECE_BYTES = 1 << 20
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final newline gives no extra line."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def text_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, line, norm (squeezed), of each document."""
    return docs.select(key, F.posexplode(lines_of(F.col("text"))).alias("line_no", "line")).withColumn("norm", squeeze(F.col("line")))


def looks_like_noise(norm: Column) -> Column:
    low = ascii_lower(norm)
    caption = low.startswith(CAPTION_STARTS[0]) | low.startswith(CAPTION_STARTS[1]) | low.startswith(CAPTION_STARTS[2])
    word = F.exists(F.array(*map(F.lit, NOISE_WORDS)), lambda w: low.contains(w))
    return ~caption & ~norm.contains("http://") & ~norm.contains("https://") & (norm.rlike(r"^[0-9\s]+$") | word)


def repeated_noise(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, norm, n: lines that a document repeats and that look like layout.  Counted, not windowed: partial aggregation."""
    solid = text_lines(docs, key).where((F.octet_length("norm") >= NOISE_BYTES) & (F.char_length("norm") <= NOISE_CHARS))
    return solid.groupBy(key, "norm").agg(F.count("*").alias("n")).where((F.col("n") >= REPEATS) & looks_like_noise(F.col("norm")))


def text_signals(docs: DataFrame, key: str = "doc_id", blank: bool = False) -> DataFrame:
    """key, n_lines (not blank), n_repeated (distinct lines with three occurrences or more), short_ratio, n_figures, n_tables, n_urls; a row for each document with such lines, if blank for the others too (short_ratio null).

    All in the document's row: in sorted lines, one that repeats is equal to the second next and unlike the one before.
    """
    trimmed = F.filter(F.transform(lines_of(F.col("text")), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    rows = docs.select(key, trimmed.alias("solid"))
    rows = rows if blank else rows.where(F.size("solid") > 0)
    rows = rows.select(key, "solid", F.transform("solid", ascii_lower).alias("low"), F.array_sort(F.transform("solid", squeeze)).alias("sorted"))
    line = lambda i: F.get(F.col("sorted"), i)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("sorted") - 1, F.lit(0))), lambda i: (line(i) == line(i + REPEATS - 1)) & ((i == 0) | (line(i - 1) != line(i))))
    count = lambda lines, test: F.size(F.filter(lines, test)).cast("long")
    n = F.size("solid").cast("long")
    return rows.select(
        key, n.alias("n_lines"), F.size(starts).cast("long").alias("n_repeated"), count("low", lambda x: x.startswith("fig.") | x.startswith("figure ")).alias("n_figures"), count("low", lambda x: x.startswith("table ")).alias("n_tables"),
        count("low", lambda x: x.contains("http://") | x.contains("https://")).alias("n_urls"), (count("solid", lambda x: F.char_length(x) <= SHORT_LINE) / F.nullif(n, F.lit(0))).alias("short_ratio"),
    )


def collapse_blank_lines(text: Column) -> Column:
    """Lines without blanks at their ends, runs of blank lines as one, at the start too; none at the end."""
    kept = F.transform(lines_of(text), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    joined = F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(joined, r"^\n+", "\n"), r"\n+$", "")


def _starts_lower(line: str) -> bool:
    first = next((c for c in line if c.isalpha()), "")
    return bool(first) and first.islower()


def split_lines(text: str) -> list[str]:
    """Lines at newlines only, without a carriage return before them; a final newline gives no extra line."""
    lines = text.split("\n")
    ended = [x.removesuffix("\r") for x in lines[:-1]]
    return ended + lines[-1:] if lines[-1] else ended


def repair_hyphenation(lines: list[str]) -> list[str]:
    """A hyphen at a line's end, blanks behind it aside, is undone if the next line goes on in lower case."""
    out, i = [], 0
    while i < len(lines):
        bare = lines[i].rstrip(SPACE)
        if bare.endswith("-") and i + 1 < len(lines) and _starts_lower(lines[i + 1].lstrip(SPACE)) and not (bare[:-1] and bare[-2] in SPACE):
            out.append(bare[:-1] + lines[i + 1].lstrip(SPACE))
            i += 2
        else:
            out.append(lines[i])
            i += 1
    while out and not out[-1]:
        out.pop()
    return out


def _ascii_lower(text: str) -> str:
    return text.encode().lower().decode()


def _own_line(line: str) -> bool:
    low = _ascii_lower(line)
    return line.startswith(("#", "|")) or low.startswith((*CAPTION_STARTS, "http://", "https://")) or line.endswith(":") or (line.startswith("[") and "]" in line) or sum(line.count(c) for c in "=<>+-/") >= 2


def paragraphs(lines: list[str]) -> str:
    done: list[str] = []
    held = ""

    def flush() -> None:
        nonlocal held
        if held:
            done.append(held)
        held = ""

    for raw in lines:
        line = raw.strip(SPACE)
        if not line:
            flush()
        elif _own_line(line):
            flush()
            done.append(line)
        elif held and not held.endswith((".", ":", ";")) and (len(line) <= JOINED_CHARS or _starts_lower(line)):
            held += " " + line
        else:
            flush()
            held = line
    flush()
    return "\n\n".join(done)


def text_mode(mode: str | None) -> str:
    """clean by default; none is raw."""
    name = (mode or "").strip().lower()
    if name not in MODES:
        raise ValueError(f"unknown text mode: {mode}")
    return MODES[name]


def squeezed(lines: list[str]) -> list[str]:
    """Each line with runs of white space as one blank, none at the ends."""
    if any(c in line for line in lines for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split alone
        return [" ".join(re.findall(rf"[^{SPACE}]+", x)) for x in lines]
    return [" ".join(x.split()) for x in lines]


def noise_keys(keys: list[str]) -> set[str]:
    """Squeezed lines that the text repeats and that look like layout."""
    counts = Counter(k for k in keys if len(k) <= NOISE_CHARS and len(k.encode()) >= NOISE_BYTES)

    def noisy(key: str) -> bool:
        low = _ascii_lower(key)
        if low.startswith(tuple(CAPTION_STARTS)) or "http://" in low or "https://" in low:
            return False
        return bool(re.fullmatch(rf"[0-9{SPACE}]+", key)) or any(w in low for w in NOISE_WORDS)

    return {k for k, n in counts.items() if n >= REPEATS and noisy(k)}


def clean(text: str | None, mode: str = "clean") -> tuple[str, int]:
    """The cleaned text and how many distinct repeated layout lines went.

    raw: as it is.  Else repeated layout lines go and hyphens are undone; then clean joins lines to paragraphs, light
    only collapses blank lines.
    """
    text, mode = text or "", text_mode(mode)
    if mode == "raw":
        return text, 0
    lines = split_lines(text)
    keys = squeezed(lines)
    noise = noise_keys(keys)
    kept = repair_hyphenation([x for x, k in zip(lines, keys) if k not in noise])
    if mode == "clean":
        return paragraphs(kept), len(noise)
    out: list[str] = []
    for line in (x.rstrip(SPACE) for x in kept):
        if line or not out or out[-1]:
            out.append(line)
    return "\n".join(out).rstrip("\n"), len(noise)


def reference_tail(text: str | None) -> str:
    """From the last line that starts with references (else reference) on, cleaned lightly; empty if there is none."""
    raw = (text or "").encode()
    low = raw.lower()
    at = low.rfind(b"\nreferences")
    at = low.rfind(b"\nreference") if at < 0 else at
    return clean(raw[at:].decode(), "light")[0][:REFERENCE_TAIL] if at >= 0 else ""


def text_pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[tuple[list, list]]:
    """Keys and texts of batches (key, text), about `most` bytes of text at once, a text at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            piece = batch.slice(at, end - at)
            yield piece.column(0).to_pylist(), piece.column(1).to_pylist()
            at = end


def by_pieces(docs: DataFrame, key: str, work: Callable[[list, list], list[tuple]], fields: list[StructField]) -> DataFrame:
    """work(keys, texts) -> rows (key and fields) of all docs, without a shuffle.

    A task turns a piece of a batch into Python objects and gives its rows before it takes the next one, so what it holds is bounded
    by PIECE_BYTES, however many and long the rows of a batch are.
    """
    schema = StructType([docs.schema[key], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for names, texts in text_pieces(batches):
            if rows := work(names, texts):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.select(key, "text").mapInArrow(run, schema)


def reference_tails(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, tail, in Arrow batches."""
    return by_pieces(docs, key, lambda names, texts: [(name, reference_tail(t)) for name, t in zip(names, texts)], [StructField("tail", StringType())])


def noise_warning(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("removed "), n.cast("string"), F.lit(" repeated layout lines")))


def clean_documents(docs: DataFrame, mode: str = "clean", key: str = "doc_id") -> DataFrame:
    """key, text, n_noise, warning.  Joining lines depends on the lines before, so a document is folded in Arrow batches."""
    mode = text_mode(mode)

    fields = [StructField("text", StringType()), StructField("n_noise", LongType())]
    cleaned = by_pieces(docs, key, lambda names, texts: [(name, *clean(t, mode)) for name, t in zip(names, texts)], fields)
    return cleaned.withColumn("warning", noise_warning(F.col("n_noise")))


def fnv1a(texts: list[str]) -> np.ndarray:
    """64-bit hashes of many texts, byte position by byte position."""
    raw = [t.encode() for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(-size, kind="stable")
    begin = (np.cumsum(size) - size)[order]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    size = size[order]
    h = np.full(len(raw), FNV_OFFSET, np.uint64)
    longer = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # how many texts have a byte at each place
    for place, n in enumerate(longer.tolist()):
        h[:n] = (h[:n] ^ data[begin[:n] + place]) * np.uint64(FNV_PRIME)
    out = np.empty(len(raw), np.uint64)
    out[order] = h
    return out


def paragraph_spans(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges between blank lines, empty ones left out; the whole text if there is none."""
    spans, at = [], 0
    for part in raw.split(b"\n\n"):
        if part:
            spans.append((at, at + len(part)))
        at += len(part) + 2
    return spans or [(0, len(raw))]


def paragraph_ranges(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, byte_start, byte_end of each paragraph, in Arrow batches."""

    def spans(names: list, texts: list) -> list[tuple]:
        return [(name, *span) for name, text in zip(names, texts) for span in paragraph_spans((text or "").encode())]

    return by_pieces(docs, key, spans, [StructField("byte_start", LongType()), StructField("byte_end", LongType())])


def chunk_spans(raw: bytes, most: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy windows of paragraphs of at most `most` bytes (one paragraph at least); the next begins `overlap` bytes before the end, on a character."""
    spans = paragraph_spans(raw)
    out, start, end = [], spans[0][0], spans[0][0]
    for a, b in spans:
        if end > start and b - start > most:
            out.append((start, end))
            start = max(0, end - overlap)
            while start and raw[start] & 0xC0 == 0x80:
                start -= 1
        elif end == start:
            start = a
        end = b
    return [*out, (start, end)] if end > start else out


def chunk_text(text: str, most: int, overlap: int) -> Iterator[tuple[int, int, int, int, int, str, list[tuple[int, int, int, str]]]]:
    """(number from 0, start byte, end byte, first line, last line, text, anchored lines); lines count from 1.

    Anchored are the lines of the text that the chunk touches and that are not blank: (line, start byte, end byte, excerpt).
    """
    raw = text.encode()
    starts = [0, *(m.end() for m in re.finditer(b"\n", raw) if m.end() < len(raw))]
    lines = split_lines(text)
    for number, (start, end) in enumerate(chunk_spans(raw, most, overlap)):
        first, last = bisect_right(starts, start) - 1, bisect_right(starts, max(0, end - 1)) - 1
        anchored = [(i + 1, starts[i], starts[i] + len(lines[i].encode()), excerpt) for i in range(first, min(last + 1, len(lines))) if (excerpt := lines[i].strip(SPACE)[:EXCERPT])]
        yield number, start, end, first + 1, last + 1, raw[start:end].decode(), anchored


def chunks(docs: DataFrame, profile: str = "balanced", key: str = "doc_id", anchors: bool = True) -> DataFrame:
    """key, chunk_id, byte_start, byte_end, line_start, line_end, chunk, n_anchors and, if asked for, anchors (anchor_id, line,
    byte_start, byte_end, excerpt) of each document, in Arrow batches: no shuffle.  Equal lines of a chunk share an id.
    """
    most, overlap, *_ = CHUNK_PROFILES[profile]

    def cut(names: list, texts: list) -> list[tuple]:
        found = [(name, piece) for name, text in zip(names, texts) for piece in chunk_text(text or "", most, overlap)]
        rows = [(name, f"chunk_{p[0]:04d}", *p[1:6], len(p[6])) for name, p in found]
        if not anchors:
            return rows
        hashes = iter(fnv1a([a[3] for _, p in found for a in p[6]]).tolist())
        return [(*row, [{"anchor_id": f"c{p[0]:04d}_{next(hashes):010x}", "line": a[0], "byte_start": a[1], "byte_end": a[2], "excerpt": a[3]} for a in p[6]]) for row, (_, p) in zip(rows, found)]

    fields = "chunk_id string, byte_start long, byte_end long, line_start long, line_end long, chunk string, n_anchors long"
    if anchors:
        fields += ", anchors array<struct<anchor_id:string,line:long,byte_start:long,byte_end:long,excerpt:string>>"
    return by_pieces(docs, key, cut, StructType.fromDDL(fields).fields)


def anchors_of(chunk_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk_id and the anchors of chunks."""
    return chunk_rows.select(key, "chunk_id", F.explode("anchors").alias("a")).select(key, "chunk_id", "a.*")


def page_offsets(pages: DataFrame, doc: str, number: str, text: str) -> DataFrame:
    """doc, number, byte_start, byte_end of pages joined by a blank line."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 2
    w = Window.partitionBy(doc).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(size).over(w)
    return pages.select(doc, number, (end - size).alias("byte_start"), (end - 2).alias("byte_end"))


def section_ranges(starts: DataFrame, doc: str, start: str, length: Column) -> DataFrame:
    """starts with section_end: the next section's start, or the document's length."""
    return starts.withColumn("section_end", F.coalesce(F.lead(start).over(Window.partitionBy(doc).orderBy(start)), length))


def overlapping(chunk_rows: DataFrame, sections: DataFrame, doc: str) -> DataFrame:
    """Chunks and sections of one document that touch, in bins: both sides are dealt to the bins of a document that they reach.

    A bin is as wide as an interval on average, so an interval is in a few, and a document of any length is many small groups.  A
    pair that shares several bins counts in the first of them.
    """
    length = lambda rows, a, b: rows.agg(F.avg(F.col(b) - F.col(a))).first()[0] or 0
    width = F.lit(max(1, math.ceil(max(length(chunk_rows, "byte_start", "byte_end"), length(sections, "section_start", "section_end")))))
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))).alias("bin")
    s = sections.where("section_start <= section_end").select(F.col(doc).alias("section_doc"), "section_id", "section_start", "section_end", bins("section_start", "section_end").alias("section_bin"))
    c = chunk_rows.where("byte_start <= byte_end").select("*", bins("byte_start", "byte_end"))
    touch = (F.col("byte_end") >= F.col("section_start")) & (F.col("byte_start") <= F.col("section_end"))
    first = F.col("bin") == F.floor(F.greatest("byte_start", "section_start") / width)
    return c.join(s, (F.col(doc) == F.col("section_doc")) & (F.col("bin") == F.col("section_bin")) & touch & first).drop("section_doc", "section_bin", "bin")