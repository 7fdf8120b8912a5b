"""Operator 6: token counts of sections by offset-mapped attribution.

A whole document is encoded once. The lengths of the tokens' bytes give every
token's span, spans and sections are joined by interval (both are sorted, so
one search finds each token's sections), and every token is allocated to
one section by rule. So the counts of the sections add up to the document's.

Rules for tokens that cross a boundary: `start` gives them to the section of
their first byte, `end` to that of their last, `most` to the section that holds
most of their bytes (the first of equals).

Sections are the lines of a text, each with its line feed; or the named
fields of a row, joined by `joiner` (which belongs to the field before it).

Cases: a null or empty text is one empty section without tokens; a null field
is an empty one and still a section; offsets count code points; strings that
look like special tokens are ordinary text; repeated rows give equal rows;
very long texts are encoded whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import only, tokenizer_path

RULES = ("start", "end", "most")
_held: dict = {}


def _encoder(given):
    """The worker's encoder and the byte length of each id."""
    ranks, pattern = given.value
    key = (id(given), len(ranks), pattern)
    if key not in _held:
        import tiktoken

        _held.clear()
        size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        _held[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _held[key]


def line_bounds(text: str | None) -> list[int]:
    """Byte offsets at which the lines begin, and the end."""
    data = (text or "").encode("utf-8", "surrogatepass")
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    return [0, *(int(e) for e in ends if e < len(data)), len(data)]


def allocate(sizes: np.ndarray, bounds: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Byte lengths of the tokens and bounds of the sections -> tokens allocated to each section, and those of them that cross a boundary."""
    sections = len(bounds) - 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # Of sections that begin at one place all but the last are empty: they get nothing.
    first = np.searchsorted(bounds[1:], starts, side="right")
    last = np.searchsorted(bounds[1:], ends - 1, side="right")
    if rule == "start":
        to = first
    elif rule == "end":
        to = last
    else:
        to = first.copy()
        for i in np.flatnonzero(first != last):
            spans = range(first[i], last[i] + 1)
            to[i] = max(spans, key=lambda s: (min(ends[i], bounds[s + 1]) - max(starts[i], bounds[s]), -s))
    return np.bincount(to, minlength=sections)[:sections], np.bincount(to[first != last], minlength=sections)[:sections]


def attributed(rows: DataFrame, key: str, fields: list[str] | None = None, text: str = "text", joiner: str = "\n", rule: str = "start", path: str | None = None) -> DataFrame:
    """key, section, start, end, n_tokens, n_crossing: one row for each line of the text, or for each of the fields."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    import public_tokenizers

    given = rows.sparkSession.sparkContext.broadcast((read_ranks(path or tokenizer_path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN))
    taken = only(rows, key, *(fields or [text]))

    def run(batches):
        encoder, size = _encoder(given)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fields:
                    parts = [(p or "") + (joiner if i < len(fields) - 1 else "") for i, p in enumerate(row[1:])]
                    whole, bounds = "".join(parts), [0, *np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in parts]).tolist()]
                else:
                    whole = row[1] or ""
                    bounds = line_bounds(whole)
                edges = np.array(bounds)
                counts, crossing = allocate(size[np.array(encoder.encode_ordinary(whole), dtype=np.int64)], edges, rule)
                data = whole.encode("utf-8", "surrogatepass")
                if len(data) != len(whole):  # bytes that begin a character, up to each bound
                    begins = np.cumsum(np.append(0, (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))
                    edges = begins[edges]
                n = len(counts)
                for column, value in zip(out, ([row[0]] * n, range(n), edges[:-1].tolist(), edges[1:].tolist(), counts.tolist(), crossing.tolist()), strict=True):
                    column.extend(value)
                if len(out[0]) >= 50_000:
                    yield _rows(out)
                    out = [[] for _ in range(6)]
            if out[0]:
                yield _rows(out)

    def _rows(out):
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[key, "section", "start", "end", "n_tokens", "n_crossing"])

    taken = taken.withColumn(key, F.col(key).cast("long"))
    return taken.mapInArrow(run, f"{key} long, section int, start long, end long, n_tokens long, n_crossing long")


def op6_token_attribution(spark, sf_dir: str) -> DataFrame:
    """The lines of the whole documents table."""
    return attributed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
