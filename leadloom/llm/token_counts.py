"""Token counts by field or section: each document is encoded once as a whole, and its tokens are joined
to the sections by their spans.

Rules for a token that crosses from one section into another:
``start`` gives it to the section that holds its first byte, ``majority`` to the section that holds most
of its bytes (the earlier one when equal), ``split`` to each section by its share of the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.chunk_encoder import encoder, tokenizer_path
from leadloom.llm.common import map_batches

RULES = ("start", "majority", "split")
COUNTS = "doc_id bigint, section bigint, start long, n_bytes long, n_tokens double, n_crossing long"


def lines(text: Column) -> Column:
    """The sections of a text by lines, each with the line feed that ends it; after a last one stands an empty line."""
    return F.split(text, "(?<=\n)")


def fields(*columns: str, separator: str = "\n") -> Column:
    """Several columns as sections of one text, each but the last with the separator behind it."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.array(*[F.concat(v, F.lit(separator)) for v in values[:-1]], values[-1])


def token_counts(docs: DataFrame, sections: Column, rule: str = "start", tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, section, start, n_bytes, n_tokens, n_crossing)``, one row per section of each row of ``docs``.

    ``sections`` are consecutive parts of the text that is encoded; null counts as one empty section. Spans
    are in bytes of UTF-8. ``n_crossing`` counts the tokens given to the section, wholly or in part, that
    also cover another. The counts of a document add up to its tokens. Repeated rows repeat their counts, an
    empty table gives no rows, and other columns are not read. A row's sections stay together in one task.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    parts = docs.select(F.col("doc_id").cast("long"), F.coalesce(sections, F.array(F.lit(""))).alias("sections"))
    parts = parts.select("doc_id", F.concat_ws("", "sections").alias("text"), F.transform(
        "sections", lambda s: F.octet_length(F.coalesce(s, F.lit(""))).cast("long")).alias("sizes"))

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        own = encoder(tokenizer_path(tokenizer, "byte_bpe_50k.json"))
        ids, counts = own.encode(batch.column("text").to_pylist())
        return attribute(own.bytes_of[ids], counts, batch.column("doc_id"), batch.column("sizes"), rule)

    return map_batches(parts, run, COUNTS)


def attribute(token_bytes: np.ndarray, counts: np.ndarray, doc_ids: pa.Array, sizes: pa.ListArray, rule: str) -> dict:
    """Join token spans to section spans over the bytes of all documents of a batch, laid end to end."""
    per_doc = np.diff(sizes.offsets.to_numpy())
    size = sizes.flatten().to_numpy()
    ends = np.cumsum(size)
    starts = ends - size
    first_section = np.cumsum(per_doc) - per_doc
    token_end = np.cumsum(token_bytes)
    token_start = token_end - token_bytes
    # Sections without bytes hold no token; searching among the others finds the one that holds a byte.
    held = np.flatnonzero(size > 0)
    of_byte = lambda b: held[np.searchsorted(starts[held], b, side="right") - 1]
    a, z = (of_byte(token_start), of_byte(token_end - 1)) if len(token_bytes) else (np.zeros(0, np.int64),) * 2
    crossing = np.flatnonzero(a != z)
    n_tokens = np.bincount(a[a == z], minlength=len(size)).astype(float)
    n_crossing = np.zeros(len(size), np.int64)
    # The sections that each crossing token covers, end to end: no more of them than the tokens have bytes.
    low = np.searchsorted(held, a[crossing])
    many = np.searchsorted(held, z[crossing], side="right") - low
    token = np.repeat(crossing, many)
    begins = np.cumsum(many) - many
    covered = held[np.arange(len(token)) - np.repeat(begins - low, many)]
    shares = np.minimum(ends[covered], token_end[token]) - np.maximum(starts[covered], token_start[token])
    if rule == "split":
        n_tokens += np.bincount(covered, weights=shares / token_bytes[token], minlength=len(size))
        n_crossing += np.bincount(covered, minlength=len(size))
    elif len(crossing):
        largest = np.repeat(np.maximum.reduceat(shares, begins), many) if rule == "majority" else shares
        fits = np.flatnonzero(shares == largest)
        given = covered[fits[np.searchsorted(fits, begins)]]  # the first that fits of each token
        n_tokens += np.bincount(given, minlength=len(size))
        n_crossing += np.bincount(given, minlength=len(size))
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    begin = starts[first_section[doc]] if len(doc) else starts
    return {
        "doc_id": doc_ids.take(pa.array(doc)), "section": np.arange(len(doc)) - first_section[doc],
        "start": starts - begin, "n_bytes": size, "n_tokens": n_tokens, "n_crossing": n_crossing,
    }
