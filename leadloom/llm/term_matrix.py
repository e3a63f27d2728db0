"""Sparse document-term matrices in shards, with one dictionary of words for all of them.

A shard holds some consecutive documents of a task as a matrix in compressed rows: ``indptr`` bounds each
document's entries, ``codes`` are the shard's own word numbers and ``counts`` how often each occurs. It is put
together from matrices of smaller parts, so no task holds the occurrences of more than a part. The words of
all shards, each once a shard, are then sorted by ranges of their hashes and numbered for the whole table, and each
shard's entries get those numbers. So words move once a shard and not once an occurrence, and no task or
driver holds the dictionary.

Words are runs without ASCII white space, after bytes are mapped by a table if one is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.common import SLICE_CHARS, _arrow, slices, small_batches
from leadloom.session import stage

#: Bytes of text in a shard, about; a longer document is a shard of its own.
SHARD_BYTES = 32_000_000
#: What shards and numbers are written with; words and codes take much less room than by the usual codec.
COMPACT = {"compression": "zstd"}


def _folded(texts: pa.StringArray, table: bytes) -> pa.StringArray:
    """Every byte of the texts by a table that keeps non-ASCII ones."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = bytes(data)[ends[0] : ends[-1]].translate(table) if data else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(raw))


def local_matrix(texts: pa.StringArray, fold: bytes | None = None) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """``(words, indptr, codes, counts)`` of texts without nulls; codes ascend in a document."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
    split = pc.ascii_split_whitespace(texts if fold is None else _folded(texts, fold))
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    width = max(1, len(words))
    codes += np.repeat(np.arange(len(texts)) * width, np.diff(split.offsets.to_numpy()))
    del split, coded
    nothing = pc.index(words, "").as_py()  # what stands before a first space or after a last one
    if nothing >= 0:
        codes = codes[codes % width != nothing]
    codes.sort()
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    counts, cells = np.diff(first, append=len(codes)), codes[first]
    indptr = np.searchsorted(cells, np.arange(len(texts) + 1) * width)
    codes = cells % width
    if nothing >= 0:
        words = pa.concat_arrays([words[:nothing], words[nothing + 1 :]])
        codes -= codes > nothing
    return words, indptr.astype(np.int32), codes.astype(np.int32), counts.astype(np.int32)


def joined(parts: list[tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """One matrix as of ``local_matrix`` of the rows of all ``parts``, but codes stand in any order in a document."""
    if len(parts) == 1:
        return parts[0]
    coded = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(codes), words) for words, _, codes, _ in parts])
    coded = coded.unify_dictionaries()
    before = np.cumsum([0, *(len(codes) for _, _, codes, _ in parts)])
    indptr = np.concatenate([np.zeros(1, np.int32), *(own[1:] + n for n, (_, own, _, _) in zip(before, parts))])
    codes = np.concatenate([chunk.indices.to_numpy() for chunk in coded.chunks])
    return coded.chunk(0).dictionary, indptr.astype(np.int32), codes.astype(np.int32), np.concatenate([p[3] for p in parts])


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def shards(
    docs: DataFrame, attributes: Callable[[pa.RecordBatch], dict], schema: str, fold: bytes | None = None
) -> DataFrame:
    """Matrix shards of ``docs`` with a column ``text`` without nulls, written to the shared folder.

    ``attributes`` gives values of each row of a batch by name, as ``schema`` declares them; a shard holds each as
    a list. ``codes`` and ``counts`` are 32-bit integers end to end. A shard's number is fixed by its being written. An
    empty table has no shard.
    """
    types = {n: _arrow(f.split()[1]) for n, f in zip(_names(schema), schema.split(", "))}
    whole = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, kind))
    raw = lambda a: pa.Array.from_buffers(
        pa.binary(), 1, [None, pa.py_buffer(np.array([0, a.nbytes], np.int32)), pa.py_buffer(a)])

    def shard(number: int, matrices: list, attributes_of: list[dict]) -> pa.RecordBatch:
        words, indptr, codes, counts = joined(matrices)
        own = {n: pa.concat_arrays([a[n] for a in attributes_of]) for n in types}
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), *(whole(own[n], t) for n, t in types.items()), whole(indptr, pa.int32()),
             raw(codes), raw(counts), whole(words, pa.string())],
            names=["shard", *types, "indptr", "codes", "counts", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, matrices, attributes_of = TaskContext.get().partitionId() << 33, 0, [], []
        for batch in batches:
            for some in slices(batch, bytes_at_once=min(SLICE_CHARS, SHARD_BYTES)):
                if not some.num_rows:
                    continue
                own = pc.sum(pc.binary_length(some.column("text"))).as_py()
                if matrices and size + own > SHARD_BYTES:
                    yield shard(number, matrices, attributes_of)
                    number, size, matrices, attributes_of = number + 1, 0, [], []
                matrices.append(local_matrix(some.column("text"), fold))
                values, rows = attributes(some), pa.array(np.arange(some.num_rows))
                # Taken, hence copied: a part of a batch would keep the whole batch with its texts.
                attributes_of.append({n: pa.array(values[n], t).take(rows) for n, t in types.items()})
                size += own
        if matrices:
            yield shard(number, matrices, attributes_of)

    lists = ", ".join("{} array<{}>".format(*f.split()) for f in schema.split(", "))
    out = f"shard bigint, {lists}, indptr array<int>, codes binary, counts binary, words array<string>"
    with small_batches(docs.sparkSession):
        return stage(docs.mapInArrow(run, out), "term-shards", **COMPACT)


def number_words(local: DataFrame) -> DataFrame:
    """``(shard, code, term, word)``: the number in the whole table's dictionary of every code of every shard.

    ``word`` is given in the first row of a number only, so the rows with a word are the dictionary. Numbers
    ascend in a partition and are not dense. A word that all shards hold is one row a shard.
    """
    posted = local.select("shard", F.posexplode("words").alias("code", "word"))
    dealt = posted.repartition("word").sortWithinPartitions("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number = None, (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word")
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
            new[0] = words[0].as_py() != last
            terms = number + np.cumsum(new)
            last, number = words[-1].as_py(), int(terms[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("code"), pa.array(terms), pc.if_else(pa.array(new), words, None)],
                names=["shard", "code", "term", "word"])

    return stage(dealt.mapInArrow(run, "shard bigint, code int, term bigint, word string"), "word-numbers", **COMPACT)


def encoded_rows(
    local: DataFrame, numbered: DataFrame, schema: str, columns: Callable[[np.ndarray, np.ndarray, np.ndarray], dict], out: str
) -> DataFrame:
    """One row per document: its attributes as ``schema`` has them, and ``columns(indptr, terms, counts)`` as ``out`` has.

    The matrix of a shard meets its numbers in one task; both are bounded by ``SHARD_BYTES``.
    """
    names, types = _names(schema), [(n, _arrow(f.split()[1])) for n, f in zip(_names(out), out.split(", "))]
    target = pa.schema([*((n, _arrow(f.split()[1])) for n, f in zip(names, schema.split(", "))), *types])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        terms = np.zeros(right.num_rows, np.int64)
        terms[right.column("code").to_numpy()] = right.column("term").to_numpy()
        for at in range(left.num_rows):
            own = lambda n: left.column(n)[at].values
            read = lambda n: np.frombuffer(left.column(n)[at].as_py(), np.int32)
            made = columns(own("indptr").to_numpy(), terms[read("codes")], read("counts"))
            parts.append(pa.table([*(own(n) for n in names), *(pa.array(made[n], t) for n, t in types)], schema=target))
        return pa.concat_tables(parts) if parts else target.empty_table()

    return local.drop("words").groupBy("shard").cogroup(numbered.select("shard", "code", "term").groupBy("shard")).applyInArrow(
        run, f"{schema}, {out}")


def row_sums(indptr: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The sum of every row, its words, and the number of its nonzero columns, its distinct words."""
    # A row's entries have different terms, since a word has one code in a shard and codes one term.
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return {"n_words": upto[indptr[1:]] - upto[indptr[:-1]], "n_distinct": np.diff(indptr).astype(np.int64)}


def term_lists(indptr: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> dict[str, pa.Array]:
    """The rows themselves: terms and how often each occurs."""
    return {"terms": pa.ListArray.from_arrays(pa.array(indptr, pa.int32()), pa.array(terms)),
            "counts": pa.ListArray.from_arrays(pa.array(indptr, pa.int32()), pa.array(counts.astype(np.int64)))}
