"""What the deduplicators share: hashes of windows, and positions on their way back to their documents.

A row of a table is known by its doc_id and a hash of doc_id and text, so that rows of one id keep their own positions.
Positions travel in blobs: the rows they belong to stand once in each, and a place refers to them by number. No step loops over
buckets that hold nothing, and a task may take many buckets, one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.llm.common import written

#: Partitions at most; each may hold any number of buckets.
MOST_PARTS = 8192
#: A place is a start, a count of starts from there on, and a mark, in 64 bits.
ASKED = np.uint64(1 << 63)

MULT = np.uint64(0x9E3779B97F4A7C15)  # odd: multiplying by it permutes 64-bit numbers
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_INVERSE = {"up": MULT, "down": np.uint64(pow(int(MULT), -1, 1 << 64))}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a permutation."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(which: str, n: int) -> np.ndarray:
    """The first n powers of MULT ("up") or of its inverse modulo 2**64 ("down")."""
    have = _POWERS[which]
    while len(have) < n:
        step = have[-1:] * _INVERSE[which]
        have = np.concatenate([have, have * step])
    if len(have) <= 1 << 20:
        _POWERS[which] = have
    return have[:n]


def prefix_sums(items: np.ndarray) -> np.ndarray:
    """Sums from which between() makes a hash of any run of items, themselves 64-bit hashes."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(items * powers("down", len(items)))])


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the items from start to before end, the same wherever they stand."""
    return mix((sums[end] - sums[start]) * powers("up", len(sums))[start] + (end - start).astype(np.uint64))


def window_hashes(items: np.ndarray, size: int) -> np.ndarray:
    """between() of each run of size items."""
    n = len(items) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(items)
    return mix((sums[size:] - sums[:n]) * powers("up", n) + np.uint64(size))


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and key (a hash of both) of every row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def n_buckets(docs: DataFrame, bytes_each: int) -> int:
    """One bucket for so many bytes of text, one at least."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    return max(1, -(-(total or 0) // bytes_each))


def edges(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def place(start: np.ndarray, count: np.ndarray | int = 1) -> np.ndarray:
    return start.astype(np.uint64) | (np.asarray(count).astype(np.uint64) << np.uint64(32))


def unplace(places: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, counts and marks."""
    x = np.frombuffer(places or b"", np.uint64)
    return (x & np.uint64(0xFFFFFFFF)).astype(np.int64), ((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64), (x & ASKED) != 0


BACK = "bucket int, docs binary, who binary, places binary"


def back(docs: np.ndarray, who: np.ndarray, places: np.ndarray, groups: int) -> pa.RecordBatch:
    """Places of documents (docs: doc_id and key by number), one row for each group of documents."""
    used = np.zeros(len(docs), bool)
    used[who] = True
    group = (mix(docs[:, 1].astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    rank = np.lexsort((group, ~used))[: np.count_nonzero(used)]
    number = np.empty(len(docs), np.int64)
    number[rank] = np.arange(len(rank))
    w = number[who]
    order = np.argsort(w, kind="stable")
    w, places, table, group = w[order], places[order], docs[rank], group[rank]
    cut = edges(group)
    at = np.searchsorted(w, cut)
    rows = [(int(group[a]), table[a:z].tobytes(), (w[i:j] - a).astype(np.uint32).tobytes(), places[i:j].tobytes()) for a, z, i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["bucket", "docs", "who", "places"])


def joined(blobs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The documents of several blobs (docs and who), one after another, and who refers to them."""
    tables = [np.frombuffer(d, np.int64).reshape(-1, 2) for d, _ in blobs]
    offsets = np.cumsum([0, *[len(t) for t in tables]])
    return np.concatenate(tables), np.concatenate([np.frombuffer(w, np.uint32).astype(np.int64) + o for (_, w), o in zip(blobs, offsets[:-1].tolist(), strict=True)])


def dealt(df: DataFrame, buckets: int) -> DataFrame:
    """All rows of a bucket in one partition, bucket after bucket."""
    return df.repartition(min(buckets, MOST_PARTS), "bucket").sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each bucket's rows, as lists; rows come sorted by the first column, bucket."""
    bucket, held = None, []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if row[0] != bucket and held:
                yield list(map(list, zip(*held, strict=True)))
                held = []
            bucket = row[0]
            held.append(row)
    if held:
        yield list(map(list, zip(*held, strict=True)))


def gathered(met: DataFrame, groups: int, name: str) -> DataFrame:
    """One row for each document, doc_id, key and places with all its places, of rows as back() makes them; written."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs, who, places in by_bucket(batches):
            table, w = joined(list(zip(docs, who, strict=True)))
            x = np.frombuffer(b"".join(places), np.uint64)
            order = np.lexsort((table[:, 1], table[:, 0]))
            new = np.concatenate([[True], (np.diff(table[order], axis=0) != 0).any(axis=1)])
            number = np.empty(len(table), np.int64)
            number[order] = np.cumsum(new) - 1
            w = number[w]
            to = np.argsort(w, kind="stable")
            w, x, table = w[to], x[to], table[order][new]
            cut = edges(w)
            blobs = [x[a:z].tobytes() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(table[w[cut[:-1]], i]) for i in (0, 1)] + [pa.array(blobs, pa.binary())], ["doc_id", "key", "places"])

    return written(dealt(met, groups).mapInArrow(gather, "doc_id bigint, key bigint, places binary"), name)


def covered(starts: np.ndarray, counts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n items lie in a window that starts at one of starts or the counts - 1 places behind it."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + counts - 1 + window, n), -1)
    return np.cumsum(edge[:n]) > 0
