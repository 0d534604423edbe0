"""Byte-string deduplication on a Burrows-Wheeler transform.

Equal strings of LENGTH bytes have the same minimiser (the least hash of their K-byte parts), so texts are cut into
runs of strings with one minimiser. Runs meet by their minimiser as hashes; equal runs are folded into one. Where a
minimiser has several different runs, these meet again in buckets, as bytes: a bucket's runs form one text, and on its
Burrows-Wheeler transform breadth-first backward extension finds the common prefixes of neighbouring suffixes by
increasing value and stops at LENGTH: neighbours that are still unset share LENGTH bytes. A run that is alone with its
minimiser after folding shares no string with any other, so the transform has nothing to find in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import table
from contestry.llm.positions import ASKED, BACK, back, between, by_bucket, covered, dealt, edges, gathered, joined, mix, n_buckets, place, prefix_sums, unplace, window_hashes, with_key

LENGTH, K = 50, 20
#: Strings of one run at most; longer runs are cut.
LONGEST_RUN = 512
#: Bytes of texts that are cut together, and whose runs are sent together.
CHUNK_BYTES, PACK_BYTES = 1 << 16, 12 << 20
#: Bytes of text for which there is one bucket of runs; bytes of runs for which there is one bucket of bytes.
TEXT_A_BUCKET, RUNS_A_BUCKET = 24 << 20, 2 << 20
#: Minimisers are counted in slots, so many that a slot of average load has an eighth of HOT_RUNS or less, between these
#: bounds; strings of those in a slot of more than HOT_RUNS runs are sent one by one.
LEAST_SLOTS, MOST_SLOTS, HOT_RUNS = 16, 24, 1 << 20
#: A run's 80-bit key: 32 bits of its minimiser, above 48 bits of its content (32, then 16).
HALF = np.uint64(32)
END = 256

BYTE_HASH, BYTE_HASH_2 = mix(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, 256)


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, content hash, first string and number of strings of each run of the texts that end at ends in data."""
    n = len(data) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = window_hashes(BYTE_HASH[data], K)
    width, span = length - K + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    inside = np.ones(n + length, bool)
    for e in ends.tolist():  # strings that reach over a text's end
        inside[max(0, e - length + 1) : e] = False
    at = np.flatnonzero(inside[:n])
    if not len(at):
        return runs(data[:0], ends, length)
    own = low[at]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    size = np.diff(np.append(first, len(at)))
    minimiser, first = own[first], at[first]
    if size.max() > LONGEST_RUN:
        pieces = -(-size // LONGEST_RUN)
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        minimiser, first, end = np.repeat(minimiser, pieces), np.repeat(first, pieces) + inner * LONGEST_RUN, np.repeat(first + size, pieces)
        size = np.minimum(LONGEST_RUN, end - first)
    return minimiser, between(prefix_sums(BYTE_HASH_2[data]), first, first + size + length - 1), first, size


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents (doc_id and key), their bytes one after another, and where each ends, of rows doc_id, key, text."""
    docs, parts, size = [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(docs, np.int64), np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])

    for b in batches:
        for d, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            docs.append((d, k))
            parts.append(t.as_buffer().to_pybytes())
            size += len(parts[-1])
            if size >= CHUNK_BYTES:
                yield out()
                docs, parts, size = [], [], 0
    if docs:
        yield out()


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first depth symbols or more, by doubling from seven symbols."""
    n, span = len(text), 7
    padded = np.concatenate([text + 1, np.zeros(span, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(span):
        key = key * 259 + padded[j : j + n]
    while True:
        order = np.argsort(key, kind="stable")
        new = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], new[1:] != new[:-1]]))
        if span >= depth:
            return order
        key = rank * (n + 1)
        key[:-span] += rank[span:] + 1
        span *= 2


def shared_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each place in it whether the suffix shares length symbols or more with the one before."""
    # A last symbol below all others, found once, so that the step from the first suffix back leads to a row of its own.
    text = np.append(text, -1)
    n = len(text)
    order = suffix_order(text + 1, length + 1)
    bwt = text[order - 1]
    # LF: where the suffix that begins one symbol earlier stands.
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    change = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
    run_end = np.repeat(np.append(change, n), np.diff(np.concatenate([[0], change, [n]])))
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        if not len(lo):
            break
        # An interval before which stands one symbol only moves as a whole.
        whole = run_end[lo] >= hi
        new_lo, new_hi = [lf[lo[whole]]], [lf[lo[whole]] + (hi - lo)[whole]]
        a, size = lo[~whole], (hi - lo)[~whole]
        if len(a):
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(a, size)
            of = np.repeat(np.arange(len(a)), size)
            of = of * 512 + bwt[at] + 1
            to = np.argsort(of, kind="stable")
            of, to = of[to], lf[at[to]]
            edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            new_lo.append(to[edge])
            new_hi.append(to[edge] + np.diff(np.append(edge, len(of))))
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = unset[hi]
        lo, hi = lo[fresh], hi[fresh]
        unset[hi] = False
    return order[1:], unset[1:n]


def later_strings(segments: list[bytes], numbers: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, place) in order of each string of length bytes in segments that also begins in a document with a smaller id.

    numbers and docs: each segment's number, ascending, and document.
    """
    sizes = np.array([len(s) for s in segments])
    text = np.full(int(sizes.sum() + len(sizes)), END, np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    of = np.repeat(np.arange(len(sizes)), sizes + 1)
    inside = np.arange(len(text)) - begin[of]
    text[inside < sizes[of]] = np.frombuffer(b"".join(segments), np.uint8)
    order, same = shared_prefixes(text, length)
    whole = (inside <= sizes[of] - length)[order]
    doc = docs[of][order]
    group = np.flatnonzero(~same)
    least = np.minimum.reduceat(np.where(whole, doc, np.iinfo(np.int64).max), group)
    later = whole & (doc > np.repeat(least, np.diff(np.append(group, len(order)))))
    at = np.sort(order[later])
    return numbers[of[at]], inside[at]


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def hot_slots(rows: DataFrame, bits: int, length: int) -> np.ndarray:
    """For each slot whether more than HOT_RUNS runs have their minimiser in it."""
    block = min(bits, 12)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for _, data, ends in chunks(batches):
            h = slots(runs(data, ends, length)[0], bits)
            total += np.bincount(h, minlength=len(total)).astype(np.uint32) if len(h) > len(total) >> 4 else 0
            if len(h) <= len(total) >> 4:
                np.add.at(total, h, 1)
        for i, part in enumerate(total.reshape(-1, 1 << block)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["bucket", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in by_bucket(batches):
            total = np.sum([np.frombuffer(x, np.uint32) for x in blobs], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((bucket[0] << block) + np.flatnonzero(total > HOT_RUNS))], ["slot"])

    counted = rows.mapInArrow(count, "bucket int, n binary")
    hot = np.zeros(1 << bits, bool)  # 2**MOST_SLOTS bytes at most
    hot[[r["slot"] for r in dealt(counted, 1 << (bits - block)).mapInArrow(add, "slot bigint").collect()]] = True
    return hot


def folded(rows: DataFrame, hot: np.ndarray, bits: int, buckets: int, length: int) -> DataFrame:
    """Rows of BACK: places of strings that also begin in a document with a smaller id, and (marked) of runs to compare."""
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(hot))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One of equal runs, of the smallest document, goes to its bucket; the others begin later."""
        is_hot = np.unpackbits(shared.value).view(bool)
        some_hot = bool(is_hot.any())
        held: list[tuple[np.ndarray, ...]] = []
        docs: list[np.ndarray] = []
        count, size = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            who_are = np.concatenate(docs)
            h, c, who, places = (np.concatenate([x[i] for x in held]) for i in range(4))
            order = np.lexsort((who_are[who, 0], c))
            h, c, who, places = h[order], c[order], who[order], places[order]
            cut = edges(c)
            least = np.repeat(who_are[who[cut[:-1]], 0], np.diff(cut)) if len(c) else who_are[:0, 0]
            later = who_are[who, 0] > least
            if later.any():
                known = back(who_are, who[later], places[later], buckets)
                yield pa.RecordBatch.from_arrays([known.column(0), pa.nulls(known.num_rows, pa.binary()), *known.columns[1:]], ["bucket", "keys", "docs", "who", "places"])
            stay = np.flatnonzero(~later)
            h, c, who, places = h[stay], c[stay], who[stay], places[stay]
            bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((places & np.uint64(0xFFFFFFFF), who, bucket))  # in the documents' order blobs compress better
            bucket, who, places = bucket[order], who[order], places[order]
            key = (h[order] << HALF) | (c[order] >> HALF)
            rest = c[order].astype(np.uint16)
            cut = edges(bucket)
            out = []
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                w = who[a:z]
                new = np.concatenate([[True], w[1:] != w[:-1]])
                out.append((int(bucket[a]), key[a:z].tobytes() + rest[a:z].tobytes(), who_are[w[new]].tobytes(), (np.cumsum(new) - 1).astype(np.uint32).tobytes(), places[a:z].tobytes()))
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["bucket", "keys", "docs", "who", "places"])

        for ids, data, ends in chunks(batches):
            h, c, first, n = runs(data, ends, length)
            if some_hot and len(h):
                single = is_hot[slots(h, bits)]
                if single.any():  # each string on its own account: equal ones meet, the rest spreads over all buckets
                    at = np.repeat(first[single], n[single]) + np.arange(n[single].sum()) - np.repeat(np.cumsum(n[single]) - n[single], n[single])
                    own = between(prefix_sums(BYTE_HASH_2[data]), at, at + length)
                    h, c = np.concatenate([h[~single], mix(own)]), np.concatenate([c[~single], own])
                    first, n = np.concatenate([first[~single], at]), np.concatenate([n[~single], np.ones(len(at), np.int64)])
            of = np.searchsorted(ends, first, side="right")
            begin = ends - np.diff(ends, prepend=0)
            held.append((h, c, of + count, place(first - begin[of], n)))
            docs.append(ids)
            count += len(ids)
            size += len(data)
            if size > PACK_BYTES:
                yield from flush()
                held, docs, count, size = [], [], 0, 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, docs, who, places in by_bucket(batches):
            for k, d, w, p in zip(keys, docs, who, places, strict=True):
                if k is None:
                    yield back(np.frombuffer(d, np.int64).reshape(-1, 2), np.frombuffer(w, np.uint32).astype(np.int64), np.frombuffer(p, np.uint64), buckets)
            own = [i for i, k in enumerate(keys) if k is not None]
            if not own:
                continue
            table, w = joined([(docs[i], who[i]) for i in own])
            n = [len(places[i]) for i in own]
            p = np.frombuffer(b"".join([places[i] for i in own]), np.uint64)
            key = np.frombuffer(b"".join([keys[i][:k] for i, k in zip(own, n, strict=True)]), np.uint64)
            rest = np.frombuffer(b"".join([keys[i][k:] for i, k in zip(own, n, strict=True)]), np.uint16)
            order = np.lexsort((rest, key))
            key, rest, w, p = key[order], rest[order], w[order], p[order]
            doc, cut = table[w, 0], np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (rest[1:] != rest[:-1])) + 1, [len(key)]])
            least = np.repeat(np.minimum.reduceat(doc, cut[:-1]), np.diff(cut))
            # A minimiser with different runs: one of each is to be compared.
            kinds = edges(key[cut[:-1]] >> HALF)
            several = np.repeat(np.repeat(np.diff(kinds) > 1, np.diff(kinds)), np.diff(cut))
            later = doc > least
            send_on = later | several
            if send_on.any():
                p = np.where(later, p, p | ASKED)
                yield back(table, w[send_on], p[send_on], buckets)

    sent = rows.mapInArrow(send, "bucket int, keys binary, docs binary, who binary, places binary")
    return gathered(dealt(sent, buckets).mapInArrow(meet, BACK), buckets, "runs")


def compared(rows: DataFrame, found: DataFrame, buckets: int, length: int) -> DataFrame:
    """doc_id, key and places of strings that also begin in a document with a smaller id, by the bytes of the marked runs."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*held, strict=True), kinds, strict=True)], ["bucket", "doc_id", "key", "start", "part"])

        for b in batches:
            for d, k, t, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                at, n, asked = unplace(places)
                at, n = at[asked], n[asked]
                if not len(at):
                    continue
                raw = t.as_buffer().to_pybytes()
                data = np.frombuffer(raw, np.uint8)
                h, _, first, _ = runs(data, np.array([len(raw)]), length)
                own = h[np.searchsorted(first, at, side="right") - 1]
                for bucket, a, m in zip((mix(own) % np.uint64(buckets)).tolist(), at.tolist(), n.tolist(), strict=True):
                    held.append((bucket, d, k, a, raw[a : a + m + length - 1]))
                    size += m + length
                if size > PACK_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal runs enter the text once, for their smallest document; its strings' fate is that of its other copies too."""
        for _, docs, keys, starts, parts in by_bucket(batches):
            copies: dict[bytes, list[int]] = {}
            for i, p in enumerate(parts):
                copies.setdefault(p, []).append(i)
            least = np.array([min(docs[i] for i in x) for x in copies.values()], np.int64)
            own, inside = later_strings(list(copies), np.arange(len(least)), least, length)
            if not len(own):
                continue
            # Strings that follow each other go as one place.
            cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)]))
            own, inside, n = own[cut], inside[cut], np.diff(np.append(cut, len(own)))
            table, who, places = np.stack([docs, keys], axis=1).astype(np.int64), [], []
            groups, begins = list(copies.values()), edges(own)
            for a, z in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                for i in groups[own[a]]:
                    who.append(np.full(z - a, i))
                    places.append(place(inside[a:z] + starts[i], n[a:z]))
            yield back(table, np.concatenate(who), np.concatenate(places), buckets)

    asked = rows.join(found, ["doc_id", "key"]).select("doc_id", "key", "text", "places")
    sent = asked.mapInArrow(send, "bucket int, doc_id bigint, key bigint, start int, part binary")
    return gathered(dealt(sent, buckets).mapInArrow(meet, BACK), buckets, "strings")


def repeats(rows: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Places of strings of length bytes of rows (doc_id, key, text) that also begin in a document with a smaller id: doc_id,
    key and places of those that folding tells (and, marked, of the runs it can't tell), and of those the transform tells."""
    if length <= K:
        raise ValueError("strings must be longer than a minimiser's part")
    rows = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "key", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_SLOTS, max(LEAST_SLOTS, (8 * total // (12 * HOT_RUNS)).bit_length()))
    hot = hot_slots(rows, bits, length)
    found = folded(rows, hot, bits, max(1, -(-total // TEXT_A_BUCKET)), length)
    return found, compared(rows, found, max(1, -(-total // RUNS_A_BUCKET)), length)


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row.

    A byte goes if a string of length bytes that covers it also begins in a document with a smaller id. A null text has
    no bytes; rows with a null id are left as they are and remove nothing. Rows of one id don't remove each other's bytes,
    and each keeps its own positions. No rows give no rows; other columns go.
    """
    rows = with_key(docs, id_col, text_col)
    found, more = repeats(rows, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, places, more in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                at, n, asked = unplace((places or b"") + (more or b""))
                gone = covered(at[~asked], n[~asked], length, len(raw))
                spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
                out.append((len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    both = rows.join(found, ["doc_id", "key"], "left").join(more.withColumnRenamed("places", "more"), ["doc_id", "key"], "left").select("doc_id", "text", "places", "more")
    return both.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
