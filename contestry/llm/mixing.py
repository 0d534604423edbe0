"""Language-model scoring by logistic context mixing.

A text (lower-cased A-Z, words joined by one space, one end byte) is coded bit by bit. For each of CONTEXTS, so many bytes
before the byte and its earlier bits find two counts; their log-odds are combined by a weight set that a gate chooses (the
longest known context and how often it was seen), and an adaptive map refines the mix.

All counts are kept, however many there are. Texts are packed; each pack's distinct n-grams go to buckets by a hash of their
last LOCAL bytes of context, so that a bucket holds all counts of the contexts of LOCAL bytes and more; the counts of the
shortest context, at most 2**24 of them, go to every task. Each partition of buckets learns the weights and the map in small
batches, each n-gram with one of its own occurrences left out; partitions' weights are averaged by their precision, and the
model is frozen. Buckets then tell each pack what its n-grams are worth, and a pack adds up its texts' scores.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import fold, give_back, table, written
from contestry.llm.positions import by_bucket, dealt, edges, mix

#: Bytes of the longest context; of the contexts mixed, by how much they tell; and of the one that buckets go by.
ORDER = 6
CONTEXTS = (2, 4, 5, 6)
SHORT, LOCAL = CONTEXTS[0], CONTEXTS[1]
INPUTS = len(CONTEXTS) + 1
#: Gates: the last known context (none, or one of CONTEXTS) by how often it was seen (1, 2-3, 4-15, more).
GATES = (len(CONTEXTS) + 1) * 4
BUCKETS, REACH = 33, 8.0
LEARNED = GATES * (INPUTS * (INPUTS + 1) + 2 * BUCKETS)
#: Bytes of text in a pack, and for which there is one bucket of n-grams or of words.
PACK_BYTES, TEXT_A_BUCKET, TEXT_A_WORD_BUCKET = 6 << 20, 8 << 20, 64 << 20
#: Bytes of a pack whose n-grams are sorted at once, and the steps in which log2 probabilities return to packs.
CHUNK_BYTES, STEP = 1 << 20, 512
#: Shares of the buckets in which a pack's n-grams are put together.
SHARES = 16
#: N-grams that are worked on at once; a context's n-grams stay together.
AT_ONCE = 16_384

PACKS = "pack bigint, bytes bigint, ids array<bigint>, held array<boolean>, sizes array<int>, data binary"


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def packed(docs: DataFrame) -> DataFrame:
    """Packs of documents (doc_id, text, held_out), normalised, each text with its end byte; in the order they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, parts, size = [], [], [], 0

        def pack() -> pa.RecordBatch:
            cells = [uuid.uuid4().int >> 65, size, ids, held, list(map(len, parts)), b"".join(parts)]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names(PACKS))

        for b in batches:
            for d, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                ids.append(d)
                held.append(h)
                parts.append(normal(t.as_py()) + b"\0")
                size += len(parts[-1])
                if size >= PACK_BYTES:
                    yield pack()
                    ids, held, parts, size = [], [], [], 0
        if ids:
            yield pack()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out")
    return rows.mapInArrow(run, PACKS)


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def events(data: bytes, sizes: np.ndarray) -> np.ndarray:
    """For each byte of the texts that follow each other in data: the ORDER bytes before it, the last one first, and itself."""
    ends = np.cumsum(sizes)
    b = np.frombuffer(data, np.uint8)
    key = b.astype(np.uint64)
    inside = np.arange(len(b)) - np.repeat(ends - sizes, sizes)
    for k in range(1, ORDER + 1):
        before = np.zeros(len(b), np.uint64)
        before[k:] = b[:-k] if k <= len(b) else 0
        before[inside < k] = 0  # before a text stand zeros
        key |= before << np.uint64(8 * (ORDER - k + 1))
    return key


def chunks(data: bytes, sizes: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The events of a pack's texts, some texts at a time."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        first = int(ends[start] - sizes[start])
        stop = max(start + 1, int(np.searchsorted(ends, first + CHUNK_BYTES)))
        yield slice(start, stop), events(data[first : int(ends[stop - 1])], sizes[start:stop])
        start = stop


def added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sums of their numbers."""
    order = np.argsort(key)
    key = key[order]
    cut = edges(key)
    return key[cut[:-1]], np.add.reduceat(n[order], cut[:-1]) if len(key) else n


def masked(key: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of context, and the byte."""
    return (key & np.uint64(((1 << 8 * n) - 1) << 8 * (ORDER - n + 1))) | (key & np.uint64(255))


def context_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key >> np.uint64(8 * (ORDER - LOCAL + 1))) % np.uint64(buckets)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Bytes of numbers, all first bytes first: sorted or small numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def words_of(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of a pack's distinct words, the place among them of each word, and each text's count of words."""
    texts = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(data)])
    lists = pc.split_pattern(pc.binary_slice(texts, 0, -1), b" ")
    counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
    counts[sizes == 1] = 0
    flat = lists.flatten()
    flat = flat.filter(pa.array(np.repeat(sizes > 1, pc.list_value_length(lists).to_numpy())))
    words = flat.dictionary_encode()
    h = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words.dictionary.to_pylist()], np.uint64)
    kinds, number = np.unique(h, return_inverse=True)
    return kinds, number[words.indices.to_numpy()], counts


def by(bucket: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """bucket, keys and numbers of each bucket, in ascending order; keys of a bucket stay in order."""
    order = np.argsort(bucket, kind="stable")
    bucket, key, n = bucket[order], key[order], n[order].astype(np.uint32)
    cut = edges(bucket)
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(bucket[a]), planes(key[a:z]), planes(n[a:z])


def pack_counts(data: bytes, sizes: np.ndarray, held: np.ndarray, buckets: int) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Rows (bucket, distinct n-grams, their counts in training texts) of a pack, a few buckets at a time.

    Each chunk's n-grams lie in order of their share of the buckets, so only one share is put together at once.
    """
    parts = []
    for texts, key in chunks(data, sizes):
        key <<= np.uint64(1)
        key |= np.repeat(held[texts], sizes[texts])
        key.sort()
        cut = edges(key >> np.uint64(1))
        in_training = np.concatenate([[0], np.cumsum(1 - (key & np.uint64(1)).astype(np.int8), dtype=np.int32)])
        n = np.diff(in_training[cut]).astype(np.uint32)
        key = key[cut[:-1]] >> np.uint64(1)
        share = (context_bucket(key, buckets) * SHARES // buckets).astype(np.uint8)
        order = np.argsort(share, kind="stable")
        parts.append((key[order], n[order], np.searchsorted(share[order], np.arange(SHARES + 1, dtype=np.uint8))))
    for i in range(SHARES):
        key, n = (np.concatenate([p[j][p[2][i] : p[2][i + 1]] for p in parts]) for j in (0, 1))
        if len(key):
            key, n = added(key, n)
            yield list(by(context_bucket(key, buckets), key, n))


def counted(packs: DataFrame, buckets: int, word_buckets: int) -> DataFrame:
    """A row for each bucket: its keys, how often each occurs in training texts, and which of them each pack holds.

    Buckets below 0 are of words (-1 and down), the others of n-grams.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                pack, held, sizes, data = (b.column(x)[i].as_py() for x in ("pack", "held", "sizes", "data"))
                sizes, held = np.array(sizes), np.array(held)
                for rows in pack_counts(data, sizes, held, buckets):
                    yield told(pack, rows)
                h, at, counts = words_of(data, sizes)
                yield told(pack, [(-1 - g, k, c) for g, k, c in by((h % np.uint64(word_buckets)).astype(np.int64), h, np.bincount(at[~np.repeat(held, counts)], minlength=len(h)))])
                give_back()

    def told(pack: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([pack] * len(rows), pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)]], ["bucket", "pack", "keys", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, packs_of, keys, n in by_bucket(batches):
            sizes = np.array([len(k) // 8 for k in keys])
            key = np.concatenate([unplanes(k, np.uint64) for k in keys])
            keys.clear()
            order = np.argsort(key).astype(np.uint32)
            key = key[order]
            cut = edges(key)
            key = key[cut[:-1]]
            total = np.add.reduceat(np.concatenate([unplanes(x, np.uint32) for x in n])[order], cut[:-1], dtype=np.int64)
            n.clear()
            place = np.empty(len(order), np.uint32)
            place[order] = np.repeat(np.arange(len(key), dtype=np.uint32), np.diff(cut))
            del order, cut
            ends = np.cumsum(sizes)
            steps = [planes(np.diff(place[a:z], prepend=np.uint32(0))) for a, z in zip(ends - sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([bucket[0]], pa.int32()), pa.array([planes(key)], pa.binary()), pa.array([planes(total)], pa.binary()), pa.array([packs_of], pa.list_(pa.int64())), pa.array([steps], pa.list_(pa.binary()))], ["bucket", "keys", "n", "packs", "steps"])

    sent = packs.select("pack", "held", "sizes", "data").mapInArrow(send, "bucket int, pack bigint, keys binary, n binary")
    return dealt(sent, buckets + word_buckets).mapInArrow(add, "bucket int, keys binary, n binary, packs array<bigint>, steps array<binary>")


def levels(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For sorted keys (context and byte): for 0 to 8 first bits of the byte, how often the context was followed by them."""
    total = np.concatenate([[0], np.cumsum(n)])
    out = np.empty((9, len(key)), np.float32)
    for bits in range(9):
        cut = edges(key >> np.uint64(8 - bits))
        out[bits] = np.repeat(np.diff(total[cut]), np.diff(cut))
    return out


def short_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the shortest context and their counts: 2**(8 * SHORT + 8) at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key = masked(unplanes(keys, np.uint64), SHORT)
                order = np.argsort(key)
                key, n = key[order], unplanes(n, np.int64)[order]
                cut = edges(key)
                yield pa.RecordBatch.from_arrays([pa.array(key[cut[:-1]].view(np.int64)), pa.array(np.add.reduceat(n, cut[:-1]))], ["key", "n"])

    got = rows.filter("bucket >= 0").select("keys", "n").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = (got.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(key)
    return key[order].view(np.uint64), n[order]


@dataclass
class Model:
    """short, short_levels: the shortest contexts' counts; weights: [GATES, INPUTS]; refined: log-odds by gate and bucket of
    the mix's log-odds."""

    short: np.ndarray
    short_levels: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    def slices(self, key: np.ndarray, n: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Parts of a bucket's sorted keys that hold whole contexts of LOCAL bytes, and their counts [context, bits, key]."""
        cut = edges(key >> np.uint64(8 * (ORDER - LOCAL + 1)))
        start = 0
        for end in cut[1:].tolist():
            if end - start >= AT_ONCE or end == len(key):
                k = key[start:end]
                out = np.empty((len(CONTEXTS), 9, len(k)), np.float32)
                out[0] = self.short_levels[:, np.searchsorted(self.short, masked(k, SHORT))]
                for i, c in enumerate(CONTEXTS[1:], 1):
                    m = masked(k, c)
                    if c == ORDER:
                        out[i] = levels(m, n[start:end])
                    else:
                        order = np.argsort(m)
                        out[i][:, order] = levels(m[order], n[start:end][order])
                yield slice(start, end), out
                start = end

    def inputs(self, key: np.ndarray, counts: np.ndarray, left_out: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each of the eight bits the log-odds of each context, the gate and the bit, with left_out own occurrences left out."""
        byte = key & np.uint64(255)
        for bit in range(8):
            y = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
            x = np.full((len(key), INPUTS), 0.3)
            gate = np.zeros(len(key), np.int64)
            sign = 2.0 * y - 1
            for i in range(len(CONTEXTS)):
                total, same = counts[i, bit] - left_out, counts[i, bit + 1] - left_out
                x[:, i] = np.log((same + 0.2) / (total - same + 0.2)) * sign
                level = (total >= 1.9).astype(np.int64) + (total >= 3.9) + (total >= 15.5)
                gate = np.where(total > 0, (i + 1) * 4 + level, gate)
            yield x, gate, y

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -REACH, REACH)

    def place(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = (z + REACH) * ((BUCKETS - 1) / (2 * REACH))
        i = np.minimum(f.astype(np.int64), BUCKETS - 2)
        return i, f - i

    def log2p(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log to base 2 of each byte's probability in its context, of a bucket's sorted keys."""
        out = np.zeros(len(key))
        for part, counts in self.slices(key, n):
            for x, gate, y in self.inputs(key[part], counts, 0):
                z = self.mix(x, gate)
                i, f = self.place(z)
                z = (z + (1 - f) * self.refined[gate, i] + f * self.refined[gate, i + 1]) / 2
                out[part] -= np.log1p(np.exp(np.where(y == 1, -z, z)))
        return out / math.log(2)


def learn(model: Model, buckets: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Online over parts of buckets: after each, every gate's weights move by its gradient over the precision gathered so far.

    An n-gram weighs as much as it was seen. Returns the precisions, precisions times weights, and for the refinement ones and
    all events by gate and bucket of the mix, each event shared between its two nearest buckets.
    """
    w = model.weights.copy()
    h = np.zeros((GATES, INPUTS, INPUTS))
    prior = np.eye(INPUTS) * 5
    total = np.zeros((2, GATES * BUCKETS))
    for keys, times in buckets:
        for part, counts in model.slices(keys, times):
            seen = times[part] > 0  # the others occur in no training text
            for x, gate, y in model.inputs(keys[part][seen], counts[:, :, seen], 1):
                n = times[part][seen].astype(float)
                order = np.argsort(gate, kind="stable")
                x, gate, y, n = x[order], gate[order], y[order], n[order]
                p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", x, w[gate]), -REACH, REACH)))
                slope, pull = n * np.maximum(p * (1 - p), 1e-3), n * (y - p)
                cut = edges(gate)
                for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    g, xg = gate[a], x[a:z]
                    h[g] += (xg * slope[a:z, None]).T @ xg
                    w[g] += np.linalg.solve(h[g] + prior, xg.T @ pull[a:z])
                i, f = model.place(np.clip(np.einsum("ij,ij->i", x, w[gate]), -REACH, REACH))
                for at, share in ((i, 1 - f), (i + 1, f)):
                    total[0] += np.bincount(gate * BUCKETS + at, n * share * y, GATES * BUCKETS)
                    total[1] += np.bincount(gate * BUCKETS + at, n * share, GATES * BUCKETS)
    return np.concatenate([h.reshape(-1), np.einsum("gij,gj->gi", h, w).reshape(-1), total.reshape(-1)])


def untrained(short: np.ndarray, n: np.ndarray) -> Model:
    centre = np.tile(np.linspace(-REACH, REACH, BUCKETS), (GATES, 1))
    return Model(short, levels(short, n), np.tile(np.array([0.3] * len(CONTEXTS) + [0.0]), (GATES, 1)), centre)


def trained(model: Model, got: np.ndarray) -> Model:
    """The model with the weights and the map of what learn gave, added up over partitions."""
    h = got[: GATES * INPUTS**2].reshape(GATES, INPUTS, INPUTS)
    hw = got[GATES * INPUTS**2 : GATES * INPUTS * (INPUTS + 1)].reshape(GATES, INPUTS)
    prior = np.eye(INPUTS) * 5
    weights = np.stack([np.linalg.solve(h[g] + prior, hw[g] + prior @ model.weights[g]) for g in range(GATES)])
    ones, seen = got[GATES * INPUTS * (INPUTS + 1) :].reshape(2, GATES, BUCKETS)
    p = 1 / (1 + np.exp(-model.refined))
    return Model(model.short, model.short_levels, weights, np.log((ones + 2 * p) / (seen - ones + 2 * (1 - p))))


def train(rows: DataFrame) -> Model:
    """From counted buckets; with no training text every bit has probability one half."""
    model = untrained(*short_counts(rows))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = learn(shared.value, ((unplanes(k, np.uint64), unplanes(n, np.int64)) for b in batches for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got), dtype=np.int32)), pa.array(got)], ["i", "v"])

    got = np.zeros(LEARNED)
    for r in rows.filter("bucket >= 0").select("keys", "n").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        got[r["i"]] = r["v"]
    shared.destroy()
    return trained(model, got)


def answers(rows: DataFrame, model: Model) -> DataFrame:
    """pack, bucket and worth: what the pack's keys in the bucket are worth (n-grams: bits in steps of 1 / STEP, 16 bits a key;
    words: counts)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, keys, n, packs, steps in zip(*[c.to_pylist() for c in b.columns], strict=True):
                n = unplanes(n, np.int64)
                worth = n if bucket < 0 else np.minimum(np.rint(-STEP * shared.value.log2p(unplanes(keys, np.uint64), n)), 65_535).astype(np.uint16)
                for pack, s in zip(packs, steps, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([bucket], pa.int32()), pa.array([planes(worth[np.cumsum(unplanes(s, np.uint32).astype(np.int64))])], pa.binary())], ["pack", "bucket", "worth"])

    return rows.mapInArrow(run, "pack bigint, bucket int, worth binary")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of docs (doc_id, text, held_out).

    Learns from the rows that are not held out. Rows with one id and text have equal scores, each its row. Null and empty
    texts are the end alone. With no training text all words are unknown and every bit has probability one half. Words are
    told apart by 64-bit hashes.
    """
    packs = written(packed(docs), "lm-packs", large=True)
    total = packs.agg(F.sum("bytes")).first()[0] or 0
    buckets, word_buckets = max(1, -(-total // TEXT_A_BUCKET)), max(1, -(-total // TEXT_A_WORD_BUCKET))
    rows = written(counted(packs, buckets, word_buckets), "lm-counts", large=True)
    model = train(rows)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [unplanes(x, np.int64) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in n], pa.int64()), pa.array([int(np.count_nonzero(x)) for x in n], pa.int64())], ["n", "v"])

    ends = packs.select(F.explode("held").alias("held")).filter("NOT held").count()
    n, v = rows.filter("bucket < 0").select("n").mapInArrow(of_words, "n bigint, v bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n_all, distinct = n + ends, v + (ends > 0)
    below = n_all + 0.1 * (distinct + 1)
    own_end = math.log10((ends + 0.1) / below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, worth = None, {}

        def scored(ids: list, held: list, sizes: list, data: bytes) -> pa.RecordBatch:
            sizes = np.array(sizes)
            parts = []
            for own, key in chunks(data, sizes):
                order = np.argsort(key)
                cut = edges(key[order])
                place = np.empty(len(key), np.uint32)
                place[order] = np.repeat(np.arange(len(cut) - 1, dtype=np.uint32), np.diff(cut))
                parts.append((own, key[order][cut[:-1]], place))
            kinds = np.sort(np.concatenate([k for _, k, _ in parts]))
            kinds = kinds[edges(kinds)[:-1]]
            each = np.empty(len(kinds), np.uint16)
            to = np.argsort(context_bucket(kinds, buckets), kind="stable")
            each[to] = np.concatenate([unplanes(worth[g], np.uint16) for g in sorted(g for g in worth if g >= 0)])
            bits = np.concatenate([np.add.reduceat(each[np.searchsorted(kinds, k)][place], np.cumsum(sizes[own]) - sizes[own], dtype=np.int64) for own, k, place in parts]) / STEP
            del parts, kinds, each, to
            h, at, counts = words_of(data, sizes)
            c = np.empty(len(h), np.int64)
            to = np.argsort((h % np.uint64(word_buckets)).astype(np.int64), kind="stable")
            if len(h):
                c[to] = np.concatenate([unplanes(worth[g], np.int64) for g in sorted((g for g in worth if g < 0), reverse=True)])
            of = np.repeat(np.arange(len(sizes)), counts)
            base = np.bincount(of, np.log10((c + 0.1) / below)[at], len(sizes)) + own_end
            known = np.bincount(of, (c > 0)[at], len(sizes)).astype(np.int64) + (ends > 0)
            k = len(sizes)
            cols = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(counts + 1), pa.array(known), pa.array(np.full(k, n_all, np.int64)), pa.array(base), pa.array(bits * -math.log10(2)), pa.array(bits / sizes)]
            give_back()
            return pa.RecordBatch.from_arrays(cols, names(SCORES))

        pack = None
        for b in batches:
            for p, bucket, ids, held, sizes, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if p != pack:
                    if text:
                        yield scored(*text)
                    pack, text, worth = p, None, {}
                if ids is not None:
                    text = (ids, held, sizes, data)
                else:
                    worth[bucket] = data
        if text:
            yield scored(*text)
        give_back()

    told = answers(rows, model).select("pack", "bucket", *[F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<bigint>"), ("held", "array<boolean>"), ("sizes", "array<int>"))], F.col("worth").alias("data"))
    both = packs.select("pack", F.lit(None).cast("int").alias("bucket"), "ids", "held", "sizes", "data").unionByName(told)
    return both.repartition("pack").sortWithinPartitions("pack").mapInArrow(run, SCORES)


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.withColumn("held_out", fold("doc_id", 10) == 0))
