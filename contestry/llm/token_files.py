"""Token-id files coded by a static range asymmetric numeral system.

The corpus' token counts give one frequency table, kept with the files. Ids in document order are cut into independent blocks; in a block,
LANES interleaved states take the ids in turn. A block's row holds its states after encoding (the checkpoint from
which it is decoded), its words, its documents' ids and lengths, and a CRC-32 of its ids; so any block can be decoded
alone and checked. Blocks are rows of Parquet files, written and read by Spark.
"""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.llm.bpe import PIECES, Vocabulary, default_path, escaped, in_batches, placed, vocabulary, words_in
from contestry.llm.common import give_back, shared_dir, table, written

LANES, BLOCK = 32, 16_384
#: The table's frequencies sum to 2**SCALE; states lie in [LOW, LOW * 2**32).
SCALE, LOW = 18, 1 << 31
#: Blocks that are coded side by side, and bytes of text that are encoded together.
SIDE, TEXT_AT_ONCE = 128, 24 << 20
KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32())
#: Documents of a part, and parts at most; beyond, parts grow.
DOCS_A_PART, MOST_PARTS = 4096, 65_536

#: An encoded document, or (n = -1) a task's counts of the ids it met.
RAW = "doc_id bigint, n int, ids binary, met array<int>, times array<bigint>"
CODED = "part int, block int, start bigint, doc_ids array<bigint>, lengths array<int>, n int, crc bigint, states binary, words binary"
READ = "part int, doc_id bigint, start bigint, n_tokens bigint, ids binary"


class Table:
    """Cumulative frequencies of ids, scaled so that each id that occurs has 1 at least."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.low = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)


def frequencies(counts: dict[int, int]) -> np.ndarray:
    """Frequencies by id that sum to 2**SCALE (to nothing where no id occurs), in proportion to the counts."""
    if len(counts) > 1 << (SCALE - 1):
        raise ValueError("too many different ids for the table's scale")
    c = np.zeros(max(counts, default=0) + 1, np.int64)
    for i, n in counts.items():
        c[i] = n
    spare = (1 << SCALE) - len(counts)
    f = np.where(c > 0, 1 + (c * (spare / max(1, c.sum()))).astype(np.int64), 0)
    if counts:
        f[int(np.argmax(f))] += (1 << SCALE) - f.sum()
    return f


def code(blocks: list[np.ndarray], t: Table) -> list[tuple[bytes, bytes]]:
    """States and words of each block; all blocks and lanes move together, from the last id to the first."""
    k = len(blocks)
    steps = -(-max(map(len, blocks)) // LANES)
    ids = np.zeros((k, steps * LANES), np.int64)
    real = np.zeros((k, steps * LANES), bool)
    for i, b in enumerate(blocks):
        ids[i, : len(b)] = b
        real[i, : len(b)] = True
    ids, real = ids.reshape(k, steps, LANES), real.reshape(k, steps, LANES)
    x = np.full((k, LANES), LOW, np.uint64)
    out = np.zeros((steps, k, LANES), np.uint32)
    sent = np.zeros((steps, k, LANES), bool)
    bits, half = np.uint64(SCALE), np.uint64(32)
    for s in range(steps - 1, -1, -1):
        here = real[:, s]
        f, lo = t.freq[ids[:, s]], t.low[ids[:, s]]
        f = np.where(here, f, np.uint64(1))
        full = here & (x >= (np.uint64(LOW >> SCALE) << half) * f)
        out[s] = x.astype(np.uint32)
        sent[s] = full
        y = np.where(full, x >> half, x)
        q = y // f
        x = np.where(here, (q << bits) + (y - q * f) + lo, x)
    return [(x[i].tobytes(), out[:, i][sent[:, i]].tobytes()) for i in range(k)]


def uncode(sizes: list[int], states: list[bytes], words: list[bytes], t: Table) -> list[np.ndarray]:
    """The ids of each block, as code() took them."""
    k = len(sizes)
    steps = -(-max(sizes) // LANES)
    x = np.stack([np.frombuffer(s, np.uint64) for s in states])
    lengths = np.array([len(w) // 4 for w in words])
    at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    flat = np.concatenate([np.frombuffer(b"".join(words), np.uint32), np.zeros(LANES, np.uint32)]).astype(np.uint64)
    left = np.array(sizes)[:, None] - np.arange(LANES)
    ids = np.zeros((k, steps, LANES), np.uint32)
    mask, bits, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for s in range(steps):
        here = left > s * LANES
        slot = x & mask
        sym = t.symbol[slot.astype(np.int64)]
        ids[:, s] = sym
        y = t.freq[sym] * (x >> bits) + slot - t.low[sym]
        need = here & (y < np.uint64(LOW))
        order = np.cumsum(need, axis=1)
        word = flat[np.minimum(at[:, None] + order - 1, len(flat) - 1)]
        x = np.where(here, np.where(need, (y << half) | word, y), x)
        at = at + order[:, -1]
    return [ids[i].reshape(-1)[:n] for i, n in enumerate(sizes)]


def side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, SIDE):
            yield b.slice(i, SIDE)


def compiled_merges(path: str) -> tuple[object, np.ndarray]:
    """tiktoken's encoder with the merges of the file, and the id of each of its ranks."""
    import tiktoken

    v = vocabulary(path)
    ranks = {bytes([b]): b for b in range(256)}
    for k, i in enumerate(v.made.tolist()):
        if ranks.setdefault(v.bytes[i], 256 + k) != 256 + k:
            raise ValueError("two merges make one token")
    return tiktoken.Encoding("merges", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), np.concatenate([v.single, v.made]).astype(np.int32)


def all_ids(texts: pa.Array, v: Vocabulary, merges: tuple[object, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and where each text's begin; each distinct string is encoded once."""
    strings, at, starts = words_in(texts, v)
    words = strings.to_pylist()
    encode, back = merges[0].encode_ordinary, merges[1]
    gc.disable()  # hundreds of thousands of small lists, none in a cycle
    lists = [encode(w) for w in words]
    gc.enable()
    flat = back[np.fromiter(chain.from_iterable(lists), np.int64)]
    if v.special:
        special = pc.match_substring_regex(strings, "|".join(map(escaped, v.special))).to_pylist()
        if any(special):
            lists = [[i for p in v.cut.split(w) for i in ([v.special[p]] if p in v.special else back[encode(p)].tolist())] if s else back[x].tolist() for w, x, s in zip(words, lists, special, strict=True)]
            flat = np.fromiter(chain.from_iterable(lists), np.int32)
    sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
    ids = placed(flat, sizes, at)
    return ids, np.concatenate([[0], np.cumsum(sizes[at + 1] - sizes[at])])[starts]


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of RAW: every document's ids with the end id behind, and what ids each task met how often.

    The ids are those that the tokenizers library gives for the file; its merges are applied by tiktoken's compiled code,
    which takes a sixth of the library's time for the same ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, merges = vocabulary(path), compiled_merges(path)
        total = np.zeros(max(v.size, end_id + 1), np.int64)
        kind = id_type(path, end_id)
        none = pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64()))
        for b in small_parts(batches):
            ids, starts = all_ids(b.column(1), v, merges)
            total += np.bincount(ids, minlength=len(total))
            total[end_id] += b.num_rows
            ends = starts[1:]
            data = np.insert(ids.astype(kind), ends, end_id).tobytes()
            size = np.dtype(kind).itemsize
            edges = ((starts + np.arange(len(starts))) * size).astype(np.int32)
            cells = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(edges), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((np.diff(edges) // size).astype(np.int32)), cells, *[pa.nulls(b.num_rows, x.type) for x in none]], names(RAW))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([met.astype(np.int32)]), pa.array([total[met]])], names(RAW))
        give_back()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RAW)


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def id_type(path: str, end_id: int) -> type:
    """How ids are held between the steps."""
    return np.uint16 if max(vocabulary(path).size - 1, end_id) < 1 << 16 else np.uint32


def small_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about TEXT_AT_ONCE bytes of text (column 1), put together from smaller ones and cut out of larger ones."""
    held, size = [], 0
    for b in batches:
        for cut in in_batches(b.column(1), TEXT_AT_ONCE):
            held.append(b.slice(cut.start, cut.stop - cut.start))
            size += held[-1].nbytes
            if size >= TEXT_AT_ONCE:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def write_files(docs: DataFrame, out: str, path: str, end_id: int = 2) -> None:
    """Token files of docs (doc_id, text) in the folder out, in ascending order of doc_id (nulls first), texts of one id in
    the order of their ids; and the frequency table beside them. An empty table gives files with no blocks."""
    rows = written(encoded(docs, path, end_id), "token-ids")
    counted = rows.filter("n < 0").select(F.explode(F.arrays_zip("met", "times")).alias("x")).groupBy("x.met").agg(F.sum("x.times").alias("times"))
    freq = frequencies({r["met"]: r["times"] for r in counted.collect()})  # as many rows as the vocabulary has, at most
    spark = docs.sparkSession
    spark.createDataFrame(pa.table({"freq": pa.array(freq.tolist(), pa.int64()), "id": pa.array(range(len(freq)), pa.int32())})).coalesce(1).write.parquet(f"{out}/table")
    shared, kind = spark.sparkContext.broadcast(freq), id_type(path, end_id)
    rows = rows.filter("n >= 0").select("doc_id", F.xxhash64("ids").alias("tie"), "n", "ids")
    parts = min(MOST_PARTS, max(1, -(-rows.count() // DOCS_A_PART)))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, own = TaskContext.get().partitionId(), 0, 0, Table(shared.value)
        docs_of, size, ready = [], 0, []

        def close() -> None:
            nonlocal docs_of, size, block, start
            ids = np.frombuffer(b"".join(x for _, _, x in docs_of), kind).astype(np.uint32)
            ready.append((part, block, start, [d for d, _, _ in docs_of], [n for _, n, _ in docs_of], size, ids))
            docs_of, size, block, start = [], 0, block + 1, start + size

        def coded() -> pa.RecordBatch:
            done = code([r[6] for r in ready], own)
            cols = [pa.array(x, t) for x, t in zip(zip(*[r[:6] for r in ready], strict=True), KINDS, strict=True)]
            more = [pa.array([zlib.crc32(r[6].astype("<u4").tobytes()) for r in ready], pa.int64()), pa.array([s for s, _ in done], pa.binary()), pa.array([w for _, w in done], pa.binary())]
            ready.clear()
            return pa.RecordBatch.from_arrays([*cols, *more], names(CODED))

        for b in batches:
            for doc, n, ids in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                docs_of.append((doc, n, ids))
                size += n
                if size >= BLOCK:
                    close()
                    if len(ready) >= SIDE or ready[-1][5] > SIDE * BLOCK:
                        yield coded()
        if docs_of:
            close()
        if ready:
            yield coded()

    ordered.select("doc_id", "n", "ids").mapInArrow(run, CODED).write.parquet(f"{out}/blocks")


def read_files(spark: SparkSession, out: str) -> DataFrame:
    """Per document of the files in out: doc_id, start (ids before it), n_tokens, ids (little-endian unsigned 32-bit).

    A block whose CRC differs stops the job. Repeated doc_ids give repeated rows, in the files' order.
    """
    files = spark.read.schema(CODED).parquet(f"{out}/blocks")
    rows = spark.read.parquet(f"{out}/table").collect()  # a row for each id of the vocabulary
    freq = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(shared.value)
        for b in side_by_side(batches):
            c = {x: b.column(x).to_pylist() for x in ("part", "block", "start", "doc_ids", "lengths", "n", "crc", "states", "words")}
            rows = uncode(c["n"], c["states"], c["words"], own)
            for i, ids in enumerate(rows):
                data = ids.astype("<u4").tobytes()
                if zlib.crc32(data) != c["crc"][i]:
                    raise ValueError(f"part {c['part'][i]}, block {c['block'][i]}: its ids don't match its checksum")
                sizes = np.array(c["lengths"][i], np.int64)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                each = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(data)])
                cols = [pa.array(np.full(len(sizes), c["part"][i], np.int32)), pa.array(c["doc_ids"][i], pa.int64()), pa.array(c["start"][i] + edges[:-1]), pa.array(sizes), each]
                yield pa.RecordBatch.from_arrays(cols, names(READ))

    docs = files.mapInArrow(run, READ)
    # One row for each part, MOST_PARTS at most: safe to send to all tasks.
    before = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_files(table(spark, sf_dir, "documents"), out, default_path(), end_id=2)
    return read_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
