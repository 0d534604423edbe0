"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has 64 bits, each the majority over its shingles' hashes. Distinct fingerprints that may lie
within the radius share the bits of some blocks (pigeonhole), so they meet in a bucket of that combination of blocks.
In a bucket, 64 fingerprints at a time stand as vertical bit planes; a query's distances to all 64 grow together in
bitwise carry-save counters, plane by plane, and a word of 64 is abandoned once all of its lanes exceed the radius.
A bucket returns a spanning forest, never all pairs; components follow by distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import table, written

SEED = 42
SHINGLE, RADIUS = 4, 4
#: Fingerprints of a bucket that are compared in one unit; larger buckets are dealt out as pairs of such segments.
SEGMENT = 2048
#: Mean bucket size up to which a coarser choice of blocks serves.
MEAN_BUCKET = 256


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hash of each shingle: lower-cased A-Z, words between ASCII white space, shingles with repeats; no word: none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:z], SEED) for a, z in zip(begins, ends, strict=True)], np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """64-bit SimHash of shingles' hashes: each bit as in over half of them; none: 0."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles' hashes; no word: 0."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row; a null text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def cuts(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:], strict=False)]


def choose_blocks(n: int, radius: int) -> int:
    """The fewest blocks for which n evenly spread fingerprints give buckets of MEAN_BUCKET or less. Any choice finds all links."""
    for blocks in range(radius + 1, 2 * radius + 1):
        if n <= MEAN_BUCKET << (64 // blocks) * (blocks - radius):
            return blocks
    return 2 * radius + 1


def compare(fps: np.ndarray, query: np.ndarray, word: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """For each (query, word) a mask of the word's lanes within the radius of the query's fingerprint.

    planes: 64 by words, lane j of a word being bit j. The counters have as many bits as the radius needs, and a sticky
    one for what exceeds them; every eight planes the words with no lane left are dropped.
    """
    levels = max(1, radius.bit_length())
    ones = ~np.uint64(0)
    out = np.zeros(len(query), np.uint64)
    at = np.arange(len(query))
    over = np.zeros(len(at), np.uint64)
    count = [np.zeros(len(at), np.uint64) for _ in range(levels)]
    q = fps[query]
    for p in range(64):
        carry = planes[p][word] ^ np.where((q >> np.uint64(p)) & np.uint64(1), ones, np.uint64(0))
        for i in range(levels):
            count[i], carry = count[i] ^ carry, count[i] & carry
        over |= carry
        if p % 8 == 7:
            # Lanes above the radius: compare the counter with it from the top bit down.
            above, equal = over.copy(), ~over
            for i in range(levels - 1, -1, -1):
                if not radius >> i & 1:
                    above |= equal & count[i]
                    equal &= ~count[i]
                else:
                    equal &= count[i]
            left = np.flatnonzero(above != ones)
            if p == 63:
                out[at[left]] = ~above[left]
            elif len(left) < len(at):
                at, over, q, query, word = at[left], above[left], q[left], query[left], word[left]
                count = [c[left] for c in count]
                if not len(at):
                    break
            else:
                over = above
    return out


def forest(ids: np.ndarray, fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, smallest id of its component in the bucket) of rows sorted by bucket."""
    n = len(ids)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [n]])
    size = np.diff(edge)
    width = -(-size // 64)
    first_word = np.concatenate([[0], np.cumsum(width)])
    # Each bucket's rows fill words of 64 lanes; unused lanes hold nothing and are masked out.
    inside = np.arange(n) - np.repeat(edge[:-1], size)
    slot = np.repeat(first_word[:-1], size) * 64 + inside
    words = int(first_word[-1])
    planes = np.zeros((64, words), np.uint64)
    lanes = np.zeros(words * 64, np.uint64)
    lanes[slot] = fps
    used = np.zeros(words * 64, np.uint8)
    used[slot] = 1
    row_at = np.full(words * 64, -1, np.int64)
    row_at[slot] = np.arange(n)
    for p in range(64):
        planes[p] = np.packbits(((lanes >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)
    valid = np.packbits(used, bitorder="little").view(np.uint64)
    of = np.repeat(np.arange(len(size)), size)
    label = np.arange(n)  # rows of one component have one label
    # A query meets the words from its own on, so that each pair is seen once; a few million combinations at a time.
    combos = first_word[of + 1] - (slot >> 6)
    total = np.cumsum(combos)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + (1 << 20), "right")))
        k = combos[start:end]
        query = np.repeat(np.arange(start, end), k)
        ends = np.cumsum(k)
        word = np.arange(ends[-1]) - np.repeat(ends - k, k) + np.repeat(slot[start:end] >> 6, k)
        mask = compare(fps, query, word, planes, radius) & valid[word]
        own = word == slot[query] >> 6
        mask[own] &= ~(np.uint64(1) << (slot[query[own]] & 63).astype(np.uint64))
        hit = np.flatnonzero(mask)
        new = np.flatnonzero(np.diff(query[hit])) + 1
        for some in np.split(hit, new) if len(hit) else []:
            row = int(query[some[0]])
            lane = np.flatnonzero(np.unpackbits(mask[some].view(np.uint8), bitorder="little"))
            near = label[row_at[word[some][lane >> 6] * 64 + (lane & 63)]]
            if (near != label[row]).any():
                here = label[edge[of[row]] : edge[of[row] + 1]]
                joined = np.unique(np.append(near, label[row]))
                here[np.isin(here, joined)] = joined[0]
        start = end
    lowest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(lowest, label, ids)
    low = np.flatnonzero(lowest[label] != ids)
    return ids[low], lowest[label[low]]


def links(reps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links a, b of all reps (id, fp, one row for each distinct fingerprint) that connect what lies within the radius."""
    blocks = choose_blocks(n, radius)
    keys = []
    for k, chosen in enumerate(combinations(cuts(blocks), blocks - radius)):
        parts = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in chosen]
        keys.append(F.xxhash64(F.lit(k), *parts))
    spread = reps.select("id", "fp", F.explode(F.array(*keys)).alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("m")).filter(F.col("m") > 1)
    met = spread.join(sizes, "bucket")
    # A bucket of m rows is cut into s segments; each pair of segments is a unit, and a row goes to the s units of its own.
    s = F.ceil(F.col("m") / SEGMENT).cast("int")
    own = F.pmod(F.xxhash64("id"), s)
    units = F.transform(F.sequence(F.lit(0), s - 1), lambda j: F.struct(F.least(own, j.cast("bigint")).alias("i"), F.greatest(own, j.cast("bigint")).alias("j")))
    dealt = met.select("id", "fp", "bucket", F.explode(units).alias("u"))
    unit = F.xxhash64("bucket", "u.i", "u.j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            a, b = forest(rows[0], rows[1].view(np.uint64), rows[2], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            held.append(np.stack([b.column(i).to_numpy() for i in range(3)]))
            rows = np.concatenate(held, axis=1)
            last = int(np.searchsorted(rows[2], rows[2][-1], "left"))  # the last unit may go on in the next batch
            if last > 20_000:
                yield flush(np.ascontiguousarray(rows[:, :last]))
                rows = rows[:, last:]
            held = [rows]
        if held:
            yield flush(np.ascontiguousarray(np.concatenate(held, axis=1)))

    rows = dealt.select("id", "fp", unit.alias("unit"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """id and component (the smallest id reachable) of every id in edges (a, b), by alternating star contraction.

    Each round is written to the shared folder. Rounds end when the stars no longer change.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    before = None
    while True:
        # Large star: every neighbour above u goes to the smallest of u and its neighbours.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u and its neighbours below it go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row: components of fingerprints that differ in radius bits or fewer.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null id are kept with component null,
    link nothing, and repeated ids stay repeated. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = written(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last")), "distinct-fingerprints")
    linked = components(links(reps.select("id", "fp"), reps.count(), radius))
    of = reps.join(linked, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    found = prints.join(of, "fp", "left")
    return found.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """docs with the row of the smallest doc_id of each component; rows with a null id stay.

    found: doc_id and component_id of every row; without it, components of SimHash fingerprints.
    """
    found = near_duplicates(docs) if found is None else found
    chosen = written(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n_")), "kept-ids")
    rows = docs.join(chosen, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
    again = chosen.filter("n_ > 1").select("doc_id")
    if again.isEmpty():
        return rows
    # A repeated id: one of its rows stays, the smallest by its other columns.
    others = [c for c in docs.columns if c != "doc_id"]
    low = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row_"))
    folded = low.select(*[F.col("doc_id") if c == "doc_id" else F.col("row_").getField(c).alias(c) for c in docs.columns])
    return rows.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(folded)
