"""Near copies by similarity of their shingles: SimHash fingerprints and MinHash bands find candidates, exact Jaccard verifies them.

Documents with equal shingle sets are one from the start. Fingerprints of the same shingles link by the bit-sliced comparison of
simhash, within its radius; that finds the nearest copies, and few of those near a similarity of 0.8, which are the bands' part. A band is some minima of the set under fixed hash functions;
sets of Jaccard similarity s share one of the bands with probability 1 - (1 - s**ROWS)**BANDS: 0.99994 at 0.8. Candidates are
verified in two rounds: first the fingerprints' links and each document against the smallest id of its band, then, where these links
leave three documents or more of a band in different components, by segments of the band (of bands with the same documents the first
is enough): a task holds two segments, compares what isn't linked yet, and gives the links it finds, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.llm.common import written
from contestry.llm.simhash import SEGMENT, components, majority, shingle_hashes
from contestry.llm.simhash import links as fingerprint_links
from contestry.llm.positions import mix

SHINGLE = 5
#: The least similarity, as a fraction of whole numbers so that no pair is lost to rounding.
LEAST = (4, 5)
BANDS, ROWS = 32, 6
#: Shingles that are hashed at once, and ids (8 MB) that are sent to every task at most.
AT_ONCE, MOST_SENT = 1 << 12, 1 << 20

_R = np.random.default_rng(42)
SALT = _R.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
FACTOR = _R.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
BAND_FACTOR = _R.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; no word: none."""
    return np.unique(shingle_hashes(text, SHINGLE))


def bands(own: np.ndarray) -> np.ndarray:
    """The hash of each band of a set of one shingle or more."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(own), AT_ONCE):
        low = np.minimum(low, ((own[i : i + AT_ONCE, None] ^ SALT) * FACTOR).min(axis=0))
    return mix((mix(low).reshape(BANDS, ROWS) * BAND_FACTOR).sum(axis=1, dtype=np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def short(own: np.ndarray) -> bytes:
    """A set as it travels: 32 bits of each hash (of two sets of m and n shingles, m * n / 2**32 differ but look equal)."""
    return np.unique((mix(own) >> np.uint64(32)).astype(np.uint32)).tobytes()


def links_in(ids: np.ndarray, component: np.ndarray, segment: np.ndarray, bucket: int, bands_of: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all components with similar documents, of one band's documents in one segment or in two.

    A pair is looked at in the first band that both share, in that alone, and only while it is in different components.
    """
    _, number = np.unique(component, return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    flat, ends = np.concatenate(sets), np.cumsum(sizes)
    cross = bool((segment != segment[0]).any())
    out = []
    for a in range(len(ids) - 1):
        rest = slice(a + 1, len(ids))
        fit = (number[rest] != number[a]) & (LEAST[1] * np.minimum(sizes[rest], sizes[a]) >= LEAST[0] * np.maximum(sizes[rest], sizes[a]))
        if cross:
            fit &= segment[rest] != segment[a]
        at = np.flatnonzero(fit) + a + 1
        if len(at):
            same = bands_of[at] == bands_of[a]
            at = at[bands_of[a][same.argmax(axis=1)] == bucket]
        for i in range(0, len(at), 64):
            some = at[i : i + 64]
            some = some[number[some] != number[a]]
            if not len(some):
                continue
            n = sizes[some]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x = flat[np.repeat(ends[some] - n, n) + inner]
            place = np.minimum(np.searchsorted(sets[a], x), len(sets[a]) - 1)
            both = np.add.reduceat((sets[a][place] == x).astype(np.int64), np.cumsum(n) - n)
            for b in some[LEAST[1] * both >= LEAST[0] * (n + sizes[a] - both)].tolist():
                if number[b] != number[a]:
                    out.append((int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))))
                    number[number == number[b]] = number[a]
    return out


def signatures(rows: DataFrame) -> DataFrame:
    """doc_id, digest of the shingle set, its size n, bands (array of long; none for an empty set), and fp, the shingles' SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, fps = [], np.zeros(b.num_rows, np.uint64)
            for i, t in enumerate(b.column(1)):
                hashes = shingle_hashes(t.as_py(), SHINGLE)
                sets.append(np.unique(hashes))
                fps[i] = majority(hashes)
            keys = [bands(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), digests, pa.array([len(s) for s in sets], pa.int64()), lists, pa.array(fps.view(np.int64))], ["doc_id", "digest", "n", "bands", "fp"])

    return rows.mapInArrow(run, "doc_id bigint, digest binary, n bigint, bands array<bigint>, fp bigint")


def alike(reps: DataFrame) -> DataFrame:
    """Links a, b of reps (id, fp) whose fingerprints are equal or within the radius."""
    prints = written(reps.groupBy("fp").agg(F.min("id").alias("id")), "near-fingerprints")
    equal = reps.join(prints.select("fp", F.col("id").alias("low")), "fp").filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    near = fingerprint_links(prints, prints.count())
    return equal.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    first, second = (sets.select(F.col("id").alias(k), F.col("own").alias(f"own_{k}")) for k in ("a", "b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "own_a", "own_b").mapInArrow(run, "a bigint, b bigint")


def links(reps: DataFrame, rows: DataFrame) -> DataFrame:
    """Links a, b that connect all candidates of reps (id, n, bands, fp) that are similar. rows: doc_id and text."""
    spread = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("m"), F.min("id").alias("low")).filter("m > 1")
    met = written(spread.join(sizes, "bucket"), "near-met")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([short(shingle_set(t.as_py())) for t in b.column(1)], pa.binary())], ["id", "own"])

    stars = met.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    stars = written(stars.unionByName(alike(reps.select("id", "fp"))).distinct(), "near-stars")
    asked = written(stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-asked")
    few = asked.count() <= MOST_SENT  # then the ids go to every task, and the texts stay where they are
    sets = written(rows.join(F.broadcast(asked) if few else asked, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "id bigint, own binary"), "near-sets")
    found = written(verified(stars, sets), "near-links")
    # What the stars leave apart: documents of one bucket in different components, by pairs of segments of the bucket.
    of = components(found, "near-stars-components")
    # A pair of two documents was compared as a star. Of bands that hold the same documents the first is enough: their pairs' first
    # common band is no later one.
    at = met.filter("m > 2").select("id", "band", "bucket").join(of, "id", "left").select("id", "band", "bucket", F.coalesce("component", "id").alias("component"))
    same = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    mixed = at.groupBy("band", "bucket").agg(F.count("*").alias("m"), F.min("component").alias("c"), F.max("component").alias("d"), *same).filter("c <> d")
    mixed = mixed.groupBy("m", "x0", "x1").agg(F.min(F.struct("band", "bucket")).alias("first")).select("first.bucket", "m")
    s = F.ceil(F.col("m") / SEGMENT).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: F.struct(F.least("own_", j.cast("bigint")).alias("i"), F.greatest("own_", j.cast("bigint")).alias("j")))
    dealt = at.join(mixed, "bucket").withColumn("s", s).withColumn("own_", F.pmod(F.xxhash64("id"), F.col("s"))).select("id", "component", "bucket", "own_", F.explode(units).alias("u")).select("id", "component", "bucket", F.col("own_").alias("segment"), "u.i", "u.j")
    held = dealt.join(sets, "id").join(reps.select("id", "bands"), "id").select("bucket", "i", "j", "id", "component", "segment", "bands", "own")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []

        def done() -> pa.RecordBatch:
            ids, component, segment, bands_of, own = zip(*rows, strict=True)
            got = links_in(np.array(ids), np.array(component), np.array(segment), unit[0], np.array(bands_of), [np.frombuffer(x, np.uint32) for x in own]) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            for bucket, i, j, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if unit != (bucket, i, j) and rows:
                    yield done()
                    rows = []
                unit = (bucket, i, j)
                rows.append(row)
        if rows:
            yield done()

    more = held.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(compare, "a bigint, b bigint")
    return found.unionByName(more)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id (the smallest id) of every row with an id: components of texts that are similar by LEAST.

    Texts without a word are copies of each other; one of fewer than SHINGLE words has one shingle. Rows of one id are one
    document. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    signed = written(signatures(rows), "near-signatures")
    reps = written(signed.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "near-reps")
    linked = components(links(reps.select("id", "n", "bands", "fp"), rows), "near-components")
    of = reps.select("digest", "id").join(linked, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    return signed.select("doc_id", "digest").join(of, "digest").select("doc_id", "component_id")
