"""Benchmark decontamination by the q-gram lemma over overlapping diagonal bands.

A passage of m characters that occurs with e edits or fewer shares m + 1 - q - q * e of its q-grams with the text, all
on diagonals that lie within e of each other. So the q-gram matches of a text and a passage are counted in bands of
diagonals, 2 * e wide and overlapping by e; only bands that reach the bound are aligned, in a band, and a passage counts
as found where the distance is within its budget. The benchmark is a stated query set: it is taken in blocks of bounded
size, each block's index is sent to all tasks, and every text is read whole for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.llm.common import table, written

#: Bytes in a q-gram (it fits a 64-bit number), and edits allowed for each hundred bytes of a passage.
Q, EDITS = 8, 8
#: Passages shorter than MIN_EDITED bytes (normalised) must occur without edits, and shorter than MIN_PART as whole words.
MIN_EDITED, MIN_PART = 40, 20
#: Bytes of passages whose index goes to every task at once, and q-gram matches of a text that are held at once.
BLOCK_BYTES, MOST_HITS = 4 << 20, 4_000_000
#: Bands of a passage and a text that are aligned at once.
FEW_BANDS = 12

GAP = re.compile(rb"[^a-z0-9\x80-\xff]+")


def normal(text: str | None) -> bytes:
    """Lower case, with every run of white space, ASCII punctuation and other signs one space."""
    return GAP.sub(b" ", (text or "").lower().encode()).strip()


def grams(data: bytes) -> np.ndarray:
    """Each run of Q bytes as one number."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(b) - Q + 1)
    out = np.zeros(n, np.uint64)
    for j in range(Q):
        out = (out << np.uint64(8)) | b[j : j + n]
    return out


def slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def budget(m: int) -> int:
    return m * EDITS // 100 if m >= MIN_EDITED else 0


@dataclass
class Index:
    """Passages of one block with their q-grams in ascending order, and the short ones by their count of words."""

    ids: list[int]
    texts: list[bytes]
    short: dict[int, dict[bytes, list[int]]]
    keys: np.ndarray
    item: np.ndarray
    at: np.ndarray
    filter: np.ndarray
    most_hits: int

    @staticmethod
    def of(items: list[tuple[int, bytes]], most_hits: int = MOST_HITS) -> Index:
        parts = [grams(t if len(t) >= MIN_PART else b"") for _, t in items]
        short: dict[int, dict[bytes, list[int]]] = {}
        for i, (_, t) in enumerate(items):
            if len(t) < MIN_PART:
                short.setdefault(t.count(b" ") + 1, {}).setdefault(t, []).append(i)
        keys = np.concatenate([*parts, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        at = np.concatenate([*[np.arange(len(p), dtype=np.int32) for p in parts], np.zeros(0, np.int32)])
        order = np.argsort(keys, kind="stable")
        bits = np.zeros(1 << 20, bool)
        bits[slot(keys)] = True
        return Index([i for i, _ in items], [t for _, t in items], short, keys[order], item[order], at[order], bits, most_hits)

    @cached_property
    def halves(self) -> tuple[Index, Index]:
        """The passages that aren't short, in two parts; their ids are places in this index."""
        some = [i for i, t in enumerate(self.texts) if len(t) >= MIN_PART]
        return tuple(Index.of([(i, self.texts[i]) for i in part], self.most_hits) for part in (some[: len(some) // 2], some[len(some) // 2 :]))


def banded(a: bytes, b: bytes, shift: int, most: int) -> tuple[int, int, int] | None:
    """The least edits, up to most, that turn a into a part of b that begins near shift; and that part's begin and end.

    Rows follow a; only diagonals within 2 * most of the shift are kept, and the part may begin at any of them for free.
    """
    half = 2 * most
    width = 2 * half + 1
    far = most + 1
    inner = np.frombuffer(a, np.uint8)
    outer = np.zeros(len(a) + width, np.uint8)
    lo = shift - half
    first, last = max(lo, 0), min(len(b), lo + len(outer))
    if first >= last:
        return None
    outer[first - lo : last - lo] = np.frombuffer(b, np.uint8)[first:last]
    usable = np.zeros(len(outer) + 1, bool)  # places between letters that lie in b
    usable[max(0, -lo) : last - lo + 1] = True
    # Column k of row i is the place lo + i + k in b. A cost also carries where its path began.
    begin = np.arange(width)
    cost = np.where(usable[:width], 0, far).astype(np.int64) * 1_000_000 + begin
    step = np.arange(width) * 1_000_000
    for i in range(len(a)):
        same = outer[i : i + width] == inner[i]
        free = usable[i + 1 : i + 1 + width]
        diagonal = cost + np.where(same, 0, 1_000_000)
        up = np.append(cost[1:], far * 1_000_000) + 1_000_000
        new = np.where(free, np.minimum(diagonal, up), far * 1_000_000)
        # Steps along b within the row: a running minimum of cost - place.
        cost = np.where(free, np.minimum.accumulate(new - step) + step, far * 1_000_000)
        if cost.min() >= far * 1_000_000:
            return None
    k = int(np.argmin(cost))
    edits, begun = divmod(int(cost[k]), 1_000_000)
    return (edits, lo + begun, lo + len(a) + k) if edits <= most else None


def whole_words(data: bytes, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, 0, begin, end) of the first place of each short passage that stands in data as whole words."""
    found: dict[int, tuple[int, int, int, int]] = {}
    words = data.split(b" ")
    begins = np.cumsum([0, *[len(w) + 1 for w in words]]).tolist()
    for k, texts in index.short.items():
        for a in range(len(words) - k + 1):
            t = words[a] if k == 1 else b" ".join(words[a : a + k])
            for i in texts.get(t, ()):
                found.setdefault(i, (i, 0, begins[a], begins[a] + len(t)))
    return list(found.values())


def find(data: bytes, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, edits, begin, end) of the best occurrence in data of each passage that occurs within its budget."""
    return (whole_words(data, index) if index.short else []) + similar(data, index)


def similar(data: bytes, index: Index) -> list[tuple[int, int, int, int]]:
    """What find() tells of the passages that aren't short. No more than index.most_hits q-gram matches are held at once."""
    g = grams(data)
    pos = np.flatnonzero(index.filter[slot(g)])
    if not len(pos):
        return []
    lo = np.searchsorted(index.keys, g[pos], "left")
    n = np.searchsorted(index.keys, g[pos], "right") - lo
    pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
    if not len(pos):
        return []
    ends = np.cumsum(n)
    if ends[-1] > index.most_hits:  # q-grams that many passages have: half of the passages at a time
        several = sum(len(t) >= MIN_PART for t in index.texts) > 1
        return [(half.ids[i], *rest) for half in index.halves for i, *rest in similar(data, half)] if several else repetitive(data, index, pos, lo, n, ends)
    entry = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(lo, n)
    item, diagonal = index.item[entry].astype(np.int64), np.repeat(pos, n) - index.at[entry]
    found = []
    order = np.argsort(item, kind="stable")
    item, diagonal = item[order], diagonal[order]
    edges = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        i = int(item[a])
        e, need = bound(index.texts[i])
        if z - a < need:
            continue
        d = np.sort(diagonal[a:z])
        # Bands of 2e + 1 diagonals begin at every multiple of e + 1, so any e + 1 neighbours lie in one of them.
        step = e + 1
        starts = np.unique(np.concatenate([d // step, d // step - 1])) * step
        count = np.searchsorted(d, starts + 2 * step - 1, "left") - np.searchsorted(d, starts, "left")
        best = aligned(index.texts[i], data, starts[count >= need])
        if best:
            found.append((i, *best))
    return found


def repetitive(data: bytes, index: Index, pos: np.ndarray, lo: np.ndarray, n: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    """similar() for the index's one passage where its q-grams repeat without end: matches are counted by diagonal, most_hits of them at a
    time, in one number for each byte of the text and the passage."""
    i = int(index.item[0])
    text = index.texts[i]
    e, need = bound(text)
    step = e + 1
    base = -(-(len(text) + step) // step) * step  # of the least diagonal's band
    counts = np.zeros(base + len(data) + 2 * step + 1, np.int32)
    cuts = np.searchsorted(ends, np.arange(index.most_hits, ends[-1] + index.most_hits, index.most_hits), "left") + 1
    for a, z in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
        z = min(z, len(pos))
        k = n[a:z]
        own = np.cumsum(k)
        entry = np.arange(own[-1] if len(own) else 0) - np.repeat(own - k, k) + np.repeat(lo[a:z], k)
        seen, times = np.unique(np.repeat(pos[a:z], k) - index.at[entry] + base, return_counts=True)
        counts[seen] += times.astype(np.int32)
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    starts = np.arange(0, base + len(data), step)
    inside = upto[np.minimum(starts + 2 * step - 1, len(counts))] - upto[starts]
    best = aligned(text, data, starts[inside >= need] - base)
    return [(i, *best)] if best else []


def bound(text: bytes) -> tuple[int, int]:
    """The edits that a passage may have, and the q-grams that must then be left."""
    e = budget(len(text))
    return e, max(1, len(text) + 1 - Q - Q * e)


def aligned(text: bytes, data: bytes, starts: np.ndarray) -> tuple[int, int, int] | None:
    """The best alignment in the bands that begin at starts: the least edits, then the first.

    A band whose bytes were looked at before can't be better, nor can one where the passage needs as many edits anywhere in
    those bytes, which is counted where there are many bands; only the others are aligned. So a text that repeats itself costs little more than what it repeats.
    """
    e, best, seen = budget(len(text)), None, set()
    many = len(starts) > FEW_BANDS  # else aligning them costs no more than counting first
    letters: dict[int, int] = {}
    for i, c in enumerate(text if e and many else b""):
        letters[c] = letters.get(c, 0) | 1 << i
    for s in starts.tolist():
        if e:
            reach = 2 * e
            window = data[max(0, s + e - reach) : max(0, s + e + len(text) + reach + 1)]
            if window in seen:
                continue
            seen.add(window)
            if many and fewest(letters, len(text), window) > (e if best is None else best[0] - 1):
                continue
        got = banded(text, data, s + e, max(e, 1)) if e else exact(text, data, s)
        if got and got[0] <= e and (best is None or got[0] < best[0]):
            best = got
        if best and best[0] == 0:
            break
    return best


def fewest(letters: dict[int, int], m: int, window: bytes) -> int:
    """The least edits that turn a passage of m bytes into any part of window. letters: for each byte the bits of its places in the passage.

    A column of the table of distances is kept as its steps up and down, a bit for each row.
    """
    every, last = (1 << m) - 1, 1 << (m - 1)
    up, down, now, least = every, 0, m, m
    for c in window:
        same = letters.get(c, 0)
        level = same | down
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | (every & ~(across | up)), up & across
        now += bool(rise & last) - bool(fall & last)
        least = min(least, now)
        rise, fall = rise << 1 & every, fall << 1 & every
        up, down = fall | (every & ~(level | rise)), rise & level
    return least


def exact(text: bytes, data: bytes, at: int) -> tuple[int, int, int] | None:
    return (0, at, at + len(text)) if at >= 0 and data[at : at + len(text)] == text else None


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The passages in blocks of block_bytes or less, one at a time; one longer than that has its own."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("bigint").alias("i"), F.col("text").cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").orderBy("i", "t").toLocalIterator():
        t = normal(r["t"])
        if not t:
            continue
        if size and size + len(t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["i"], t))
        size += len(t)
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, most_hits: int = MOST_HITS) -> DataFrame:
    """One row for each document and passage found in it: doc_id, item_id, edits, begin and end in the normalised text, and
    n_bytes of that.

    Texts and passages are compared in lower case with punctuation and white space as single spaces. A passage of fewer than
    MIN_PART bytes is found as whole words, of fewer than MIN_EDITED without edits, any other within its budget; one without
    a letter or digit finds nothing, as do null texts and passages and empty tables. Repeated item_ids each give rows of their
    own; so do repeated doc_ids, and a null doc_id stays null. Other columns are left out. The index of at most block_bytes of
    passages (or of one longer passage) goes to every task, which holds most_hits matches of q-grams at a time.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, edits int, begin bigint, end bigint, n_bytes bigint"

    def against(items: list[tuple[int, bytes]]) -> DataFrame:
        shared = sc.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index.of(shared.value, most_hits)
            for b in batches:
                got = []
                for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    data = normal(t.as_py())
                    got += [(doc, index.ids[i], e, a, z, len(data)) for i, e, a, z in find(data, index)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "edits", "begin", "end", "n_bytes"])

        return rows.mapInArrow(run, schema)

    found, each = [], blocks(benchmark, block_bytes)
    items = next(each, None)
    while items:
        following = next(each, None)
        part = against(items)
        # With several blocks, each is worked off and written before the next one but one is read.
        found.append(written(part, "leaks") if following or found else part)
        items = following
    out = docs.sparkSession.createDataFrame([], schema)
    for part in found:
        out = part if len(found) == 1 else out.unionByName(part)
    return out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each pair of a document and a benchmark passage that it holds."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = Window.partitionBy("doc_id", "item_id").orderBy("edits", "begin", "end")
    return found.withColumn("n_", F.row_number().over(best)).filter("n_ = 1").drop("n_")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark passage; rows with a null id stay, as do all without a benchmark.

    A passage of fewer than MIN_PART bytes is no evidence within a longer text: a document goes if it is nothing but that.
    Rows of one id go together.
    """
    telling = (F.col("end") - F.col("begin") >= MIN_PART) | ((F.col("begin") == 0) & (F.col("end") == F.col("n_bytes")))
    bad = written(leaks(docs, benchmark).filter(telling).select("doc_id").filter("doc_id IS NOT NULL").distinct(), "leaks")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
