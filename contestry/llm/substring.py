"""Substring deduplication by difference-cover anchors.

A window of WINDOW words that occurs twice is found in two steps. Anchors, windows of WINDOW - PERIOD + 1 words, are
hashed only at positions whose remainder modulo PERIOD lies in a difference cover; whatever the two occurrences'
positions are, one shift below PERIOD puts both on the cover, so they share an aligned anchor. Only windows that hold a
repeated anchor are then extended to their full length, hashed in 128 bits, and counted. Hashes leave a task in blobs, one
for each batch of documents and bucket, in which a hash that repeats within the batch is sent once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.bpe import in_batches
from contestry.llm.common import give_back, table
from contestry.llm.positions import ASKED, BACK, back, by_bucket, covered, dealt, edges, gathered, joined, n_buckets, place, unplace, window_hashes, with_key

WINDOW = 35
#: A perfect difference set: every remainder modulo PERIOD is a difference of two of its members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Bytes of text for which there is one bucket, of texts that are hashed together, and of texts whose hashes are packed together.
TEXT_A_BUCKET, CHUNK_BYTES, PACK_BYTES = 24 << 20, 1 << 20, 8 << 20


def word_hashes(words: pa.Array, memo: dict[bytes, bytes]) -> np.ndarray:
    """128-bit hashes of words (BLAKE2b) as two columns, remembered up to a bound."""
    if len(memo) > 200_000:
        memo.clear()
    out = []
    for w in words.to_pylist():
        h = memo.get(w)
        if h is None:
            h = hashlib.blake2b(w, digest_size=16).digest()
            if len(w) < 64:
                memo[w] = h
        out.append(h)
    return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)


def words_of(texts: pa.Array, memo: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the words of all texts, one after another, and where each text's begin, with the end behind."""
    lists = pc.ascii_split_whitespace(texts)
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(pc.binary_length(flat), 0)  # white space at a text's ends leaves empty words
    kept = real.to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(kept)])[starts]
    words = flat.filter(real).cast(pa.binary()).dictionary_encode()
    return word_hashes(words.dictionary, memo)[words.indices.to_numpy()], starts


#: From hashes of words, where texts begin, and the places each text brings: hashes (two columns), texts and starts.
Picker = Callable[[np.ndarray, np.ndarray, list[bytes | None]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def anchors(words: np.ndarray, starts: np.ndarray, _: list[bytes | None], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = window - PERIOD + 1
    h = window_hashes(words[:, 0], size)
    n = np.diff(starts)
    of = np.repeat(np.arange(len(n)), n)[: len(h)]
    at = np.arange(len(h)) - starts[of]
    on = np.isin(np.arange(PERIOD), COVER)[at % PERIOD] & (at + size <= n[of]) & (n[of] >= window)
    return h[on, None], of[on], at[on]


def candidates(words: np.ndarray, starts: np.ndarray, places: list[bytes | None], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full windows that hold an anchor in places."""
    size = window - PERIOD + 1
    near = np.zeros(len(words) + 1, np.int64)
    for begin, n, p in zip(starts[:-1].tolist(), np.diff(starts).tolist(), places, strict=True):
        if n >= window and p:
            a, _, _ = unplace(p)
            np.add.at(near, begin + np.maximum(a + size - window, 0), 1)
            np.add.at(near, begin + np.minimum(a + 1, n - window + 1), -1)
    at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    of = np.searchsorted(starts, at, side="right") - 1
    h = np.stack([window_hashes(words[:, i], window)[at] for i in (0, 1)], axis=1) if len(at) else np.zeros((0, 2), np.uint64)
    return h, of, at - starts[of]


def repeated_positions(rows: DataFrame, pick: Picker, buckets: int, name: str) -> DataFrame:
    """doc_id, key and places (not in order) of the hashes that occur twice or more; a row a document.

    rows: doc_id, key, text and places. A bucket holds one blob for each batch, in which each hash stands once, so a hash of
    any number of documents adds no more to it than there are batches. Hashes of one column are compared by 32 bits within
    their bucket (candidates only), those of two columns by all 128.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, bytes] = {}
        held: list[tuple[np.ndarray, ...]] = []
        docs: list[np.ndarray] = []
        count, size = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            who_are = np.concatenate(docs)
            h, who, at = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.argsort(h[:, 0]) if h.shape[1] == 1 else np.lexsort((h[:, 1], h[:, 0]))
            h, who, places = h[order], who[order], place(at[order])
            new = np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)]) if len(h) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            several = np.diff(np.append(first, len(h))) > 1
            # What repeats here is known already; one copy of it, marked, still tells the other batches.
            local = several[np.cumsum(new) - 1] if len(h) else new
            if local.any():
                known = back(who_are, who[local], places[local], buckets)
                yield pa.RecordBatch.from_arrays([known.column(0), pa.nulls(known.num_rows, pa.binary()), *known.columns[1:]], ["bucket", "hashes", "docs", "who", "places"])
            h, who, places = h[first], who[first], np.where(several, places[first] | ASKED, places[first])
            bucket = ((h[:, 0] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((places & ~ASKED, who, bucket))  # in the documents' order blobs compress better
            bucket, h, who, places = bucket[order], h[order], who[order], places[order]
            cut = edges(bucket)
            out = []
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                w = who[a:z]
                begins = np.concatenate([[True], w[1:] != w[:-1]])
                hashes = h[a:z].astype(np.uint32) if h.shape[1] == 1 else h[a:z]
                out.append((int(bucket[a]), hashes.tobytes(), who_are[w[begins]].tobytes(), (np.cumsum(begins) - 1).astype(np.uint32).tobytes(), places[a:z].tobytes()))
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["bucket", "hashes", "docs", "who", "places"])

        for b in batches:
            for cut in in_batches(b.column(2), CHUNK_BYTES):
                ids, keys, texts, places = (b.column(i)[cut] for i in range(4))
                words, starts = words_of(texts, memo)
                h, of, at = pick(words, starts, places.to_pylist())
                held.append((h, of + count, at))
                docs.append(np.stack([ids.to_numpy(), keys.to_numpy()], axis=1))
                count += len(ids)
                size += texts.nbytes
                if size >= PACK_BYTES:
                    yield from flush()
                    held, docs, count, size = [], [], 0, 0
        if held:
            yield from flush()
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's hashes meet, and those seen twice return to their documents."""
        for _, hashes, docs, who, places in by_bucket(batches):
            own = [i for i, h in enumerate(hashes) if h is not None]
            for i in set(range(len(hashes))) - set(own):
                yield back(np.frombuffer(docs[i], np.int64).reshape(-1, 2), np.frombuffer(who[i], np.uint32).astype(np.int64), np.frombuffer(places[i], np.uint64), buckets)
            if not own:
                continue
            table, w = joined([(docs[i], who[i]) for i in own])
            p = np.frombuffer(b"".join([places[i] for i in own]), np.uint64)
            h = b"".join([hashes[i] for i in own])
            h = np.frombuffer(h, np.uint32)[:, None] if len(h) == 4 * len(p) else np.frombuffer(h, np.uint64).reshape(-1, 2)
            order = np.argsort(h[:, 0]) if h.shape[1] == 1 else np.lexsort((h[:, 1], h[:, 0]))
            same = (h[order[1:]] == h[order[:-1]]).all(axis=1)
            hit = np.zeros(len(p), bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            # A marked hash was passed through by its own batch; here it answers for the others.
            hit &= (p & ASKED) == 0
            if hit.any():
                yield back(table, w[hit], p[hit], buckets)

    packed = rows.select("doc_id", "key", "text", "places").mapInArrow(pack, "bucket int, hashes binary, docs binary, who binary, places binary")
    return gathered(dealt(packed, buckets).mapInArrow(meet, BACK), buckets, name)


def repeats(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key and places: starts of all windows of rows (doc_id, key, text) whose word sequence also starts elsewhere, in
    the same row or another."""
    if window < PERIOD + 3:
        raise ValueError("a window must be longer than the cover's period")
    rows = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "key", "text")
    buckets = n_buckets(rows, TEXT_A_BUCKET)
    with_none = rows.withColumn("places", F.lit(None).cast("binary"))
    seen = repeated_positions(with_none, lambda *x: anchors(*x, window), buckets, "anchors")
    return repeated_positions(rows.join(seen, ["doc_id", "key"]), lambda *x: candidates(*x, window), buckets, "windows")


def gone_words(places: bytes | None, n: int, window: int = WINDOW) -> np.ndarray:
    """Which of a text's n words lie in a repeated window."""
    at, count, _ = unplace(places)
    return covered(at, count, window, n)


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_words, n_removed and kept of every row: text without the words that a repeated window covers.

    kept is the remaining words joined by one space; text keeps the white space before each of them and is the input
    itself where nothing goes. A null text has no words and stays null, with kept empty. Rows with a null id are left as
    they are and remove nothing. Rows of one id are documents of their own. No rows give no rows; other columns go.
    """
    rows = with_key(docs, id_col, text_col)
    found = repeats(rows, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, removed, kept = [], [], [], []
            for text, places in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = raw.split()
                counts.append(len(words))
                gone = gone_words(places, len(words), window) if places else None
                removed.append(int(gone.sum()) if places else 0)
                if removed[-1]:
                    stay = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    kept.append(b" ".join(stay).decode())
                    texts.append(without(raw, words, gone).decode())
                else:
                    kept.append(b" ".join(words).decode())
                    texts.append(text.as_py())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "text", "n_words", "n_removed", "kept"])

    both = rows.join(found, ["doc_id", "key"], "left").select("doc_id", "text", "places")
    return both.mapInArrow(run, "doc_id bigint, text string, n_words bigint, n_removed bigint, kept string")


def without(raw: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    """raw without the words that go and the white space before each."""
    out, at = [], 0
    for w, g in zip(words, gone.tolist(), strict=True):
        z = raw.index(w, at) + len(w)
        if not g:
            out.append(raw[at:z])
        at = z
    return b"".join([*out, raw[at:]]).lstrip() if gone[0] else b"".join([*out, raw[at:]])


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with the words of repeated windows taken out of text, and n_chars, if there, as long as the text is then.

    Every row stays, also those with a null text or id, as they are.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest_"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    found = repeats(rows)
    kind = rows.schema["rest_"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, places in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid and places else b""
                words = raw.split()
                gone = gone_words(places, len(words))
                texts.append(without(raw, words, gone).decode() if gone.any() else text.as_py())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(3)], ["doc_id", "text", "rest_"])

    done = rows.join(found, ["doc_id", "key"], "left").select("doc_id", "text", "places", "rest_")
    done = done.mapInArrow(run, f"doc_id bigint, text string, rest_ {kind.simpleString()}")
    cells = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text")}
    cells |= {c: F.col("rest_").getField(c) for c in others}
    if "n_chars" in others:
        cells["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[cells[c].alias(c) for c in docs.columns])


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
