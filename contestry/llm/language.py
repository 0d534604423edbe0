"""Language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of all character n-grams of its training texts. The filters share
their hash functions and lie bit-sliced: a slot holds one bit for each language, so the AND of an n-gram's slots is the
set of all languages that contain it, and of those whose filter is wrong about it. A document's n-grams are looked up, each language's hits counted from the
masks and corrected for its filter's false positives, and the highest share decides. The filters grow with the n-grams.
Where they pass what may be sent to every task they are split into shards by a hash of the n-gram: each shard is sent on its
own, answers for its own n-grams of all documents, and the answers are put together by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import fold, table, written

#: Bytes of the n-grams: all these lengths, over lower-case letters with one space between words.
SIZES = (3, 4, 5)
#: Each n-gram sets HASHES slots. There are at least SLOTS_A_GRAM slots for each distinct n-gram of the largest language, and 2**LEAST_BITS.
HASHES, SLOTS_A_GRAM, LEAST_BITS = 3, 4, 16
#: Bytes of filters that go to every task at once; more are split into shards.
MOST_BYTES = 64 << 20
#: Languages of a plane; slots that meet in one row while filters are put together.
A_PLANE, BLOCK = 64, 1 << 14
UNKNOWN = "und"


def letters_only(text: str) -> bytes:
    """Lower case, everything but letters one space, a space at both ends."""
    return (" " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " ").encode() if not text.isascii() else ascii_letters(text)


ASCII = bytes(b if 97 <= b <= 122 else 32 for b in range(256))


def ascii_letters(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(ASCII).split()) + b" "


def ngrams(data: bytes) -> np.ndarray:
    """The n-grams of all SIZES, each a number that also tells its length."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    out, x, length = [], b, 1
    for n in SIZES:
        for length in range(length + 1, n + 1):
            x = (x[:-1] << np.uint64(8)) | b[length - 1 :] if len(x) else x
        out.append(x | np.uint64(n << 8 * n))
    return np.concatenate(out)


def slots(x: np.ndarray, bits: int) -> list[np.ndarray]:
    h = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    mask = np.uint64((1 << bits) - 1)
    a, b = h >> np.uint64(64 - bits), (h >> np.uint64(11)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & mask).astype(np.int64) for i in range(HASHES)]


def shard_of(x: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each n-gram; shards is a power of two."""
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & np.uint64(shards - 1)


@dataclass(frozen=True)
class Filters:
    """One shard's filters. planes: one for each A_PLANE languages, a number of as many bits for each slot; false_rate: of each language's filter."""

    langs: list[str]
    planes: np.ndarray
    false_rate: np.ndarray

    def hits(self, x: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language's filter has."""
        at = slots(x, self.planes.shape[1].bit_length() - 1)
        out = []
        for plane in self.planes:
            mask = plane[at[0]]
            for s in at[1:]:
                mask &= plane[s]
            # Few different masks occur: count them, then each language's bit among them.
            kinds, n = np.unique(mask, return_counts=True)
            bits = (kinds[:, None] >> np.arange(A_PLANE, dtype=np.uint64)) & np.uint64(1)
            out.append((bits * n[:, None].astype(np.uint64)).sum(axis=0))
        return np.concatenate(out)[: len(self.langs)]


def decide(langs: list[str], n: np.ndarray, hits: np.ndarray, false_rate: np.ndarray) -> tuple[str, float]:
    """From each shard's count of n-grams, hits and false rates (a row each): of n, those that a language has are about (hits - n * rate) / (1 - rate)."""
    if not langs or not n.sum():
        return UNKNOWN, 0.0
    real = ((hits - n[:, None] * false_rate) / np.maximum(1 - false_rate, 1e-9)).sum(axis=0) / n.sum()
    real = np.clip(real, 0, 1)
    best = int(np.argmax(real))
    total = real.sum()
    return langs[best], float(real[best] / total) if total > 0 else 1.0 / len(langs)


def ngrams_of(text: str | None) -> np.ndarray:
    """The text's n-grams; none of a text without a letter."""
    data = letters_only(text or "")
    return ngrams(data) if data.strip() else np.zeros(0, np.uint64)


def distinct_ngrams(docs: DataFrame) -> DataFrame:
    """lang and gram of rows (text, lang); each n-gram of a language once for each batch, not for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                x = np.sort(np.concatenate(parts))
                x = x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(x.view(np.int64))], ["lang", "gram"])

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                x = ngrams(letters_only(text.as_py()))
                held.setdefault(lang, []).append(x)
                size += len(x)
                if size > 8_000_000:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return docs.mapInArrow(run, "lang string, gram bigint")


@dataclass(frozen=True)
class Trained:
    """langs, the written n-grams by language, bits of a shard's slots, and how many shards there are."""

    langs: list[str]
    grams: DataFrame
    bits: int
    shards: int

    def filters(self, shard: int) -> Filters:
        """The filters of a shard, MOST_BYTES at most."""
        langs, bits, shards = self.langs, self.bits, self.shards
        planes = np.zeros((max(1, -(-len(langs) // A_PLANE)), 1 << bits), np.uint64)
        shape, number = planes.shape, {k: i for i, k in enumerate(langs)}
        names = ["plane", "block", "slots"]
        row = lambda plane, k, part: pa.RecordBatch.from_arrays([pa.array([plane], pa.int32()), pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names)

        def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(shape, np.uint64)
            for b in batches:
                words = b.column(0).dictionary_encode()
                at, named = words.indices.to_numpy(), words.dictionary.to_pylist()
                x = b.column(1).to_numpy().view(np.uint64)
                here = shard_of(x, shards) == shard
                for i, name in enumerate(named):
                    plane, bit = divmod(number[name], A_PLANE)
                    for s in slots(x[(at == i) & here], bits):
                        own[plane, s] |= np.uint64(1 << bit)
            for plane, x in enumerate(own):
                for k, part in enumerate(x.reshape(-1, BLOCK)):
                    if part.any():
                        yield row(plane, k, part)

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for plane, k, part in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    part = np.frombuffer(part, np.uint64)
                    whole[plane, k] = whole[plane, k] | part if (plane, k) in whole else part
            for (plane, k), part in whole.items():
                yield row(plane, k, part)

        schema = "plane int, block int, slots binary"
        parts = self.grams.coalesce(64).mapInArrow(set_bits, schema).repartition(16, "plane", "block").mapInArrow(join, schema)
        for r in parts.toLocalIterator():  # the shard's filters themselves
            planes[r["plane"], r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["slots"], np.uint64)
        fill = np.array([np.count_nonzero(planes[i // A_PLANE] & np.uint64(1 << i % A_PLANE)) for i in range(len(langs))]) / planes.shape[1]
        return Filters(langs, planes, fill**HASHES)


def sized(largest: int, langs: int, most_bytes: int) -> tuple[int, int]:
    """Bits of a shard's slots, and the number of shards, for the n-grams of the largest language: the false rate stays the same however many there are."""
    bits = max(LEAST_BITS, (SLOTS_A_GRAM * largest).bit_length())
    fit = max(BLOCK.bit_length() - 1, (most_bytes // (8 * max(1, -(-langs // A_PLANE)))).bit_length() - 1)
    return min(bits, fit), 1 << max(0, bits - fit)


def train(docs: DataFrame, most_bytes: int = MOST_BYTES) -> Trained:
    """From rows (text, lang) without nulls: all n-grams of every language. Repeated rows change nothing; no row, no language."""
    grams = written(distinct_ngrams(docs), "lang-ngrams")
    sizes = grams.groupBy("lang").agg(F.approx_count_distinct("gram", 0.02).alias("n")).orderBy("lang").collect()  # a row for each language
    return Trained([r["lang"] for r in sizes], grams, *sized(max([r["n"] for r in sizes], default=1), len(sizes), most_bytes))


def identify(docs: DataFrame, trained: Trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row, repeated ids included. A text that is null or without a letter is UNKNOWN with
    score 0, as is every text where no language was learned; of languages as likely the first by name. Other columns are left out.

    One shard's filters are a broadcast of bounded size. With several, the texts are written with a number for each row, read
    once for each shard, and the rows' answers meet by that number.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    langs = trained.langs
    sc = docs.sparkSession.sparkContext
    if trained.shards == 1:
        own = trained.filters(0)
        shared = sc.broadcast((own.langs, own.planes, own.false_rate))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = Filters(*shared.value)
            for b in batches:
                grams = [ngrams_of(t.as_py()) for t in b.column(1)]
                got = [decide(filters.langs, np.array([len(x)]), filters.hits(x)[None, :], filters.false_rate[None, :]) for x in grams]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

        return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")

    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered-texts")
    parts, rates = [], []
    for k in range(trained.shards):
        own = trained.filters(k)
        rates.append(own.false_rate)
        shared = sc.broadcast((own.langs, own.planes, own.false_rate))
        parts.append(written(rows.select("row", "text").mapInArrow(answers(shared, k, trained.shards), "row bigint, shard int, n bigint, hits array<bigint>"), "lang-hits"))
        shared.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rate = np.array(rates)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for said in b.column(1).to_pylist():  # one for each shard that had an n-gram of the text
                at = [x["shard"] for x in said]
                got.append(decide(langs, np.array([x["n"] for x in said]), np.array([x["hits"] for x in said]), rate[at]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["row", "lang_pred", "score"])

    met = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("shard", "n", "hits"))).alias("said"))  # as many as there are shards
    told = met.mapInArrow(judge, "row bigint, lang_pred string, score double")
    out = rows.select("row", "doc_id").join(told, "row", "left")
    return out.select("doc_id", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))


def answers(shared: Broadcast, shard: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(*shared.value)
        for b in batches:
            got = []
            for row, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = ngrams_of(t.as_py())
                x = x[shard_of(x, shards) == shard]
                if len(x):
                    got.append((row, shard, len(x), filters.hits(x).tolist()))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], kind) for k, kind in enumerate(kinds)], ["row", "shard", "n", "hits"])

    return run


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trained = train(docs.filter((fold("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"))
    return identify(docs, trained).withColumn("held_out", fold("doc_id", 5) == 0).select("doc_id", "held_out", "lang_pred", "score")
