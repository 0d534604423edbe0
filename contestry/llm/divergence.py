"""Source divergence audit over an integer dictionary of kept terms.

Tasks count the terms of their documents by language and source, and send the counts in blobs, one for each bucket of terms;
a bucket knows all counts of its terms and lets go of those that too few documents have. The terms that are kept are dealt
by ranges of (language, term) and stand in UTF-8 order there: a term's id is its place among its language's sorted terms,
found by searchsorted in its range's array. Ids are cut into chunks; bincount makes a dense vector of each source's counts
in a chunk, blocks of vectors are compared, and sums and the best terms of each chunk are put together by Spark. All
numbers are integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.llm.common import give_back, table, written

#: Documents of a language that a kept term is in at least, what is added to every count, and ranks of the terms that are returned.
LEAST_DOCS, ADDED, TERMS = 30, 5, 50
SCALE = 1_000_000_000
#: Counts that a task holds before it sends them; ids of a chunk; sources of a block (the mean); kept counts of a range.
MOST_HELD, CHUNK, BLOCK, RANGE = 600_000, 8192, 64, 500_000

#: Terms are runs of A-Z, a-z and bytes from 0x80 on; every other byte separates, and A-Z become a-z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

WORDS = pa.dictionary(pa.int32(), pa.string())
COUNTS = pa.schema([("lang", WORDS), ("source", WORDS), ("term", pa.large_binary()), ("docs", pa.int64()), ("n", pa.int64())])
COMPRESSED = pa.ipc.IpcWriteOptions(compression="lz4")


def packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=COMPRESSED) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def count_terms(buckets: int, most: int):
    """For mapInArrow over lang, source and text (bytes): blobs with documents and occurrences of each term by lang and source, a row for each
    bucket. A term of no bytes, with no counts, tells that a source is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = list(held)
            of = np.repeat(np.arange(len(keys), dtype=np.int32), [len(held[k]) for k in keys])
            terms = [w for k in keys for w in held[k]]
            docs, n = np.array([x for k in keys for x in held[k].values()], np.int64).T
            bucket = np.fromiter(map(zlib.crc32, terms), np.uint32, len(terms)) % buckets
            order = np.argsort(bucket, kind="stable")
            names = [pa.DictionaryArray.from_arrays(pa.array(of), pa.array([k[i] for k in keys], pa.string())) for i in (0, 1)]
            t = pa.Table.from_arrays([*names, pa.array(terms, pa.large_binary()), pa.array(docs), pa.array(n)], schema=COUNTS).take(pa.array(order))
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([packed(t.slice(ends[b], ends[b + 1] - ends[b]))])], ["bucket", "blob"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = held.setdefault((lang, source), {b"": [0, 0]})
                before = len(own)
                once: dict[bytes, int] = {}
                for w in text.as_py().translate(LETTERS).split():
                    once[w] = once.get(w, 0) + 1
                for w, n in once.items():
                    if w in own:
                        both = own[w]
                        both[0] += 1
                        both[1] += n
                    else:
                        own[w] = [1, n]
                size += len(own) - before
                if size > most:
                    yield from flush()
                    held, size = {}, 0
        if held:
            yield from flush()
        held = {}
        give_back()

    return run


def kept_counts(least: int):
    """For mapInArrow over all blobs of some buckets: occurrences by lang, source and term of the terms that are kept; and a term of no bytes for each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = pa.ipc.open_stream(blob.as_buffer()).read_all()
                held.setdefault(bucket, []).append(pa.table({k: t.column(k).cast(pa.string()) if k in ("lang", "source") else t.column(k) for k in t.column_names}))
        while held:
            t = pa.concat_tables(held.popitem()[1])
            docs = t.group_by(["lang", "term"]).aggregate([("docs", "sum")])
            kept = docs.filter(pc.or_(pc.greater_equal(docs.column("docs_sum"), least), pc.equal(pc.binary_length(docs.column("term")), 0))).select(["lang", "term"])
            t = t.join(kept, ["lang", "term"], join_type="left semi").group_by(["lang", "source", "term"]).aggregate([("n", "sum")])
            out = pa.table({"lang": t.column("lang"), "source": t.column("source"), "term": t.column("term").cast(pa.binary()).cast(pa.string()), "n": t.column("n_sum")})
            yield from out.to_batches(max_chunksize=10_000)
        give_back()

    return run


def encoded(first: dict[tuple[int, str], int]):
    """For applyInArrow by part and lang: ids in place of terms. first: the ids that stand before a part's, by part and lang."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        words = rows.column("term").combine_chunks().cast(pa.binary()).dictionary_encode()
        seen = np.array(words.dictionary.to_pylist(), object)
        terms = np.sort(seen)  # bytes: UTF-8 order
        ids = np.searchsorted(terms, seen)[words.indices.to_numpy()] + first[key[0].as_py(), key[1].as_py()]
        return pa.table({"lang": rows.column("lang"), "source": rows.column("source"), "term": rows.column("term"), "id": pa.array(ids, pa.int64()), "n": rows.column("n")})

    return run


def shares(counts: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * v)) of each count, as exact integers."""
    whole = total + ADDED * v
    if whole >= 1 << 52:  # Python's integers
        return np.array([1 + SCALE * (int(c) + ADDED) // whole for c in counts], np.int64)
    # Long division, three decimal digits at a time: no product passes 2**62.
    out, rest = np.divmod(counts.astype(np.int64) + ADDED, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def compare(key: tuple, rows: pa.Table, chunk: int) -> pa.Table:
    """For a chunk and two blocks of sources (or one twice): each pair's part of the sum, and each source's best terms.

    Rows of kind 0 are the sources, of kind 1 their counts, of kind 2 the chunk's terms with the language's counts.
    """
    here, there = key[2].as_py(), key[3].as_py()
    kind = rows.column("kind").to_numpy()
    v, base = rows.column("v")[0].as_py(), key[1].as_py() * chunk
    width = max(0, min(chunk, v - base))
    sources, counts, words = (rows.filter(pa.array(kind == k)) for k in range(3))
    names, blocks, totals = (sources.column(k).to_pylist() for k in ("source", "block", "total"))
    place = {name: i for i, name in enumerate(names)}
    at = np.array([place[x] for x in counts.column("source").to_pylist()], np.int64) * width + counts.column("id").to_numpy() - base
    n = counts.column("n").to_numpy()
    # bincount adds in float64, exact below 2**53; the lower and upper bits of counts are added on their own.
    dense = sum(np.bincount(at, weights=half, minlength=len(names) * width).astype(np.int64) << shift for half, shift in ((n & 0x7FFFFFFF, 0), (n >> 31, 31))).reshape(len(names), width)
    p = np.array([shares(c, total, v) for c, total in zip(dense, totals, strict=True)], np.int64).reshape(len(names), width) if width else dense
    out: list[tuple[str, str, str, int]] = []
    blocks = np.array(blocks, np.int64)
    left, right = np.flatnonzero(blocks == here), np.flatnonzero(blocks == there)
    for i in left.tolist():
        sums = np.abs(p[right] - p[i]).sum(axis=1).tolist()
        for j, f in zip(right.tolist(), sums, strict=True):
            if i != j:
                out.append((names[i], "pair", names[j], f))
                if here != there:
                    out.append((names[j], "pair", names[i], f))
    if here == there and width:
        whole, terms = np.zeros(width, np.int64), [""] * width
        for i, x, t in zip((words.column("id").to_numpy() - base).tolist(), words.column("n").to_pylist(), words.column("term").to_pylist(), strict=True):
            whole[i], terms[i] = x, t
        q = shares(whole, words.column("total")[0].as_py(), v)
        for i in left.tolist():
            more = np.where(dense[i] > 0, p[i] - q, 0)
            ids = np.flatnonzero(more > 0)
            for t in ids[np.argsort(-more[ids], kind="stable")[:TERMS]].tolist():  # equal values keep the order of their ids
                out.append((names[i], "term", terms[t], int(more[t])))
    columns = list(zip(*out, strict=True)) or [()] * 4
    n = len(out)
    return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), **{k: pa.array(columns[i], pa.string()) for i, k in enumerate(("source", "part", "item"))}, "value": pa.array(columns[3], pa.int64())})


def dictionary(kept: DataFrame, most: int = RANGE) -> DataFrame:
    """kept (lang, source, term, n) with id, the term's place among its language's terms in UTF-8 order; written. Ranges hold about most rows."""
    ranges = kept.repartitionByRange(1 + kept.count() // most, "lang", "term").select(F.spark_partition_id().alias("part"), "*")
    ranges = written(ranges, "term-ranges")
    # A row for each range and language in it: at most as many as there are ranges and languages together.
    sizes = ranges.groupBy("part", "lang").agg(F.countDistinct("term").alias("n")).orderBy("part").collect()
    first: dict[tuple[int, str], int] = {}
    sums: dict[str, int] = {}
    for r in sizes:
        first[r["part"], r["lang"]] = sums.get(r["lang"], 0)
        sums[r["lang"]] = first[r["part"], r["lang"]] + r["n"]
    return written(ranges.groupBy("part", "lang").applyInArrow(encoded(first), "lang string, source string, term string, id bigint, n bigint"), "term-ids")


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, chunk: int = CHUNK, block: int = BLOCK, most_held: int = MOST_HELD) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source of a language is from its others, and its most typical terms.

    A language keeps the terms that at least least_docs of its documents have; a source's share of a term is
    1 + floor(SCALE * (count + ADDED) / (N + ADDED * V)). Part `pair` has a row for each other source of the language with
    the sum of the shares' differences over all kept terms, part `term` the TERMS terms by which a source exceeds its
    language most, ties in UTF-8 order. Null text, language or source counts as ''; sources without a term, and languages
    without a kept term, have their pairs, those with sum 0. Repeated rows count each; other columns are left out. An empty
    table gives no rows. Tasks hold chunk ids of about 2 * block sources, and most_held counts, at a time.
    """
    spark = docs.sparkSession
    column = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = docs.select(column(lang_col).alias("lang"), column(source_col).alias("source"), column(text_col).cast("binary").alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blobs = rows.mapInArrow(count_terms(buckets, most_held), "bucket int, blob binary").repartition(buckets, "bucket")
    every = written(blobs.mapInArrow(kept_counts(least_docs), "lang string, source string, term string, n bigint"), "term-counts")
    ids = dictionary(every.filter("term <> ''"))

    terms = ids.groupBy("lang", "id", "term").agg(F.sum("n").alias("n"))
    langs = every.select("lang", "source").distinct().groupBy("lang").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    langs = langs.join(terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v")), "lang", "left").na.fill(0, ["lang_total", "v"])
    totals = every.groupBy("lang", "source").agg(F.sum("n").alias("total"))  # the term of no bytes adds nothing
    groups = written(totals.join(langs, "lang").withColumn("block", F.pmod(F.hash("source"), F.col("blocks"))), "divergence-groups")

    # A source meets each block of its language's sources once: blocks, not rows, are paired. A language without terms has one empty chunk.
    last = F.greatest(F.floor((F.col("v") - 1) / F.lit(chunk)), F.lit(0))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    of_id = F.floor(F.col("id") / F.lit(chunk)).alias("chunk")
    null = lambda kind: F.lit(None).cast(kind)
    met = (F.least("block", "other").alias("here"), F.greatest("block", "other").alias("there"))
    present = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).select("*", other)
    present = present.select("lang", "chunk", *met, F.lit(0).alias("kind"), "source", "block", "total", "v", null("bigint").alias("id"), null("bigint").alias("n"), null("string").alias("term"))
    counted = ids.join(groups, ["lang", "source"]).select("*", of_id, other)
    counted = counted.select("lang", "chunk", *met, F.lit(1).alias("kind"), "source", "block", "total", "v", "id", "n", null("string").alias("term"))
    words = terms.join(groups.select("lang", "blocks", "lang_total", "v").distinct(), "lang").select("*", of_id, other)
    words = words.select("lang", "chunk", F.col("other").alias("here"), F.col("other").alias("there"), F.lit(2).alias("kind"), null("string").alias("source"), null("int").alias("block"), F.col("lang_total").alias("total"), "v", "id", "n", "term")
    found = present.unionByName(counted).unionByName(words).groupBy("lang", "chunk", "here", "there").applyInArrow(lambda key, rows: compare(key, rows, chunk), "lang string, source string, part string, item string, value bigint")
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term is in one chunk, a pair in all
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= TERMS))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
lang_c AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
lang_total AS (SELECT lang, sum(n) AS total FROM lang_c GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(total.total, 0) + 5 * v.v) AS p
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN total ON total.lang = g.lang AND total.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.n + 5)) // (t.total + 5 * v.v) AS q FROM lang_c l JOIN lang_total t USING (lang) JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
