"""Vector code compression: product codes by filtering Lloyd rounds.

Components become integers. Each task cuts its vectors into trees: for every part position a kd-tree over the parts of some
thousand vectors, whose nodes keep their bounding box, count and sums. Trees are built once and written. In a round every
node, from the root down, carries the entries that may be nearest to one of its points: an entry goes as soon as another is
at least as near over the whole box, and a node with one entry left is assigned as a whole, by its sums. Only sums and counts
of entries leave a task. All arithmetic is in whole numbers, so ties and rounding are the same however rows are spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import join_hot, table, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors of a tree, points of a leaf, and numbers that a step over nodes and entries holds.
TREE, LEAF, AT_ONCE = 4096, 16, 1 << 21


@dataclass
class Tree:
    """A kd-tree of points (in the order of its leaves): node k covers points[begin[k]:end[k]]; left[k] is 0 for a leaf, right is left + 1."""

    order: np.ndarray
    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @staticmethod
    def of(points: np.ndarray) -> Tree:
        """Cut at the median of the widest side; points that are all equal are not cut."""
        order = np.arange(len(points))
        begin, end, left, low, high = [0], [len(points)], [0], [], []
        k = 0
        while k < len(begin):
            own = order[begin[k] : end[k]]
            x = points[own]
            low.append(x.min(axis=0))
            high.append(x.max(axis=0))
            side = high[k] - low[k]
            widest = int(side.argmax()) if len(side) else 0
            if len(own) > LEAF and len(side) and side[widest] > 0:
                half = len(own) // 2
                order[begin[k] : end[k]] = own[np.argpartition(x[:, widest], half)]
                left[k] = len(begin)
                begin += [begin[k], begin[k] + half]
                end += [begin[k] + half, end[k]]
                left += [0, 0]
            k += 1
        begin, end, left = (np.array(x, np.int64) for x in (begin, end, left))
        points = points[order]
        total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
        return Tree(order, points, begin, end, left, np.array(low), np.array(high), total[end] - total[begin])

    def pack(self) -> bytes:
        n, d = self.points.shape
        head = np.array([n, d, len(self.begin)], np.int64)
        return b"".join(x.astype(np.int64).tobytes() for x in (head, self.order, self.points, self.begin, self.end, self.left, self.low, self.high, self.sums))

    @staticmethod
    def unpack(data: bytes) -> Tree:
        x = np.frombuffer(data, np.int64)
        n, d, k = x[:3].tolist()
        ends = np.cumsum([3, n, n * d, k, k, k, k * d, k * d, k * d])
        order, points, begin, end, left, low, high, sums = (x[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        return Tree(order, points.reshape(n, d), begin, end, left, low.reshape(k, d), high.reshape(k, d), sums.reshape(k, d))


def nearest(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The place of each point's nearest entry, the first of several."""
    out = np.empty(len(points), np.int64)
    step = max(1, AT_ONCE // max(1, entries.size))
    for a in range(0, len(points), step):
        gap = points[a : a + step, None, :] - entries[None, :, :]
        out[a : a + step] = (gap * gap).sum(axis=2).argmin(axis=1)
    return out


def assign(tree: Tree, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """The points' entries as (whole nodes, their entries, None) and (points, their entries, points) - the latter for leaves that several entries share.

    Entry z is given up for the entry c, nearest to the box's middle, if no point of the box is nearer to z, and none as near
    if z comes first: |x - z|^2 - |x - c|^2 is linear in x, so its least value over the box is at a corner.
    """
    norms = (entries * entries).sum(axis=1)
    frontier, alive = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    step = max(1, AT_ONCE // max(1, entries.size))
    place = np.arange(len(entries))
    while len(frontier):
        later, masks = [], []
        for a in range(0, len(frontier), step):
            nodes, mask = frontier[a : a + step], alive[a : a + step].copy()
            twice = tree.low[nodes] + tree.high[nodes]
            gap = 2 * entries[None, :, :] - twice[:, None, :]
            far = (gap * gap).sum(axis=2)
            far[~mask] = np.iinfo(np.int64).max
            best = far.argmin(axis=1)
            to = entries[None, :, :] - entries[best][:, None, :]
            corner = np.where(to > 0, tree.high[nodes][:, None, :], tree.low[nodes][:, None, :])
            least = norms[None, :] - norms[best][:, None] - 2 * (corner * to).sum(axis=2)
            mask &= (least < 0) | ((least == 0) & (place[None, :] < best[:, None]))
            mask[np.arange(len(nodes)), best] = True
            one = mask.sum(axis=1) == 1
            if one.any():
                yield nodes[one], best[one], None
            leaf = ~one & (tree.left[nodes] == 0)
            for node, own in zip(nodes[leaf].tolist(), mask[leaf], strict=True):
                rest = np.flatnonzero(own)
                at = np.arange(tree.begin[node], tree.end[node])
                yield at, rest[nearest(tree.points[at], entries[rest])], at
            inner = ~one & ~leaf
            children = tree.left[nodes[inner]]
            later += [children, children + 1]
            masks += [mask[inner], mask[inner]]
        frontier = np.concatenate(later) if later else np.zeros(0, np.int64)
        alive = np.concatenate(masks) if masks else alive[:0]


def moved(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the points by entry; whole nodes give their own."""
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    for at, to, points in assign(tree, entries):
        np.add.at(sums, to, tree.sums[at] if points is None else tree.points[at])
        np.add.at(counts, to, tree.end[at] - tree.begin[at] if points is None else 1)
    return sums, counts


def codes(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every point, in the order they were given."""
    to = np.empty(len(tree.points), np.int64)
    for at, entry, points in assign(tree, entries):
        if points is None:
            for a, z, e in zip(tree.begin[at].tolist(), tree.end[at].tolist(), entry.tolist(), strict=True):
                to[a:z] = e
        else:
            to[at] = entry
    gap = tree.points - entries[to]
    out, error = np.empty_like(to), np.empty_like(to)
    out[tree.order], error[tree.order] = to, (gap * gap).sum(axis=1)
    return out, error


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label and the components as whole numbers, of the rows that count; written."""
    x = F.col(vec_col)
    fine = x.isNotNull() & F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(fine).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), x.cast("array<double>").alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c)))).alias("most"))
    common = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    d = common["d"] if common else 0
    # |floor(SCALE * x)| and every difference, squared and summed, stay below 2**62.
    if common and SCALE * common["most"] + 1 >= (2**60 / max(1, d)) ** 0.5:
        raise ValueError(f"components up to {common['most']:g}: squared distances of {d} such components don't fit 64 bits")
    ints = F.transform("x", lambda c: F.floor(c * SCALE))
    padded = F.concat(ints, F.array_repeat(F.lit(0).cast("bigint"), -d % PARTS))
    return written(rows.filter(F.size("x") == d).select("vec_id", "label", padded.alias("x")), "whole-vectors")


def build(rows: DataFrame) -> DataFrame:
    """Trees of the rows: ids, labels and a packed tree for each part position; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("x").chunk(0)
            x = lists.flatten().to_numpy().astype(np.int64).reshape(len(lists), -1)
            packed = [Tree.of(np.ascontiguousarray(part)).pack() for part in np.hsplit(x, PARTS)]
            ids, labels = (t.column(k).combine_chunks() for k in ("vec_id", "label"))
            yield pa.RecordBatch.from_arrays([pa.array([v.to_pylist()], pa.list_(v.type)) for v in (ids, labels)] + [pa.array([packed], pa.list_(pa.binary()))], ["vec_id", "label", "trees"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= TREE:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    kinds = dict(rows.dtypes)
    return written(rows.mapInArrow(run, f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, trees array<binary>"), "vector-trees")


def lloyd(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: books (part, entry, component) replaced by the floors of their parts' means; what no part is nearest to stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            for packed in b.column(0):
                for k, data in enumerate(packed):
                    s, c = moved(Tree.unpack(data.as_py()), books[k])
                    sums[k] += s
                    counts[k] += c
        part, entry = np.nonzero(counts)
        both = np.concatenate([counts[part, entry][:, None], sums[part, entry]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(list(both), pa.list_(pa.int64()))], ["part", "entry", "v"])

    partial = trees.select("trees").mapInArrow(run, "part int, entry int, v array<bigint>")
    summed = partial.select("part", "entry", F.posexplode("v").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("v").alias("v"))
    # As many numbers as the codebooks have: PARTS * ENTRIES * (components of a part + 1).
    got = summed.toPandas()
    new = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    new[got["part"], got["entry"], got["at"]] = got["v"]
    n = new[:, :, :1]
    return np.where(n > 0, new[:, :, 1:] // np.maximum(n, 1), books)


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that counts.

    A component x becomes floor(SCALE * x). A vector that is null or holds a null or non-finite component is dropped, as is one
    whose number of components isn't the most frequent (the larger of two as frequent); if that isn't a multiple of PARTS,
    zeros follow. Codebooks begin as the parts of the ENTRIES smallest vec_ids (of all, if there are fewer; null ids after all
    others, repeated ids in the order of their components) and take ROUNDS rounds; ties go to the lower entry. Rows that repeat
    an id each have a code. label_error is the error summed over a label, nulls together. Other columns are left out; an
    empty table gives an empty one. Components so large that squared distances pass 64 bits raise a ValueError.
    """
    rows = whole_numbers(vectors, id_col, vec_col, label_col)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(ENTRIES).collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2) if first else np.zeros((PARTS, 0, 0), np.int64)
    trees = build(rows)
    for _ in range(ROUNDS if len(first) else 0):
        books = lloyd(trees, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, labels, packed in zip(*b.columns, strict=True):
                got = [codes(Tree.unpack(data.as_py()), books[k]) for k, data in enumerate(packed)]
                text = pa.array(["".join(f"{c:02x}" for c in code) for code in np.stack([c for c, _ in got], axis=1).tolist()])
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, text, pa.array(sum(e for _, e in got))], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    coded = written(trees.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), "vector-codes")
    # A null label is a group like any other: it is told by a flag, so that the join's keys are never null.
    zero = F.coalesce("label", F.lit(0).cast(kinds["label"]) if kinds["label"] != "string" else F.lit(""))
    keyed = coded.select("vec_id", "code", "error", F.col("label").isNull().alias("no_label"), zero.alias("label_"))
    labels = keyed.groupBy("no_label", "label_").agg(F.sum("error").alias("label_error"), F.count("*").alias("n_label"))
    return join_hot(keyed, written(labels, "label-errors"), ["no_label", "label_"], "n_label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def rounds_in_sql() -> str:
    """The same rounds written out, every part against every entry."""
    names = [f"""
c{i + 1} AS MATERIALIZED (SELECT k, entry, coalesce(new.x, old.x) AS x FROM c{i} old LEFT JOIN (
  SELECT k, entry, list(m ORDER BY pos) AS x FROM (SELECT k, entry, pos, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM (SELECT k, entry, unnest(x)::HUGEINT AS v, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY k, entry, pos) GROUP BY k, entry) new USING (k, entry)),
a{i + 1} AS MATERIALIZED ({nearest_in_sql(i + 1)})""" for i in range(ROUNDS)]
    return ",".join(names)


def nearest_in_sql(i: int) -> str:
    apart = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    return f"SELECT k, r, any_value(x) AS x, min(far) AS error, arg_min(entry, far * {ENTRIES} + entry) AS entry FROM (SELECT p.k, p.r, p.x, c.entry, {apart} AS far FROM p JOIN c{i} c USING (k)) GROUP BY k, r"


OP13_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, k, x[k * (len(x) // {PARTS}) + 1 : (k + 1) * (len(x) // {PARTS})] AS x FROM v, (SELECT unnest(range({PARTS})) AS k)),
c0 AS MATERIALIZED (SELECT k, r - 1 AS entry, x FROM p WHERE r <= {ENTRIES}),
a0 AS MATERIALIZED ({nearest_in_sql(0)}),{rounds_in_sql()},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY k) AS code, sum(error)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
flat AS (SELECT k, entry, unnest(x) AS m, generate_subscripts(x, 1) AS pos FROM c{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(m::BIGINT::VARCHAR, ',' ORDER BY k, entry, pos)) FROM flat) AS codebooks_sha256 FROM coded JOIN v USING (r)
"""
