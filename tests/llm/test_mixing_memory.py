"""The mixing model's tables and steps stay small in memory, whatever the size of a task's input."""

import glob
import tracemalloc

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from contestry.llm import common, mixing


def test_row_groups_of_large_rows(spark):
    rows = spark.range(0, 40, 1, 1).select("id", F.randstr(4_000_000, 7).alias("data"))
    before = set(glob.glob(f"{common.shared_dir(spark).removeprefix('file://')}/large-*"))
    assert common.written(rows, "large", large=True).count() == 40
    new = set(glob.glob(f"{common.shared_dir(spark).removeprefix('file://')}/large-*")) - before
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{new.pop()}/*.parquet")]
    assert max(m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)) < 32 << 20


def test_a_pack_is_counted_in_little_memory():
    r = np.random.default_rng(3)
    data = r.integers(97, 123, 4 << 20).astype(np.uint8)  # nearly every n-gram differs
    data[r.integers(0, len(data), len(data) // 40)] = 0
    data[-1] = 0
    sizes = np.diff(np.flatnonzero(data == 0), prepend=-1)
    held = r.random(len(sizes)) < 0.1
    tracemalloc.start()
    got = {}
    size = 0
    for rows in mixing.pack_counts(data.tobytes(), sizes, held, 50):
        assert not got.keys() & {b for b, _, _ in rows}
        got.update({b: (len(k) // 8, int(mixing.unplanes(n, np.uint32).sum())) for b, k, n in rows})
        size += sum(len(k) // 8 for _, k, _ in rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(data), peak  # bytes for each byte of the pack
    key = mixing.events(data.tobytes(), sizes)
    assert size == len(np.unique(key)) and sum(n for _, n in got.values()) == sizes[~held].sum()
