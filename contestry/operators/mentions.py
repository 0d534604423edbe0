"""Names that texts mention, by Aho-Corasick automata over blocks of names: a text is read once for a block, however many names that has."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.functions.scalar import alnum_name
from contestry.sources.staged import staged

#: Letters of the names whose automaton every task builds.
BLOCK_LETTERS = 4_000_000


def blocks(people: DataFrame, letters: int) -> Iterator[list[tuple[int, str, str]]]:
    """(id, name, key) in order of id, in blocks of `letters` or less, one at a time; a longer name has its own."""
    block, size = [], 0
    for r in people.select("id", "name", alnum_name(F.col("name")).alias("key")).filter("id IS NOT NULL AND key <> ''").orderBy("id", "name").toLocalIterator():
        if size and size + len(r["key"]) > letters:
            yield block
            block, size = [], 0
        block.append((r["id"], r["name"], r["key"]))
        size += len(r["key"])
    if block:
        yield block


def automaton(names: list[tuple[int, str, str]]) -> ahocorasick.Automaton:
    """Its values are the places of the names that have a key."""
    of: dict[str, list[int]] = {}
    for i, (_, _, key) in enumerate(names):
        of.setdefault(key, []).append(i)
    out = ahocorasick.Automaton()
    for key, places in of.items():
        out.add_word(key, places)
    out.make_automaton()
    return out


def mentions(texts: DataFrame, people: DataFrame, most: int = 4, letters: int = BLOCK_LETTERS) -> DataFrame:
    """id and names: the first `most` people, by id and name, whose key is part of the text's key, within words too; texts that mention nobody have no row.

    Keys are lower-case letters and digits with single spaces between; a name without any finds nothing. People are a set that
    is asked for in blocks: each block's automaton reads all texts, which have unique ids, and keeps a text's first `most`.
    """
    keyed = texts.select("id", alnum_name(F.col("text")).alias("key")).filter("key <> ''")
    kind = texts.schema["id"].dataType.simpleString()
    sc = texts.sparkSession.sparkContext
    found, each = [], blocks(people, letters)
    names = next(each, None)
    while names:
        following = next(each, None)
        shared = sc.broadcast(names)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            read = automaton(own)
            for b in batches:
                ids, who, said = [], [], []
                for at, key in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    for i in sorted({i for _, places in read.iter(key) for i in places})[:most]:
                        ids.append(at.as_py())
                        who.append(own[i][0])
                        said.append(own[i][1])
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(who, pa.int64()), pa.array(said, pa.string())], ["id", "who", "name"])

        part = keyed.mapInArrow(run, f"id {kind}, who bigint, name string")
        found.append(staged(part, "mentions") if following or found else part)
        names = following
    out = texts.sparkSession.createDataFrame([], f"id {kind}, who bigint, name string")
    for part in found:
        out = part if len(found) == 1 else out.unionByName(part)
    first = F.slice(F.sort_array(F.collect_list(F.struct("who", "name"))), 1, most)  # `most` for each block at most
    return out.groupBy("id").agg(F.transform(first, lambda x: x["name"]).alias("names"))
