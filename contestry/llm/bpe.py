"""Byte-level BPE by a pair occurrence index.

Texts are cut into pieces by the pattern that such files stand for; a file that cuts otherwise is refused. The distinct pieces of a partition stand one after
another in one array of token ids; an index maps each adjacent pair to its positions, and the active ranks are applied
in ascending order, each at all its positions at once, updating the lists of the pairs beside them. Decoding looks up
each id's bytes.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import give_back, table

#: Fixed: how byte-level BPE files cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text bytes that are encoded together, words or pieces that a worker remembers, and letters of the longest of them.
BATCH_BYTES, REMEMBER, LONGEST = 16 << 20, 200_000, 64
#: Fixed: what either regular expression engine may take for white space.
WHITE = "[\\t-\\r \\x1c-\\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Strings that are one piece.
LETTERS = r"^ ?\p{L}+$"
#: A space that begins a piece.
CUT = re.compile(f" (?!{WHITE}|$)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters by which such files write bytes: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if data["pre_tokenizer"].get("type") != "ByteLevel" or data["pre_tokenizer"].get("add_prefix_space") or not data["pre_tokenizer"].get("use_regex", True) or data.get("normalizer"):
            raise ValueError("the file cuts texts in a way that this encoder doesn't know")
        letters = byte_letters()
        ids = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for t, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.single = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.single[b] = ids[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        key = left * self.size + right
        self.ranks = np.argsort(key)
        self.keys = key[self.ranks]
        self.byte_ranks = self.rank(self.single[:, None], self.single[None, :])
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of merges where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)


def escaped(s: str) -> str:
    """s as a regular expression that both engines read alike."""
    return "".join(c if c.isalnum() or c == " " else f"\\x{{{ord(c):x}}}" for c in s)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def merge_pieces(pieces: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after another, and where each begins (one more entry for the end)."""
    none = v.none
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    ids = v.single[raw]
    n = len(ids)
    # Neighbours by position; -1 at the edges of a piece.
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = -1
    before[ends - lengths] = -1
    alive = np.ones(n, bool)
    rank_at = np.full(n, none, np.int64)
    inner = np.flatnonzero(after >= 0)
    rank_at[inner] = v.byte_ranks[raw[inner], raw[inner + 1]]

    # The index: rank -> arrays of positions whose pair had that rank when they were entered.
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        at = at[rank_at[at] < none]
        if not len(at):
            return
        at = at[np.argsort(rank_at[at], kind="stable")]
        r = rank_at[at]
        edges = np.flatnonzero(np.diff(r)) + 1
        starts = np.concatenate([[0], edges])
        for k, a, b in zip(r[starts].tolist(), starts.tolist(), [*edges.tolist(), len(at)], strict=True):
            if k in index:
                index[k].append(at[a:b])
            else:
                index[k] = [at[a:b]]
                heapq.heappush(active, k)

    enter(inner)
    while active:
        k = heapq.heappop(active)
        lists = index.pop(k)
        at = lists[0] if len(lists) == 1 else distinct(np.concatenate(lists))
        at = at[rank_at[at] == k]
        if not len(at):
            continue
        # In a run of overlapping pairs (aaa) the leftmost goes first: keep every other one of each chain.
        if len(at) > 1 and ids[at[0]] == ids[after[at[0]]]:
            at = np.sort(at)
            linked = np.zeros(len(at), bool)
            linked[1:] = after[at[:-1]] == at[1:]
            place = np.arange(len(at))
            place = place - np.maximum.accumulate(np.where(linked, 0, place))
            at = at[place % 2 == 0]
        gone = after[at]
        nxt = after[gone]
        ids[at] = v.made[k]
        alive[gone] = False
        rank_at[gone] = none
        after[at] = nxt
        has = nxt >= 0
        before[nxt[has]] = at[has]
        rank_at[at] = none
        with_next = at[has]
        prev = before[at]
        with_prev = prev[prev >= 0]
        touched = np.concatenate([with_next, with_prev])
        if len(touched):
            touched = distinct(touched)
            rank_at[touched] = v.rank(ids[touched], ids[after[touched]])
            enter(touched)
    kept = np.cumsum(alive)
    return ids[alive].astype(np.int32), np.concatenate([[0], kept[ends - 1]])


def words_of(text: str, v: Vocabulary) -> list[str]:
    """An uneasy text's parts, each but the first behind a space: a space before other than white space begins a piece.

    A text with a special token that holds a space stays whole.
    """
    return [text] if any(" " in s and s in text for s in v.special) else CUT.split(text)


def words_in(texts: pa.Array, v: Vocabulary) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct strings, the places among them of all texts' strings, and where each text's begin, with the end behind.

    A text's pieces are those of its strings, one string after another. Uneasy texts (a space before other white space, or
    a special token that holds a space) are cut one by one, all others at each space.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    odd = pc.match_substring_regex(texts, "|".join([f" {WHITE}", *[escaped(s) for s in v.special if " " in s]]))
    if pc.any(odd).as_py():
        easy = iter(pc.split_pattern(texts.filter(pc.invert(odd)), " ").to_pylist()) if pc.all(odd).as_py() is False else iter(())
        lists = pa.array([words_of(t, v) if o else next(easy) for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], pa.list_(pa.string()))
    else:
        lists = pc.split_pattern(texts, " ")
    words, starts = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
    first = starts[:-1][starts[1:] > starts[:-1]]
    firsts = words.dictionary.take(words.indices.take(pa.array(first))).dictionary_encode()
    strings = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" "), words.dictionary, ""), firsts.dictionary])
    at = words.indices.to_numpy().astype(np.int64)
    at[first] = firsts.indices.to_numpy() + len(words.dictionary)
    return strings, at, starts


def placed(flat: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of all strings in at, one after another, of strings whose ids begin at starts in flat."""
    begin, size = starts[at], starts[at + 1] - starts[at]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)] if len(at) else flat[:0]


class Memo:
    """Ids of strings seen before: a number for each string, and the ids of all strings one after another."""

    def __init__(self, fixed: list[tuple[str, int]] = ()) -> None:
        self.fixed = list(fixed)
        self.clear()

    def clear(self) -> None:
        """Only the fixed strings stay."""
        self.numbers = {t: i for i, (t, _) in enumerate(self.fixed)}
        self.flat, self.starts = np.array([i for _, i in self.fixed], np.int32), np.arange(len(self.fixed) + 1)
        self.uses = np.zeros(0, np.int64)

    def number(self, strings: list[str]) -> np.ndarray:
        numbers = self.numbers
        return np.fromiter([numbers.setdefault(x, len(numbers)) for x in strings], np.int64, len(strings))

    def new(self) -> list[str]:
        """Strings that have a number but no ids yet."""
        done, total = len(self.starts) - 1, len(self.numbers)
        return list(islice(reversed(self.numbers), total - done))[::-1] if total > done else []

    def add(self, flat: np.ndarray, starts: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, starts[1:] + len(self.flat)])
        self.flat = np.concatenate([self.flat, flat])

    def trim(self, at: np.ndarray) -> None:
        """After a batch that used at: forget long strings, strings used once so far, and the least used beyond the bound."""
        self.uses = np.pad(self.uses, (0, len(self.numbers) - len(self.uses))) + np.bincount(at, minlength=len(self.numbers))
        least = 2
        if np.count_nonzero(self.uses >= least) > REMEMBER:
            least = int(np.partition(self.uses, -REMEMBER)[-REMEMBER]) + 1
        keep = (self.uses >= least) & (np.fromiter(map(len, self.numbers), np.int64, len(self.numbers)) <= LONGEST)
        keep[: len(self.fixed)] = True
        if np.count_nonzero(~keep) > len(keep) // 8:
            stay = np.flatnonzero(keep)
            flat, sizes = self.ids(stay), self.starts[stay + 1] - self.starts[stay]
            self.numbers = {x: i for i, x in enumerate(compress(self.numbers, keep.tolist()))}
            self.flat, self.starts, self.uses = flat, np.concatenate([[0], np.cumsum(sizes)]), self.uses[stay]

    def sizes(self, at: np.ndarray) -> np.ndarray:
        """The number of ids up to and with each."""
        return np.cumsum(self.starts[at + 1] - self.starts[at])

    def ids(self, at: np.ndarray) -> np.ndarray:
        return placed(self.flat, self.starts, at)


class Encoder:
    """Encodes texts in batches; remembers the ids of words and pieces seen before, up to a bound."""

    def __init__(self, path: str) -> None:
        self.v = vocabulary(path)
        self.words, self.parts = Memo(), Memo(sorted(self.v.special.items()))

    def forget(self) -> None:
        """At a task's end, so that a reused worker holds no more than one task's words."""
        self.words.clear()
        self.parts.clear()
        give_back()

    def cut(self, words: list[str]) -> list[list[str]]:
        """The pieces of each word; special tokens stand for themselves."""
        v, strings = self.v, pa.array(words, pa.string())
        whole = pc.match_substring_regex(strings, LETTERS).to_pylist()
        odd = pc.match_substring_regex(strings, "|".join(map(escaped, v.special))).to_pylist() if v.special else [False] * len(words)
        out = [[w] if one else v.pieces.findall(w) for w, one in zip(words, whole, strict=True)]
        for i in compress(range(len(words)), odd):
            out[i] = [p for part in v.cut.split(words[i]) for p in ([part] if part in v.special else v.pieces.findall(part))]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin, with one more entry for the end."""
        strings, at, starts = words_in(texts, self.v)
        at = self.words.number(strings.to_pylist())[at]
        self.learn()
        sizes = np.concatenate([[0], self.words.sizes(at)])
        ids = self.words.ids(at)
        self.words.trim(at)
        return ids, sizes[starts]

    def learn(self) -> None:
        """Ids of the words that have none yet."""
        words, parts = self.words, self.parts
        if not (new := words.new()):
            return
        cuts = self.cut(new)
        at = parts.number([p for c in cuts for p in c])
        if pieces := parts.new():
            parts.add(*merge_pieces([p.encode() for p in pieces], self.v))
        # A word may have no pieces: a text that begins with a space has '' before it.
        sizes = np.concatenate([[0], parts.sizes(at)])
        words.add(parts.ids(at), np.concatenate([[0], sizes[np.cumsum([len(c) for c in cuts])]]))
        parts.trim(at)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker; its vocabulary is read once."""
    return Encoder(path)


def in_batches(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[slice]:
    """Slices of about so many bytes of text each, of one text at least."""
    sizes = np.array([0 if n is None else n for n in pc.binary_length(texts).to_pylist()], np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def list_array(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; a null text has no ids. No rows give no rows; other columns go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            for part in in_batches(b.column(1)):
                ids, starts = own.encode(b.column(1)[part])
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])
        own.forget()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded's doc_id and ids with text: the ids' bytes as UTF-8, bad bytes replaced; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).bytes
        ends = np.cumsum([len(t) for t in tokens])
        tokens = pa.Array.from_buffers(pa.binary(), len(tokens), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(b"".join(tokens))])
        for b in batches:
            lists = b.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            found = tokens.take(lists.flatten())
            edges = np.frombuffer(found.buffers()[1], np.int32)[np.concatenate([[0], np.cumsum(sizes)])].tolist()
            data = found.buffers()[2]
            texts = [data[a:z].to_pybytes().decode("utf-8", "replace") if z > a else "" for a, z in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path()
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
