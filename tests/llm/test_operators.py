"""The text operators against brute force on a small table with nulls, empty and long texts, ties and repeats."""

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from contestry.llm import bpe, decontaminate, language, mixing, positions, quality_classifier, quality_rules, simhash, substring, suffix_dedup, token_files

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, at string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = np.random.default_rng(5)
VOCAB = ["the", "of", "Étoile", "runs", "tion", "é", "x1", "and", "IN", "日本", "naïve.", "ends,\n"]


def prose(n):
    return " ".join(VOCAB[i] for i in R.integers(0, len(VOCAB), n))


PASSAGE, OTHER = prose(60), prose(45)
TEXTS = [
    None, "", " \n\t ", "one", "one two three four", PASSAGE, PASSAGE, "Ahead " + PASSAGE + " behind " + prose(30), prose(200) + " " + OTHER, OTHER + " " + PASSAGE,
    OTHER + " mid " + OTHER, "spam " * 300, "a" * 400, prose(6000), "<|endoftext|> it's  'tis\x1c\x85 \x00 \n\n x", PASSAGE.upper(), *[prose(80) for _ in range(6)],
]
DOCS = [(i, t, "en" if i % 2 else None, "s", len(t or ""), 0.5, "z") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_bpe_is_the_library(docs, none):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    tk = Tokenizer.from_file(path)
    got = by_id(bpe.decode(bpe.encode(docs, path), path))
    for i, t, *_ in DOCS:
        want = tk.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want
        assert got[i]["text"] == tk.decode(want, skip_special_tokens=False) == (t or "")
    assert bpe.encode(none, path).count() == 0


def split(found):
    ids, starts = found
    return [ids[a:z].tolist() for a, z in zip(starts, starts[1:])]


@pytest.mark.parametrize("texts", [[" hello world"], [" hello", "hello", " hello"], [" "], [None, "", " it\n", " a b"], ["a  b c", "x y", "\u2003 z", "p \x85q r", "<|endoftext|> a<|endoftext|>", "  "]])
def test_bpe_spaces(texts):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    tk, own = Tokenizer.from_file(path), bpe.Encoder(path)
    want = [tk.encode(t or "", add_special_tokens=False).ids for t in texts]
    column = pa.array(texts, pa.string())
    for _ in range(2):  # with words that are new, then with remembered ones
        assert split(own.encode(column)) == want
    own.forget()
    assert split(own.encode(column)) == want
    assert split(token_files.all_ids(column, bpe.vocabulary(path), token_files.compiled_merges(path))) == want


def test_bpe_refuses_other_cuts(tmp_path):
    with open(bpe.default_path(), encoding="utf-8") as f:
        data = json.load(f)
    data["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "t.json").write_text(json.dumps(data))
    with pytest.raises(ValueError, match="cuts texts"):
        bpe.Vocabulary(str(tmp_path / "t.json"))


def test_bpe_first_text_of_a_partition_begins_with_a_space(spark):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    tk = Tokenizer.from_file(path)
    texts = [" hello world", "hello world", " hello"]
    got = by_id(bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), path))
    assert [got[i]["ids"] for i in range(3)] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 5000])
def test_rans_round_trip(n):
    ids = R.zipf(1.3, n).clip(max=5000)
    t = token_files.Table(token_files.frequencies(Counter(ids.tolist())))
    blocks = [b for b in (ids, ids[: n // 3]) if len(b)]
    if blocks:
        done = token_files.code(blocks, t)
        for a, b in zip(token_files.uncode([len(b) for b in blocks], [s for s, _ in done], [w for _, w in done], t), blocks, strict=True):
            assert (a == b).all()


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    tk = Tokenizer.from_file(path)
    token_files.write_files(docs, f"file://{tmp_path}/a", path)
    # Another session, that has nothing but the folder, decodes the files.
    got, start = by_id(token_files.read_files(spark.newSession(), f"file://{tmp_path}/a")), 0
    for i, text, *_ in DOCS:
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert zlib.crc32(got[i]["ids"]) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_files.write_files(none, f"file://{tmp_path}/b", path)
    assert token_files.read_files(spark, f"file://{tmp_path}/b").count() == 0


def test_token_files_order_repeated_and_null_ids(spark, tmp_path):
    rows = [(7, "b b"), (7, "a"), (None, "x"), (None, "y y"), (7, "a"), (3, None)]
    for k, n in enumerate((1, 4)):
        token_files.write_files(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n), f"file://{tmp_path}/{k}", bpe.default_path())
    one, four = (sorted((r["start"], r["doc_id"], bytes(r["ids"])) for r in token_files.read_files(spark, f"file://{tmp_path}/{k}").collect()) for k in (0, 1))
    assert one == four
    assert [d for _, d, _ in one] == [None, None, 3, 7, 7, 7]


def lowest(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs, none):
    prints = []
    for t in TEXTS:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    want = lowest(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    got = by_id(simhash.near_duplicates(docs))
    assert [got[i]["fp"] % (1 << 64) for i in range(len(TEXTS))] == prints
    assert [got[i]["component_id"] for i in range(len(TEXTS))] == want
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(want)
    assert simhash.near_duplicates(none).count() == 0
    twice = simhash.keep_one(docs.union(docs.filter("doc_id = 3"))).filter("doc_id = 3")
    assert twice.count() == 1 and twice.columns == docs.columns


@pytest.mark.parametrize("blocks,segment", [(5, 64), (6, 2048), (7, 100)])
def test_all_links_whatever_the_blocks(spark, monkeypatch, blocks, segment):
    monkeypatch.setattr(simhash, "choose_blocks", lambda n, r: blocks)
    monkeypatch.setattr(simhash, "SEGMENT", segment)
    base = int(R.integers(0, 2**62))
    f = sorted({base ^ sum(1 << b for b in set(R.integers(0, 62, R.integers(0, 9)).tolist())) for _ in range(300)})
    want = lowest(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    got = {r["id"]: r["component"] for r in simhash.components(simhash.links(spark.createDataFrame(list(enumerate(f)), "id bigint, fp bigint"), len(f))).collect()}
    assert [got.get(i, i) for i in range(len(f))] == want


def test_cover_is_complete():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


@pytest.mark.parametrize("pack", [4 << 20, 500])
def test_substring(docs, none, monkeypatch, pack):
    monkeypatch.setattr(substring, "PACK_BYTES", pack)
    words = [WORD.findall(t or "") for t in TEXTS]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    got = by_id(substring.dedup(docs))
    for d, w in enumerate(words):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert (got[d]["n_words"], got[d]["n_removed"]) == (len(w), len(gone))
        assert got[d]["kept"] == " ".join(x for j, x in enumerate(w) if j not in gone)
        if not gone:
            assert got[d]["text"] == TEXTS[d]
    clean = substring.cleaned(docs)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS)
    assert substring.dedup(none).count() == 0


@pytest.mark.parametrize("pack", [4 << 20, 500])
def test_suffix(docs, none, monkeypatch, pack):
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", pack)
    monkeypatch.setattr(substring, "PACK_BYTES", pack)
    first = {}
    got = by_id(suffix_dedup.dedup(docs))
    for d, t in enumerate(TEXTS):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i : i + 50], d) < d:
                gone[i : i + 50] = True
        assert (got[d]["n_bytes"], got[d]["n_removed"]) == (len(raw), int(gone.sum()))
        assert got[d]["n_spans"] == int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        assert got[d]["kept"] == np.frombuffer(raw, np.uint8)[~gone].tobytes()
    assert suffix_dedup.dedup(none).count() == 0


def brute_kept(rows):
    first, out = {}, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            first.setdefault(raw[i : i + 50], d)
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < d:
                gone[i : i + 50] = True
        out.append((d, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    return sorted(out)


def test_suffix_spreads_a_hot_minimiser(spark, monkeypatch):
    passage = bytes(R.integers(97, 123, 120, np.uint8)).decode()
    rows = [(i, "".join(chr(c) for c in R.integers(97, 123, 60)) + passage + "".join(chr(c) for c in R.integers(97, 123, 60))) for i in range(300)]
    rows += [(1000 + d, t) for d, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_kept(rows)
    for hot_runs in (20, 1 << 30):
        monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot_runs)
        assert sorted((r["doc_id"], bytes(r["kept"])) for r in suffix_dedup.dedup(df).collect()) == want


def test_rows_of_one_id_keep_their_own_positions(spark):
    p, q = prose(80), " ".join(f"w{i}" for i in range(90))
    rows = [(1, p), (2, p), (2, q), (2, q), (None, p)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, bytes(r["kept"])) for r in suffix_dedup.dedup(df).collect())
    assert got == sorted([(1, p.encode()), (2, b""), (2, q.encode()), (2, q.encode()), (0, p.encode())])
    left = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.dedup(df).collect())
    n = len(p.split())
    assert left == sorted([(1, n), (2, n), (2, 90), (2, 90), (0, 0)])


def test_work_does_not_grow_with_buckets(spark, docs, monkeypatch):
    """A million buckets, nearly all empty, in a few partitions."""
    monkeypatch.setattr(positions, "MOST_PARTS", 4)
    rows = positions.with_key(docs).filter("text IS NOT NULL").select("doc_id", "key", "text")
    hot = np.zeros(1 << 16, bool)

    def found(n):
        out = {}
        for r in suffix_dedup.folded(rows, hot, 16, n, 50).collect():
            at, size, asked = positions.unplace(bytes(r["places"]))
            out[r["doc_id"]] = sorted(zip(at[~asked].tolist(), size[~asked].tolist(), strict=True))
        return {k: v for k, v in out.items() if v}

    assert found(1) == found(1_000_000)


def edits(a, b):
    row = [0] * (len(b) + 1)  # the part of b may begin and end anywhere
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontaminate(spark, docs, none):
    item = "a passage of some length that a benchmark asks about, with a few words more than forty"
    near = item.replace("some", "sone").replace("few", "fw")
    far = " ".join(reversed(item.split()))
    texts = [f"before {item.upper()} after", f"x {near} y", far, None, "", prose(50), item[:40]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.leaks(rows, bench).collect()}
    n = decontaminate.normal(item)
    want = {(i, 7): e for i, t in enumerate(texts) if (e := edits(n, decontaminate.normal(t))) <= decontaminate.budget(len(n))}
    assert got == want and set(want) == {(0, 7), (1, 7)}
    # Short passages are found as whole words; a q-gram that many passages share is worked off in halves.
    few = spark.createDataFrame([(0, "they came, SHORT of breath"), (1, "shorter shorts"), (2, "Short!"), (3, "ten bytes.")], "doc_id bigint, text string")
    shorts = spark.createDataFrame([(9, "short"), (10, "ten bytes"), (11, "?")], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"], r["begin"], r["end"]) for r in decontaminate.leaks(few, shorts).collect()} == {(0, 9, 10, 15), (2, 9, 0, 5), (3, 10, 0, 9)}
    assert [r["doc_id"] for r in decontaminate.drop_leaks(few, shorts).orderBy("doc_id").collect()] == [0, 1]
    many = bench.unionByName(spark.createDataFrame([(20 + i, item + f" and {i}") for i in range(9)], "item_id bigint, text string"))
    alike = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.leaks(rows, many, most_hits=30).collect()}
    assert {k: e for k, e in alike.items() if k[1] == 7} == want
    every = {(d, i): e for d, t in enumerate(texts) for i, x in [(7, item), *[(20 + i, item + f" and {i}") for i in range(9)]] if (e := edits(decontaminate.normal(x), decontaminate.normal(t))) <= decontaminate.budget(len(decontaminate.normal(x)))}
    assert alike == every
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.leaks(rows, many, block_bytes=100, most_hits=30).collect()} == every
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_decontaminate_of_repetitive_texts(spark, docs):
    """More matches than a task holds at once, met on workers: passages that share a template, and one that repeats itself."""
    template = "which of the following statements about the history of the town is certainly false when "
    bench = spark.createDataFrame([*[(i, f"{template}case {i * 7919} holds?") for i in range(1500)], (5000, "ha ha " * 20), (5001, "ha hb " * 9)], "item_id bigint, text string")
    texts = [template * 60, template * 60 + f"case {7919 * 700} holds", "ha ha " * 20_000, "ha hi " * 300 + "ha ha " * 17 + "he", "oh", None]
    rows = spark.createDataFrame([*enumerate(texts), (None, texts[1]), (1, texts[1])], "doc_id bigint, text string").withColumn("item_id", F.lit(-1)).withColumn("edits", F.lit("x"))
    found = decontaminate.leaks(rows, bench, most_hits=20_000).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert {(1, 700), (2, 5000), (None, 700)} <= got and sum(r["doc_id"] == 1 and r["item_id"] == 700 for r in found) == 2
    few = [(i, decontaminate.normal(f"{template}case {i * 7919} holds?")) for i in (0, 699, 700, 701)] + [(5000, decontaminate.normal("ha ha " * 20)), (5001, decontaminate.normal("ha hb " * 9))]
    for d, t in enumerate(texts):
        if d not in (0, 2):  # long texts
            assert {i for i, x in few if edits(x, decontaminate.normal(t)) <= decontaminate.budget(len(x))} == {i for k, i in got if k == d and i in dict(few)}
    whole = decontaminate.Index.of(few)
    for most in (300, 5000):
        part = decontaminate.Index.of(few, most)
        for t in [texts[0][:2000], *texts[3:]]:
            assert sorted(decontaminate.find(decontaminate.normal(t), part)) == sorted(decontaminate.find(decontaminate.normal(t), whole))
    kept = decontaminate.drop_leaks(rows, bench)
    assert kept.columns == rows.columns
    # Rows with a null id stay; any other that holds a passage goes.
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted([-1, *({*range(len(texts))} - {d for d, _ in got})])


def test_fewest_edits_of_a_part():
    for _ in range(60):
        a, b = (bytes(R.choice(list(b"abc "), n).tolist()) for n in (int(R.integers(1, 30)), int(R.integers(0, 60))))
        letters = {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in set(a)}
        assert decontaminate.fewest(letters, len(a), b) == edits(a, b)


def test_statistics_and_rules(spark, docs, none):
    got = by_id(quality_rules.with_stats(docs, windows=True))
    for d, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert got[d]["n_words"] == len(w) and got[d]["n_repeat_words"] == len(again)
        assert got[d]["word_chars"] == sum(map(len, w)) and got[d]["n_dup_lines"] == len(lines) - len(set(lines))
        assert got[d]["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
    labels = spark.createDataFrame([(i, int(i != 11), 0) for i in range(len(TEXTS))], "doc_id bigint, quality int, toxic int")
    judged, _ = quality_rules.judge(docs, labels)
    assert judged.count() == len(TEXTS)
    for some in (labels.limit(0), labels.filter("quality = 1")):
        judged, rules = quality_rules.judge(none, some)
        assert judged.count() == 0 and rules == []


def test_rules_find_the_threshold(spark):
    rows = spark.range(3000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") >= 2400).alias("bad"), (F.col("id") % 3 != 0).alias("grow"))
    rules = quality_rules.learn(rows, ["a", "b"])
    kept = rows.filter(quality_rules.verdict(rules) == 0)
    assert kept.filter("bad").count() + (2400 - kept.filter("not bad").count()) < 150


def test_classifier(spark, docs, none):
    n = 600
    texts = [(i, prose(60) if i % 2 else " ".join(w + "$$$" for w in prose(60).split()), "en", "s", 1, 0.0, "") for i in range(n)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id bigint, quality int, toxic int")
    got = quality_classifier.score_quality(spark.createDataFrame(texts, SCHEMA), labels)
    held = got.filter("held_out").withColumn("ok", F.col("predicted") == F.col("doc_id") % 2)
    assert held.filter("ok").count() >= 0.98 * held.count() > 0
    assert got.filter("score < 0 or score > 1 or isnan(score)").count() == 0
    plain = quality_classifier.score_quality(docs, labels.limit(0))
    assert {r["score"] for r in plain.collect()} == {0.5} and quality_classifier.score_quality(none, labels).count() == 0
    assert quality_classifier.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_language(spark, none):
    own = {"aa": ["kala", "maki", "toru", "nima"], "bb": ["strend", "wicht", "grolf", "pless"]}
    rows = [(i, " ".join(R.choice(own["aa" if i % 2 else "bb"], 30)), "aa" if i % 2 else "bb") for i in range(200)]
    filters = language.train(spark.createDataFrame(rows[:150], "doc_id bigint, text string, lang string").select("text", "lang"))
    tests = spark.createDataFrame([*[r[:2] for r in rows[150:]], (900, None), (901, "123 ... "), (902, "")], "doc_id bigint, text string")
    got = by_id(language.identify(tests, filters))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[150:])
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    empty = language.train(none.select("text", "lang"))
    assert language.identify(tests, empty).count() == 53


@pytest.mark.parametrize("pack, text", [(8 << 20, 16 << 20), (3000, 5000)])
def test_mixing(spark, docs, none, monkeypatch, pack, text):
    monkeypatch.setattr(mixing, "PACK_BYTES", pack)
    monkeypatch.setattr(mixing, "TEXT_A_BUCKET", text)
    monkeypatch.setattr(mixing, "TEXT_A_WORD_BUCKET", text)
    held = docs.withColumn("held_out", F.col("doc_id") % 7 == 3)
    got = by_id(mixing.score(held))
    words = [(t or "").encode().lower().split() for t in TEXTS]
    c = Counter(w for d, ws in enumerate(words) if d % 7 != 3 for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    for d, ws in enumerate(words):
        assert got[d]["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, None]))
        assert got[d]["n_known"] == sum(c[w] > 0 for w in [*ws, None])
        assert (got[d]["n_tokens"], got[d]["train_tokens"], got[d]["held_out"]) == (len(ws) + 1, n, d % 7 == 3)
    # The model by brute force: all texts in one bucket, each n-gram's worth looked up.
    data = [b" ".join(w) + b"\0" for w in words]
    keys = [mixing.events(x, np.array([len(x)])) for x in data]
    kinds = np.unique(np.concatenate(keys))
    seen = Counter(np.concatenate([k for d, k in enumerate(keys) if d % 7 != 3]).tolist())
    n = np.array([seen[k] for k in kinds.tolist()])
    short = Counter()
    for k, x in zip(mixing.masked(kinds, mixing.SHORT).tolist(), n.tolist(), strict=True):
        short[k] += x
    model = mixing.untrained(np.array(sorted(short), np.uint64), np.array([short[k] for k in sorted(short)]))
    if pack > 8 << 19:  # one bucket, as here
        model = mixing.trained(model, mixing.learn(model, [(kinds, n)]))
        worth = dict(zip(kinds.tolist(), model.log2p(kinds, n).tolist(), strict=True))
        for d, k in enumerate(keys):
            assert got[d]["score"] == pytest.approx(sum(worth[x] for x in k.tolist()) * np.log10(2), abs=len(k) * np.log10(2) / (2 * mixing.STEP) + 1e-9)
    # The bytes' probabilities in one context sum to one.
    key = mixing.masked(np.arange(256, dtype=np.uint64) | np.uint64(int.from_bytes(b"t snur", "big") << 8), mixing.ORDER)
    times = np.array([seen[k] for k in key.tolist()])
    model.short = mixing.masked(key, mixing.SHORT)
    model.short_levels = mixing.levels(model.short, np.array([short[k] for k in model.short.tolist()]))
    assert np.exp2(model.log2p(key, times)).sum() == pytest.approx(1)
    assert sum(got[d]["score"] for d in got) > sum(-len(b" ".join(w)) * 8 * np.log10(2) for w in words)
    assert all(got[d]["bits_per_byte"] == pytest.approx(-got[d]["score"] / np.log10(2) / len(data[d])) for d in got)


def test_mixing_without_training(spark, docs, none):
    flat = by_id(mixing.score(docs.withColumn("held_out", F.lit(True))))
    assert flat[3]["n_known"] == 0 and np.isfinite(flat[3]["score"]) and np.isfinite(flat[3]["base_score"])
    assert flat[3]["train_tokens"] == 0
    assert mixing.score(none.withColumn("held_out", F.lit(True))).count() == 0
    again = docs.filter("doc_id = 5").unionByName(docs).unionByName(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = mixing.score(again.withColumn("held_out", F.col("doc_id") % 2 == 0).fillna(False, ["held_out"])).collect()
    assert len(rows) == len(TEXTS) + 2
    assert len({r["score"] for r in rows if r["doc_id"] in (5, None)}) == 1


def test_masks_hold_every_language_of_an_ngram(spark):
    words = {"l%02d" % i: [f"{chr(97 + i % 26)}{w}{chr(97 + i // 26)}" for w in ("abc", "xyzz", "éa", "mnop")] for i in range(70)}
    rows = [(" ".join(R.choice(w, 30)), lang) for lang, w in words.items() for _ in range(3)] + [("shared words everywhere", lang) for lang in words]
    filters = language.train(spark.createDataFrame(rows, "text string, lang string")).filters(0)
    assert filters.langs == sorted(words) and filters.planes.shape[0] == 2
    own = {}
    for text, lang in rows:
        own.setdefault(lang, set()).update(language.ngrams(language.letters_only(text)).tolist())
    for i, lang in enumerate(filters.langs):  # every n-gram's mask has its language's bit
        x = np.array(sorted(own[lang]), np.uint64)
        assert filters.hits(x)[i] == len(x)
    shared = language.ngrams(language.letters_only("shared words everywhere"))
    assert (filters.hits(shared) == len(shared)).all()
    for text, lang in rows[:30]:
        x = language.ngrams(language.letters_only(text))
        true = np.array([sum(g in own[k] for g in x.tolist()) for k in filters.langs])
        assert (filters.hits(x) >= true).all()
        told = language.decide(filters.langs, np.array([len(x)]), filters.hits(x)[None, :], filters.false_rate[None, :])
        assert told[0] == filters.langs[int(np.argmax(true))] == lang


def test_shards_answer_as_one_filter(spark, docs):
    """Filters that are split by n-gram give what one filter gives, repeated and null ids and very long texts included."""
    own = {"aa": ["kala", "maki", "toru", "nima"], "bb": ["strend", "wicht", "grolf", "pless"], "cc": ["øre", "ærø", "ål"]}
    rows = [(i % 150, " ".join(R.choice(own[k], 3000 if i == 7 else 30)), k, "x", 1.0) for i, k in enumerate(list(own) * 60)]
    learned = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string, score double")
    asked = learned.unionByName(spark.createDataFrame([(None, "kala maki", "x", "y", 0.0), (1, None, None, None, None), (1, " 12 ", "x", "y", 0.0), (2, "ål", "x", "y", 0.0)], learned.schema))
    texts = learned.select("text", "lang")
    whole, split = language.train(texts), language.train(texts, most_bytes=1 << 17)
    assert whole.shards == 1 and (split.bits, split.shards) == (14, 4)
    told = [Counter((r["doc_id"], r["lang_pred"]) for r in language.identify(asked, t).collect()) for t in (whole, split)]
    assert told[0] == told[1] and sum(told[0].values()) == asked.count()
    assert {lang for _, lang in told[0]} == {"aa", "bb", "cc", "und"}
    assert language.sized(10_000_000, 4, 64 << 20) == (23, 8) and language.sized(50_000, 4, 64 << 20) == (18, 1)


def test_many_ngrams_keep_the_false_rate():
    """Filters of a hundredth of a shard's size, and as many n-grams: the rate of false hits follows from slots a gram, not from a size."""
    rates = []
    for n in (20_000, 400_000):
        bits, shards = language.sized(n, 4, 1 << 18)
        x = R.integers(1, 1 << 40, n, dtype=np.uint64)
        rate = []
        for k in range(min(shards, 4)):
            plane = np.zeros(1 << bits, np.uint64)
            for s in language.slots(x[language.shard_of(x, shards) == k], bits):
                plane[s] |= np.uint64(1)
            rate.append((np.count_nonzero(plane) / len(plane)) ** language.HASHES)
        rates.append(np.mean(rate))
    assert max(rates) < 0.2 and abs(rates[0] - rates[1]) < 0.1

