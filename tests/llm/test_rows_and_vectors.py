"""Exact copies, divergence of sources and vector codes against plain Python, on rows with nulls, ties and repeats."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestry.llm import divergence, exact_dedup, queries, vector_codes

R = np.random.default_rng(3)
SCHEMA = "doc_id bigint, text string, lang string, source string, hash string, row string"


def copies():
    texts = [None, "", " \n\t", "a b", "ab", "a  b ", "A b", "ab ", "x" * 300_000, "x" * 300_000, "É é", "Éé", *(["hot copy"] * 400), "hot  copy", *[f"text {i}" for i in range(60)]]
    rows = [(i, t, "en", "s", "h", "r") for i, t in enumerate(texts)]
    return [*rows, (3, "a b", "en", "s", "h", "r"), (5, "a  b ", "en", "s", "h", "r"), (5, "a  b ", "en", "s", "h", "r"), (None, "a   b ", "en", "s", "h", "r"), (None, "alone", "en", "s", "h", "r"), (None, "alone", "en", "s", "h", "r")]


def squeezed(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[squeezed(r[1])].append(r)
    first = {k: min(v, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for k, v in out.items()}
    return out, first


@pytest.mark.parametrize("bits", [None, 4])
def test_exact_copies(spark, bits):
    """With a hash of one hexadecimal digit most texts collide, and only bytes tell them apart."""
    rows = copies()
    docs = spark.createDataFrame(rows, SCHEMA)
    weak = {"content_hash": lambda t: F.substring(F.md5(t.cast("binary")), 1, 1).cast("binary")} if bits else {}
    got = exact_dedup.exact_copies(docs, **weak).collect()
    all_of, first = groups(rows)
    want = Counter((r[0], first[k][0], len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in all_of.items() for r in v)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(all_of) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_copies(docs.limit(0), **weak).count() == 0
    if not bits:
        left = exact_dedup.drop_copies(docs)
        assert left.columns == docs.columns
        assert Counter(tuple(r) for r in left.collect()) == Counter(first.values())


def shares_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def divergences(rows, least):
    docs, df = defaultdict(Counter), defaultdict(Counter)
    sources = defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = shares_of(text)
        docs[lang, source].update(words)
        df[lang].update(set(words))
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = sorted((w for w, n in df[lang].items() if n >= least), key=lambda w: w.encode())
        v = len(kept)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * v) for w in kept}
        p = {s: share(docs[lang, s]) for s in names}
        q = share(sum((docs[lang, s] for s in names), Counter()))
        for s in names:
            pair = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in names if o != s]
            term = [(p[s][w] - q[w], w) for w in kept if docs[lang, s][w] > 0 and p[s][w] > q[w]]
            for part, found, most in (("pair", pair, None), ("term", term, 50)):
                for i, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, i))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"chunk": 7, "block": 2, "most_held": 50}])
def test_divergence(spark, sizes):
    words = [*[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)], "Étoile", "étoile", "日本", "ß", "İ", "x-y_z", "é́"]
    weights = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(words[i] for i in R.choice(len(words), n, p=weights / weights.sum()))
    rows = [(i, text(int(R.integers(1, 60))), ["en", "de", None][i % 3], ["s1", "S1", "é", "", None][i % 5] if i % 2 else "hot", "h", "r") for i in range(300)]
    rows += [(1, None, "en", "empty", "h", "r"), (1, "", "en", "empty", "h", "r"), (2, "12 34 _", "xx", "digits", "h", "r"), (2, "one two", "xx", "words", "h", "r"), (3, "Tie tie", "tt", "a", "h", "r"), (None, "w " * 5000, "en", "hot", "h", "r")]
    rows += [(4, "even odd", "tt", s, "h", "r") for s in ("a", "b") for _ in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    run = lambda d: sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.divergences(d, **sizes).collect())
    assert run(docs) == divergences(rows, 30)
    assert run(docs.limit(0)) == []


def test_dictionary_of_many_ranges(spark):
    kept = spark.createDataFrame([(lang, s, f"t{i * 7919 % 1000}", i) for i in range(500) for lang in ("de", "en") for s in ("a", "b")], "lang string, source string, term string, n bigint")
    got = divergence.dictionary(kept, 100).collect()
    order = {t: i for i, t in enumerate(sorted({f"t{i * 7919 % 1000}" for i in range(500)}))}
    assert len(got) == 2000 and all(r["id"] == order[r["term"]] for r in got)


def test_shares_are_exact():
    for total, v in ((0, 1), (10, 3), (10**15, 10**6), (2**52, 5), (10**17, 10**7)):
        counts = np.array([0, 1, total // 3, total], np.int64)
        assert divergence.shares(counts, total, v).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * v) for c in counts]


def plain_codes(rows, entries=256, rounds=4):
    good = [(r[0], r[2], [math.floor(1024 * float(x)) for x in r[1]]) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    d = Counter(len(x) for _, _, x in good)
    most = max(d, key=lambda k: (d[k], k))
    good = [(i, label, x + [0] * (-most % 4)) for i, label, x in good if len(x) == most]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(good[0][2]) // 4
    parts = [[x[k * size : (k + 1) * size] for _, _, x in good] for k in range(4)]
    books = [p[:entries] for p in parts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda k: [min(range(len(books[k])), key=lambda e: (far(x, books[k][e]), e)) for x in parts[k]]
    for _ in range(rounds):
        for k in range(4):
            at = nearest(k)
            for e in range(len(books[k])):
                own = [x for x, a in zip(parts[k], at) if a == e]
                if own:
                    books[k] = [*books[k][:e], [sum(c) // len(own) for c in zip(*own)], *books[k][e + 1 :]]
    codes = [nearest(k) for k in range(4)]
    error = [sum(far(parts[k][i], books[k][codes[k][i]]) for k in range(4)) for i in range(len(good))]
    total = Counter()
    for (_, label, _), e in zip(good, error):
        total[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{codes[k][j]:02x}" for k in range(4)), error[j], total[label], digest) for j, (i, label, _) in enumerate(good))


@pytest.mark.parametrize(("n", "d"), [(700, 8), (90, 6), (3, 4)])
def test_vector_codes(spark, n, d):
    """Ties (a coarse grid), copies, clusters, labels that are null, rows that don't count, repeated and null ids."""
    centre = R.normal(size=(6, d))
    rows = [(i, [float(x) for x in np.round((centre[i % 6] + 0.3 * R.normal(size=d)) * 4) / 4], i % 5 if i % 5 else None, "x", "y") for i in range(n)]
    rows += [(n + i, rows[1][1], 1, "x", "y") for i in range(n // 2)] + [(0, rows[2][1], 2, "x", "y"), (None, rows[0][1], 3, "x", "y"), (None, rows[1][1], None, "x", "y")]
    rows += [(-1, None, 1, "x", "y"), (-2, [float("nan")] * d, 1, "x", "y"), (-3, [float("inf")] * d, 1, "x", "y"), (-4, [None] * d, 1, "x", "y"), (-5, [], 1, "x", "y"), (-6, [1.0], 1, "x", "y")]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, code string, x string").repartition(5)
    got = vector_codes.compress(vectors).collect()
    assert Counter(tuple(r) for r in got) == plain_codes(rows)
    assert vector_codes.compress(vectors.limit(0)).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.compress(vectors.withColumn("embedding", F.array(*[F.lit(1e12)] * d)))


def test_filtering_equals_all_distances():
    for d, spread in ((1, 3), (3, 2), (16, 50)):
        points = R.integers(-spread, spread + 1, (3000, d)).astype(np.int64)
        entries = points[R.choice(3000, 200)]
        tree = vector_codes.Tree.unpack(vector_codes.Tree.of(points).pack())
        code, error = vector_codes.codes(tree, entries)
        far = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
        sums, counts = vector_codes.moved(tree, entries)
        want = np.zeros_like(entries)
        np.add.at(want, far.argmin(axis=1), points)
        assert (sums == want).all() and (counts == np.bincount(far.argmin(axis=1), minlength=200)).all()


def test_registered(spark):
    """The registered queries give the columns that they promise."""
    d = "/root/testdata/sf0.001"
    want = {"op11_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op12_source_divergence": "lang source part item value rank", "op13_vector_codes": "vec_id code error label_error codebooks_sha256"}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, d).columns == columns.split()
