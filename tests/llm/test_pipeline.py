"""The pipeline's near-duplicate stage, and the whole pipeline, against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from contestry.llm import near_copies

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, at string"
R = np.random.default_rng(11)
WORDS = [f"w{i}" for i in range(500)]


def edited(words, n):
    words = list(words)
    for i in R.choice(len(words), n, replace=False).tolist():
        words[i] = f"new{R.integers(1 << 30)}"
    return words


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def lowest(texts):
    """The smallest place of each text's component, by all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def corpus():
    texts = [None, "", " \n", "one two", "ONE two", "one two three"]
    for _ in range(40):
        base = R.choice(WORDS, 300).tolist()
        chain = edited(base, 5)
        texts += [" ".join(w) for w in (base, edited(base, 2), chain, edited(chain, 5), edited(base, 9), edited(base, 40), base[:150])]
    return texts


@pytest.mark.parametrize("segment", [2048, 2])
def test_stage_links_all_of_0_8(spark, monkeypatch, segment):
    monkeypatch.setattr(near_copies, "SEGMENT", segment)
    texts = corpus()
    docs = spark.createDataFrame([*[(i, t, "en", "s", 1, 0.5, "z") for i, t in enumerate(texts)], (None, "x", "en", "s", 1, 0.5, "z")], SCHEMA)
    want = lowest(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted({-1, *want})
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_whole_pipeline(spark):
    """run() on the smallest tables: each stage's rows against plain Python on what the stage before kept, and the last stage's are run()'s."""
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from contestry.llm import decontaminate
    from contestry.llm.common import written

    d = "/root/testdata/sf0.001"
    steps, docs = {}, spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, d), f"test-{name}")
        steps[name] = {r["doc_id"]: r for r in docs.collect()}
    every = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    good = [i for i in every if labels.get(i) == 1]
    assert len(set(good) & set(steps["quality"])) > 0.97 * len(good) and set(steps["quality"]) <= set(every)

    before = sorted(steps["quality"])
    first = lowest([every[i]["text"] for i in before])
    assert sorted(steps["near_duplicates"]) == sorted({before[k] for k in first})

    texts = {i: (r["text"] or "").split() for i, r in steps["near_duplicates"].items()}
    seen = {}
    for i, w in texts.items():
        for k in range(len(w) - 34):
            seen.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    gone = {(i, k + j) for at in seen.values() if len(at) > 1 for i, k in at for j in range(35)}
    for i, w in texts.items():
        assert steps["substrings"][i]["text"].split() == [x for k, x in enumerate(w) if (i, k) not in gone]

    passages = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    holds = {i for i, r in steps["substrings"].items() if any(len(p) >= decontaminate.MIN_EDITED and p in decontaminate.normal(r["text"]) for p in passages)}
    dropped = set(steps["substrings"]) - set(steps["decontamination"])
    assert holds <= dropped and all(any(decontaminate.similar(decontaminate.normal(steps["substrings"][i]["text"]), decontaminate.Index.of([(0, p)])) or p in decontaminate.normal(steps["substrings"][i]["text"]) for p in passages) for i in dropped)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_padding()
    library.no_truncation()
    for i, r in steps["tokens"].items():
        text = steps["decontamination"][i]["text"] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(r["ids"] or []) == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, d).collect()}
    assert whole == {i: (r["n_tokens"], r["decoded_sha256"]) for i, r in steps["tokens"].items()}
