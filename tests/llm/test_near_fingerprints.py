"""The near-duplicate stage takes candidates from SimHash fingerprints as well as from bands."""

from contestry.llm import near_copies, simhash


def test_signatures_hold_the_fingerprint(spark):
    texts = [None, "", "one two", "A b c d e f g h i j k", "a b c d e a b c d e a b c d e"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in near_copies.signatures(rows).collect()}
    assert got == {i: simhash.fingerprint(t, near_copies.SHINGLE) for i, t in enumerate(texts)}


def test_fingerprints_within_the_radius_are_candidates(spark):
    x = 0x0123456789ABCDEF
    fps = {1: x, 2: x, 3: x ^ 0b1111 << 30, 4: x ^ (1 << 63) - 1, 5: x ^ 0x1F << 40}
    reps = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "id bigint, fp bigint")
    assert {tuple(r) for r in near_copies.alike(reps).collect()} == {(1, 2), (1, 3)}


def test_links_need_no_band(spark):
    """Two similar texts whose bands differ (as one pair in many thousands has) are linked by their fingerprints."""
    words = [f"w{i}" for i in range(200)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "x"]), 3: "other words altogether of no use"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    fp = {i: simhash.fingerprint(t, near_copies.SHINGLE) for i, t in texts.items()}
    assert (fp[1] ^ fp[2]).bit_count() <= simhash.RADIUS
    reps = [(i, 100, [i * 1000 + k for k in range(near_copies.BANDS)], f - (1 << 64) if f >> 63 else f) for i, f in fp.items()]
    got = near_copies.links(spark.createDataFrame(reps, "id bigint, n bigint, bands array<bigint>, fp bigint"), rows)
    assert {tuple(r) for r in got.collect()} == {(1, 2)}
