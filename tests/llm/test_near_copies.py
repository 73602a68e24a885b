"""The pipeline's near-duplicate stage, with its production parameters, against all pairs."""

import random

import brute

import corpus_pipeline
from culvert.llm import near_copies


def jaccard(a, b):
    return len(a & b) / len(a | b)


def grams(text, n=5):
    w = brute.words(brute.low(text))
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def truth(texts, similar=0.8):
    """Labels by all pairs, and those pairs."""
    sets, label, pairs = [grams(t) for t in texts], list(range(len(texts))), []

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= similar:
                pairs.append((i, j))
                label[find(i)] = find(j)
    return [find(k) for k in range(len(texts))], pairs


def variants(rng, words, far, copies):
    """Texts that differ from one another in a few words: five-word similarity around 0.8, on both sides."""
    out = [" ".join(words)]
    for _ in range(copies):
        own = list(words)
        for at in rng.sample(range(len(own)), far):
            own[at] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_stage_joins_what_all_pairs_join(spark):
    rng = random.Random(5)
    texts = ["", " \n", "one two", "One  TWO", "one three"]
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 120, 200]))]
        texts += variants(rng, words, 1 + k % 5, 3)
    base = [f"g{rng.randrange(5000)}" for _ in range(100)]
    texts += variants(rng, base, 1, 60)  # a group larger than what one key compares
    labels, pairs = truth(texts)
    assert len(pairs) > 500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    least = {}
    for k, label in enumerate(labels):
        least.setdefault(label, k)
    assert kept == set(least.values())


def test_no_pair_below_the_similarity_is_linked(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(100)]
    texts = variants(rng, words, 8, 20)
    labels, pairs = truth(texts)
    assert not pairs
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_copies.one_of_each_similar(docs).count() == len(texts)


def test_a_large_group_of_overlapping_edits_loses_no_link(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(700):  # edits from few places: pairs on both sides of 0.8, many components
        own = list(words)
        for at in rng.sample(range(0, 120, 10), rng.choice([2, 3, 4])):
            own[at] = f"e{at}-{rng.randrange(3)}"
        texts.append(" ".join(own))
    texts = sorted(set(texts))
    _, pairs = truth(texts)
    labels, _ = truth(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for hubs in (1, near_copies.HUBS):
        got = {r["id"]: r["label"] for r in near_copies.labelled(docs, "doc_id", "text", 5, 0.8, hubs).collect()}
        joined = sum(got[i] == got[j] for i, j in pairs)
        assert joined >= 0.999 * len(pairs), (joined, len(pairs))
        apart = {}
        for k, label in enumerate(labels):
            apart.setdefault(got[k], set()).add(label)
        assert all(len(v) == 1 for v in apart.values()), "nothing is joined that all pairs don't join"


def test_edge_cases(spark):
    schema = "doc_id long, text string, key string, uid string, node string, size string"
    rows = [(1, None), (2, ""), (None, " "), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A B C D E F"), (None, None), (5, "other words are here to stay")]
    docs = spark.createDataFrame([(*r, *"knus"[:4]) for r in rows], schema)
    got = near_copies.one_of_each_similar(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, None), (3, "a b c d e f"), (5, "other words are here to stay")]
    assert near_copies.one_of_each_similar(docs.limit(0)).count() == 0


def test_pipeline_stage_is_simhash(spark):
    """The stage drops what op8's components join, and nothing else."""
    import corpus_pipeline
    from culvert.llm import simhash

    base = " ".join(f"w{i}" for i in range(120))
    texts = [base, base, base + " w120", " ".join(f"v{i}" for i in range(90)), base.upper(), None, "", "one two three", "one two four"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = simhash.near_duplicates(docs).collect()
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == {r["component_id"] for r in rows} and 1 not in kept and 6 not in kept and {0, 3, 5, 7} <= kept
