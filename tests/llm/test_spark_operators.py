"""Every operator over small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from culvert.llm import bpe, catalog, html_render, kneser_ney, line_rules, mixing, simhash, substrings, suffix_tree, threshold_topk, token_counts
from culvert.plans.compare import check

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, uid long, key string, n_words long, label string, __id string, copy_no string, fps string, starts string, id string, n_tokens string"
RNG = random.Random(7)
PROSE = [" ".join(RNG.choices("the of and to in a is that for it was on are as with his they at be this".split(), k=n)) for n in (3, 12, 40, 90, 150, 400)]


def rows():
    texts = [
        (1, PROSE[4]), (2, PROSE[4] + " more"), (3, PROSE[5]), (4, ""), (5, None), (6, "   \n\t "), (7, PROSE[3] + "\n" + PROSE[3]), (8, PROSE[5] + " Ünd " + PROSE[4]),
        (9, "one"), (10, "two words"), (11, "ONE"), (None, PROSE[2] + " " + PROSE[3]), (None, None), (12, "x" * 5000 + " " + "word " * 3000), (3, PROSE[5]), (3, PROSE[1]),
        *[(20 + k, f"Head line {k % 3}\n{PROSE[1]}\ncommon last line here") for k in range(30)],
    ]
    return [(i, t, "en" if k % 3 else None, "a" if k % 4 else None, 1, 2, "k", 3, "l", "i", "c", "f", "s", "d", "t") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs():
    return [r[:2] for r in rows()]


def test_mixing(docs, none):
    got = mixing.mix(docs)
    assert got.columns == [*[c for c in docs.columns if c != "copy_no"], "copy_no"]
    counts = Counter((r["doc_id"], r["source"], r["text"]) for r in got.collect())
    repeats = Counter((r[0], r[3], r[1]) for r in rows())
    assert all(n % repeats[k] == 0 for k, n in counts.items()), "rows that repeat get the same count each"
    many = mixing.mix(docs, {"a": 1.0, "nowhere": 2.0}, epochs=60.0).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()
    assert [r["source"] for r in many] == ["a"]
    whole = sum(len(t or "") + 1 for _, t in pairs())
    assert abs(many[0]["n"] / (60 * whole) - 1) < 0.2, "weights of sources without rows don't count"
    assert mixing.mix(none).count() == 0 and mixing.mix(docs, {}).count() == 0
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_suffix_tree_base_and_distribution(docs, none):
    got = suffix_tree.score_documents(docs).collect()
    assert len(got) == len(rows())
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in pairs() if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t in pairs())
    assert Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    assert suffix_tree.score_documents(none).count() == 0
    assert suffix_tree.score_documents(docs.filter("doc_id IN (2, 6)")).count() == 2


def test_suffix_tree_is_a_distribution_and_beats_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tree = suffix_tree.grow(docs, suffix_tree.word_counts(docs))
    import numpy as np

    symbols = np.arange(tree.end + 1)
    for state in {0, 1, len(tree.back_off) - 1}:
        path = [state]
        while path[-1]:
            path.append(int(tree.parent[path[-1]]))
        levels = np.stack([np.full(len(symbols), s) for s in path[::-1]])
        assert abs((10.0 ** tree.log_p(levels, symbols)).sum() - 1) < 1e-9
    scored = suffix_tree.score_documents(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert scored[0] > scored[1]


def test_suffix_tree_names_every_word_that_its_shares_allow(spark):
    """210,000 words found ten times each: more than any fixed alphabet holds."""
    docs = spark.range(70_000).selectExpr("repeat(concat('x', id, ' y', id, ' z', id, ' '), 10) AS text")
    tree = suffix_tree.grow(docs, suffix_tree.word_counts(docs), depth=1)
    ids, _, _ = tree.sequences([b"x5 Y69999 z123 unheard"])
    assert tree.end == 210_001 and (ids[1:4] > 0).all() and ids[4] == 0
    assert (tree.first >= 0).sum() >= 210_000


def test_suffix_tree_reads_the_texts_of_its_levels_once(spark, monkeypatch):
    """The levels count stored ids; a text is split into words once for all of them."""
    docs = spark.range(50).selectExpr("repeat(concat('x y z ', id % 5, ' '), 20) AS text")
    stored, plain = {}, suffix_tree.materialise

    def materialise(df, purpose):
        stored[purpose] = plain(df, purpose)
        return stored[purpose]

    monkeypatch.setattr(suffix_tree, "materialise", materialise)
    tree = suffix_tree.grow(docs, suffix_tree.word_counts(docs))
    ids = [suffix_tree.unplanes(r["ids"], "uint32") for r in stored["ids"].collect()]
    assert sum(map(len, ids)) == 50 * 82 and len(tree.next) == 2 and sum((x == tree.begin).sum() for x in ids) == 50


def test_line_rules(docs, none):
    got = line_rules.line_rules(docs).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r["id"], r)
    assert by[5]["n_words"] == 0 and by[5]["base_failed"] and not by[5]["kept"]
    assert by[7]["n_dup_lines"] == 1 and by[7]["n_repeat_words"] >= 180 and by[7]["base_failed"]
    common = [r for r in got if r["id"] is not None and r["id"] >= 20 and r["host"] == "a"]
    assert len(common) > line_rules.LINE_DOCS and all(r["lost_words"] == 19 and not r["kept"] for r in common)
    assert line_rules.line_rules(none).count() == 0


def test_common_lines_leave_texts(spark):
    """A line in more than 20 of a host's documents goes from the texts of that host alone, in any case and with any digits."""
    body = " ".join(f"w{k}" for k in range(30))
    made = [(i, f"{body} {i}\n\nCopyright  {i % 10} BY us\nlast line of {i} x{'y' * i}", "a" if i < 25 else None, i, "c") for i in range(45)]
    made += [(50, "copyright 7 by us\n" * 3 + "one two", "a", 0, "c"), (None, body + "\ncopyright 0 by us", "a", 0, "c"), (51, None, "a", 0, "c")] + made[:1]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string, cut int, uid string")
    got = line_rules.without_common_lines(docs)
    assert got.columns == docs.columns
    rows = sorted(got.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    want = [made[0], *made[:45]]
    assert [r["doc_id"] for r in rows] == [*(r[0] for r in want), None]
    for r, (i, text, host, _, _) in zip(rows, want, strict=False):
        lines = text.split("\n")
        assert r["text"] == ("\n".join(x for x in lines if "BY" not in x) if host else text) and (r["cut"], r["uid"]) == (i, "c")
    assert rows[-1]["text"] == body
    lost = {r["id"]: r["lost_words"] for r in line_rules.line_rules(docs).collect()}
    assert lost[3] == 4 and lost[30] == 0 and lost[50] == 12
    assert line_rules.without_common_lines(docs.limit(0)).count() == 0


def test_line_limit_is_bounded(spark):
    """In a host of 6,000 documents 2 % would be 120: a line of 101 is above the limit all the same, one of 100 is not."""
    words = F.concat_ws(" ", *[F.concat(F.lit(f"{chr(97 + k)}x"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")) for k in range(12)])
    text = F.concat_ws("\n", words, F.when(F.col("id") < 101, "common foot line"), F.when(F.col("id") >= 5900, "rarer foot line"))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("h").alias("source"))
    lost = line_rules.line_rules(docs).filter("lost_words > 0")
    assert lost.agg(F.count("*"), F.max("id"), F.max("lost_words")).first()[:] == (101, 100, 3)


def test_topk(spark):
    rng = random.Random(3)
    vectors = [(k, [rng.uniform(-1, 1) for _ in range(8)]) for k in range(260)]
    vectors += [(300, None), (350, [1.0, None] + [0.0] * 6), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (None, [0.5] * 8), (500, [0.0] * 8), (550, []), (7, vectors[7][1])]
    vectors += [(600 + k, vectors[5][1]) for k in range(20)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, key string, v int")
    ok = {i: [math.floor(256 * float(x)) for x in r["embedding"]] for r in df.collect() if (i := r["vec_id"]) is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])}
    want = {}
    for q in (i for i in ok if i % 50 == 0):
        best = sorted(((-sum(a * b for a, b in zip(ok[q], ok[i], strict=True)), i) for i in ok if i != q))[:5]
        want.update({(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)})
    for block in (16, 64, threshold_topk.BLOCK):
        old, threshold_topk.BLOCK = threshold_topk.BLOCK, block
        got = threshold_topk.search_every(df).collect()
        threshold_topk.BLOCK = old
        assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)
    assert threshold_topk.search_every(df.limit(0)).count() == 0
    assert threshold_topk.search_every(df.filter("vec_id = 50")).count() == 0


def test_threshold_stops_before_the_end():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (4000, 3))
    x[:5] = 200
    q, v, s = threshold_topk.search_block(np.arange(4000), x, np.array([9000]), np.array([[1, 1, 1]]), 5)
    assert v.tolist() == [0, 1, 2, 3, 4] and s.tolist() == [600] * 5


def test_token_counts(spark, docs, none):
    import sentencepiece
    from public_tokenizers import path

    library = sentencepiece.SentencePieceProcessor(model_file=path(token_counts.MODEL))
    got = token_counts.count_tokens(docs, limit=100).collect()
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t in pairs())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert all(len(library.encode((r["text"] or "")[: r["fit_chars"]])) <= 100 for r in got)
    assert token_counts.count_tokens(none).count() == 0
    stored = token_counts.with_prefix_counts(docs.filter("doc_id IN (2, 9, 4)"))
    for r in stored.withColumn("fit", token_counts.chars_within(F.col("prefix_tokens"), 7)).collect():
        sizes = [len(library.encode(r["text"][: k + 1])) for k in range(len(r["text"]))]
        assert r["prefix_tokens"] == sizes and r["fit"] == max((k for k, n in enumerate(sizes, 1) if n <= 7), default=0)


def test_bpe(docs, none):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path(bpe.MODEL))
    got = bpe.encode_decode(docs, keep_ids=True)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == Counter((i, len(library.encode(t or "").ids)) for i, t in pairs())
    for r in bpe.decode_ids(got).collect():
        assert r["decoded"] == (r["text"] or "") and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encode_decode(none).count() == 0


def test_html(spark):
    df = spark.createDataFrame([(1, "<p>a", "x", 1), (1, "<p>a", "x", 1), (2, None, None, 2), (None, "", "y", 3), (3, "<b>" + "word " * 50_000, "z", 4)], "page_id long, html string, text string, at int")
    got = html_render.extract_text(df)
    assert got.columns == ["page_id", "at", "text"]
    assert Counter((r["page_id"], r["text"]) for r in got.collect()) == Counter([(1, "a"), (1, "a"), (2, ""), (None, ""), (3, ("word " * 50_000).strip())])
    assert html_render.extract_text(df.limit(0)).count() == 0


def test_simhash_components(docs, none):
    got = simhash.near_duplicates(docs).collect()
    prints = [brute.fingerprint(t) for _, t in pairs()]
    labels = brute.components(prints)
    least = {}
    for (i, _), label in zip(pairs(), labels, strict=True):
        if i is not None:
            least[label] = min(i, least.get(label, i))
    want = Counter((i, p - (1 << 64) if p >> 63 else p, least.get(label)) for (i, _), p, label in zip(pairs(), prints, labels, strict=True))
    assert Counter((r["id"], r["fp"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(docs, radius=3, prints=1)
    assert kept.columns == docs.columns and kept.count() == len(set(labels))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_links_join_exactly_what_is_near(spark, radius):
    rng = random.Random(radius)
    prints = [rng.getrandbits(64) for _ in range(12)]
    for p in list(prints):
        for far in range(1, 6):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), far)))
    prints = sorted(set(prints))
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    links = simhash.links_of(spark.createDataFrame([(0, p) for p in signed], "salt short, fp long"), radius).collect()
    label = {p: p for p in prints}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    for r in links:
        a, b = signed[r["a"]], signed[r["b"]]
        assert (a ^ b).bit_count() <= radius
        label[find(a)] = find(b)
    want = brute.components(prints, radius)
    assert len({(find(p), w) for p, w in zip(prints, want, strict=True)}) == len(set(want)) == len({find(p) for p in prints})


def test_substrings(docs, none):
    distinct = {(i, t) for i, t in pairs() if i is not None and not (i == 3 and t == PROSE[1])}
    got = substrings.dedup_substrings(docs.filter("doc_id IS NOT NULL").filter(F.col("text").isNull() | (F.col("text") != PROSE[1])))
    want = brute.dedup_windows(distinct)
    rows_ = got.collect()
    for r in rows_:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
        assert r["text"] is None or hashlib.sha256(b" ".join(r["text"].encode().split())).hexdigest() == r["kept_sha256"]
    assert len(rows_) == len(rows()) - 3
    assert substrings.dedup_substrings(docs).count() == len(rows()) and substrings.dedup_substrings(none).count() == 0


def kneser_ney_by_hand(texts):
    """A function (words) -> log10 probability, straight from the definition."""
    tri = Counter()
    for t in texts:
        w = ["<", "<", *t.lower().split(), ">"]
        tri.update(zip(w, w[1:], w[2:], strict=False))
    two = Counter((b, c) for _, b, c in tri)
    one = Counter(c for _, c in two)

    def cut(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in (1, 2, 3)]
        d = [min(max(x, 0.05), k - 0.05) for k, x in enumerate(raw, 1)]
        return lambda x: d[min(x, 3) - 1]

    d1, d2, d3 = cut(one), cut(two), cut(tri)

    def p1(c):
        rest = sum(d1(n) for n in one.values()) / sum(one.values()) / (len(one) + 1)
        return (one[c] - d1(one[c]) if one[c] else 0) / sum(one.values()) + rest

    def higher(counts, cut_, context, c, lower):
        own = {k[-1]: n for k, n in counts.items() if k[:-1] == context}
        if not own:
            return lower
        total = sum(own.values())
        return ((own[c] - cut_(own[c])) if c in own else 0) / total + sum(map(cut_, own.values())) / total * lower

    def log_prob(text):
        w = ["<", "<", *text.lower().split(), ">"]
        return sum(math.log10(higher(tri, d3, (a, b), c, higher(two, d2, (b,), c, p1(c)))) for a, b, c in zip(w, w[1:], w[2:], strict=False))

    return log_prob


def test_kneser_ney_equals_definition(spark):
    train = [PROSE[2], PROSE[3], PROSE[3], PROSE[1], "a rare thing"]
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    by_hand, memo = kneser_ney_by_hand(train), kneser_ney.Memo(kneser_ney.xxh64_intdigest)
    probe = [*train, "", "new words here", "the of", "THE thing of new", PROSE[4]]
    got = model.score([kneser_ney.keys_of(t.encode(), memo) for t in probe])
    assert all(abs(g - by_hand(t)) < 1e-3 for g, t in zip(got, probe, strict=True)), [(g, by_hand(t)) for g, t in zip(got, probe, strict=True)]


def test_classifier(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 1, 0, "x"), (3, 1, 0, None), (7, None, None, None), (None, 1, 0, "y"), (8, 1, 0, "z"), (9, 0, 1, "z")], "doc_id long, quality int, toxic int, lang string")
    got = kneser_ney.classify(docs, labels).collect()
    assert Counter(r["id"] for r in got) == Counter(i for i, _ in pairs()) and all(r["perplexity"] >= 1 for r in got)
    kept = kneser_ney.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert kneser_ney.classify(none, labels).count() == 0
    assert all(r["kept"] for r in kneser_ney.classify(docs, labels.limit(0)).collect())


def test_pipeline_stages_keep_columns_and_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = corpus_pipeline.materialise(after, "test")
        assert docs.count() > 0
    rows_ = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(rows_) == docs.count() and all(len(r["token_ids"]) == r["n_tokens"] for r in rows_)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, name):
    verdict, count, _ = check(spark, SF, catalog.QUERIES[name], catalog.ORACLE[name])
    assert verdict == "ok", (name, count, verdict)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs_over_whole_tables(spark, name):
    rows = catalog.QUERIES[name](spark, SF).count()
    if name.startswith("op13"):  # phrases, not documents
        assert rows > 0
    elif name.startswith("op12"):  # a row for each conversation
        assert rows == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    else:
        source = "pages" if name.startswith("op7") else "documents"
        assert rows == spark.read.parquet(f"{SF}/{source}.parquet").count()
