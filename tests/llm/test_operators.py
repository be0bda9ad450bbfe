"""Every operator against brute force, with NULLs, empty and long texts, ties, repeats and no rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from ledgerspark.llm import bpe, exact, maxent, mixing, overlap, pieces, private, simhash, tokens, topk, toxicity, urls
from ledgerspark.llm.common import only_staying

WHITE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = ["the", "of", "Ant", "über", "naïve", "stone", "x1", "42", "don't", "éa", "long-word", "<|endoftext|>"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(60)]
    texts += [texts[0], texts[0].replace(" ", "\n"), texts[1] + " ", texts[2], texts[2]]
    texts += [None, "", " \t\n", "a" * 30_000, "the " * 4_000, "\u2581 \u2581\u2581x", "😀 a\u0558b ٣"]
    near = texts[3].split(" ")
    texts += [" ".join(near[:k] + ["odd"] + near[k:]) for k in range(0, len(near), 3)]
    out = [(i, t, f"s{i % 3}" if i % 7 else None, "extra", i) for i, t in enumerate(texts)]
    return [*out, (None, "no id", "s1", "extra", 0), (3, texts[3], "s0", "again", 1), (3, texts[3], "s0", "again", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fp string, row int").repartition(5)


def pairs(df, *names):
    return sorted(((r["doc_id"], *(r[n] for n in names)) for r in df.collect()), key=str)


def test_mix_meets_targets_and_repeats(docs):
    mixed = mixing.assign(docs)
    first = pairs(mixed.select("doc_id", "_mix.*"), "size", "target", "shards")
    assert first == pairs(mixing.assign(docs).select("doc_id", "_mix.*"), "size", "target", "shards")
    by = {}
    for r in mixed.select("source", "_mix.*").collect():
        own = by.setdefault(r["source"], [0, r["target"], 0, r["source_size"], 0])
        own[0] += r["size"]
        own[2] += r["size"] * len(r["shards"])
        own[4] = max(own[4], r["size"])
        assert len(r["shards"]) <= 2
    total = sum(x[0] for x in by.values())
    assert abs(sum(x[1] for x in by.values()) - 1.5 * total) < 1e-6 * total
    for size, target, taken, source_size, largest in by.values():
        assert size == source_size and target <= 2 * size + 1e-6
        assert abs(taken - target) <= largest
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_hypergeometric_matches_its_law(spark):
    from pyspark.sql import functions as F

    long = lambda n: F.lit(n).cast("long")
    draw = mixing.hypergeometric(long(100), long(30), long(40), mixing.uniform(F.lit(1), F.col("id")))
    found = dict(spark.range(50_000).select(draw.alias("x")).groupBy("x").count().collect())
    for x in range(8, 17):
        share = math.comb(30, x) * math.comb(70, 40 - x) / math.comb(100, 40)
        assert abs(found[x] / 50_000 - share) < 0.01


def test_token_counts_match_library(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    expected = sorted(((r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 1024) for r in rows), key=str)
    assert pairs(tokens.token_counts(docs, path), "n_bytes", "n_tokens", "over_limit") == expected
    assert tokens.token_counts(docs.limit(0), path).count() == 0


def test_pieces_match_library(docs, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = []
    for r in rows:
        ids = [*library.encode(r[1] or ""), library.eos_id()]
        expected.append((r[0], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    found = pairs(pieces.encoding_digests(docs, path), "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == sorted(expected, key=str)
    own = pieces.Pieces(path)
    rng = np.random.default_rng(1)
    for _ in range(500):
        ids = rng.integers(0, 400, rng.integers(1, 12)).tolist()
        assert own.decode(ids) == library.decode(ids)


def test_language_model(docs, rows):
    found = maxent.scores(docs).collect()
    training = Counter()
    words = lambda t: [w for w in WHITE.split(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + ["\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for r in rows:
        if not held(r[0]):
            training.update(words(r[1]))
    n, v = sum(training.values()), len(training)
    expected = Counter()
    for r in rows:
        own = words(r[1])
        base = sum(math.log10((training[w] + 1) / (n + v + 1)) for w in own)
        expected[(r[0], held(r[0]), len(own), sum(training[w] > 0 for w in own), n, round(base, 4))] += 1
    assert expected == Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found
    )
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)
    assert all(r["score"] < 0 for r in found)
    assert maxent.scores(docs.limit(0)).count() == 0


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(1 << 12, 8)).astype(np.float32)
    chunk = maxent.Chunk([b"a b c a", b"", b"b"])
    raw = np.exp(maxent.class_scores(weights, np.zeros(8, np.float32), chunk.contexts(1 << 12)))
    assert np.allclose((raw / raw.sum(axis=1, keepdims=True)).sum(axis=1), 1)


def test_urls(spark):
    pages = [
        (1, "http://A.org/x"), (2, "http://example.org/es/1"), (3, "https://www.example.org/en/12?q"),
        (4, "x://m.com/fr/a#b"), (5, "http://com/de/"), (6, "http://spam-site.net/"), (7, None), (8, "no scheme"),
        (9, "http://a.org"), (10, "http://notorg/"), (11, "http://Xn.casino.net?x://b"), (11, "http://Xn.casino.net?x://b"),
    ]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, host int")
    found = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert found == {
        (1, "a.org", "/x", "org/", "allow"), (2, "example.org", "/es/1", "example.org/es/", "block"),
        (3, "www.example.org", "/en/12", "example.org/en/1", "block"), (4, "m.com", "/fr/a", "com/fr/", "allow"),
        (5, "com", "/de/", "com/de/", "block"), (6, "spam-site.net", "/", None, "block"), (7, "", "", None, "allow"),
        (8, "", "", None, "allow"), (9, "a.org", "", None, "allow"), (10, "notorg", "/", None, "allow"),
        (11, "xn.casino.net", "", None, "block"),
    }
    assert urls.judge(df).count() == len(pages)
    # Beyond the bound of the cascade the listed keys are joined, with the same answers.
    assert {tuple(r) for r in urls.judge(df, max_words=0).collect()} == {tuple(r) for r in urls.judge(df).collect()}
    assert urls.judge(df.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20_000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 50 == 0).alias("listed"))
    cascade = urls.build_cascade(keys)
    assert len(cascade.levels) > 1
    assert keys.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0


@pytest.mark.parametrize("scheme", [(exact.PRIMES, exact.BASES, exact.CHUNK), ((13, 11), (7, 5), 64)])
def test_exact_copies(docs, rows, scheme):
    bare = lambda t: WHITE.sub("", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(bare(r[1]), []).append(r)
    found = exact.copies(docs, scheme=scheme).collect()
    assert len(found) == len(rows)
    expected = []
    for text, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        expected += [(r[0], best[0], len(own), hashlib.sha256(text.encode()).hexdigest()) for r in own]
    assert sorted(expected, key=str) == sorted(((r[0], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=str)
    assert sum(r["kept"] for r in found) == len(groups)
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact.copies(docs.limit(0)).count() == 0


def test_fingerprints_compose():
    scheme = exact.Fingerprint(chunk=7)
    text = bytes(range(256)) * 3
    whole = exact.Fingerprint(chunk=1 << 16).of(text)
    assert scheme.of(text) == whole == scheme.join(scheme.of(text[:100]), scheme.of(text[100:]), len(text) - 100)


def test_private_data(spark):
    def luhn(digits):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0

    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    texts = [
        None, "", "a@b.c_d@e.f x@y.z@q.r a.b@c", "9" * 30_000, "a" * 30_000, "1 " * 20_000,
        "😀 a@b.co 1.2.3.4.5.6.7.8 +1 (222) 333-44-55 +12 4111 1111 1111 1111 4111-1111-1111-1111",
        "0255.001.2.3 256.1.1.1 1.1.1.999", "é+49 30 1234567.", "é+49 30 1234567.",
    ]
    texts += [f"please call desk at +1 202 555 01{i:02d} today" for i in range(40)] + ["please call desk at 202 555 0199 today"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in private.private_digests(df).collect():
        spans = []
        for kind, pattern in kinds.items():
            for m in re.finditer(pattern, texts[r["doc_id"]] or ""):
                digits = re.sub("[^0-9]", "", m[0])
                sound = {
                    "email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                    "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 8 <= len(d) <= 15,
                }[kind]()
                spans += [f"{kind}:{m.start()}:{m.end()}"] * sound
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(","))
        # Only the last text holds a number that nothing but its context gives away.
        assert r["n_added"] == (1 if r["doc_id"] == len(texts) - 1 else 0)
    assert private.private_digests(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    plain = ["word%d" % i for i in range(300)]
    text = lambda bad: " ".join([*rng.choice(plain, 40), *(["Vile!", "scum", "vilest"] if bad else [])])
    bad = [i % 5 == 0 for i in range(4000)]
    df = spark.createDataFrame([(i, text(b)) for i, b in enumerate(bad)] + [(9000, None), (9000, None)], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, 1, int(b)) for i, b in enumerate(bad) if i % 2] + [(1, None, 1), (None, 0, 0), (3, 1, int(bad[3]))],
        "doc_id long, quality int, toxic int",
    )
    found = {r["doc_id"]: r["_tox"]["rejected"] for r in toxicity.toxicity(df, labels).collect()}
    assert [found[i] for i in range(4000)] == bad and found[9000] is False
    assert toxicity.toxicity(df, labels.limit(0)).where("_tox.rejected").count() in (0, 4002)
    assert toxicity.toxicity(df.limit(0), labels).count() == 0


def test_descent_takes_every_training_row(spark, monkeypatch):
    texts = [f"w{i} w{i % 7} x" for i in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    met, summed = [], maxent._summed

    def noted(sums, key, names):
        found = summed(sums, key, names)
        if names[0] == "met":
            # The bias is the row behind all features; it is met once per token and kind of feature.
            met.append(found[found[:, 0] == maxent.FEWEST][:, 1].sum())
        return found

    monkeypatch.setattr(maxent, "_summed", noted)
    classes = np.arange(maxent.WORD_BUCKETS) % maxent.CLASSES
    maxent.train(df, classes, maxent.FEWEST)
    # Three words and the end.
    assert len(met) == maxent.ROUNDS and sum(met) == 4 * len(texts) * maxent.CONTEXTS


def test_simhash_groups(docs, rows):
    def fingerprint(text):
        words = [w for w in WHITE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        if not words:
            return 0
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(rows))]
    names = {}
    for i, r in enumerate(rows):
        names.setdefault(label[i], []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    expected = sorted(((r[0], prints[i], least[label[i]]) for i, r in enumerate(rows)), key=str)
    found = simhash.near_groups(docs).collect()
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found), key=str) == expected
    assert simhash.without_near_copies(docs).count() == len(names)
    assert simhash.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [8, 512])
def test_trie_join_loses_no_link(spark, monkeypatch, tile):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    values = {centre ^ sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 9))) for _ in range(400)}
    values |= {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)}
    values = np.array(sorted(values))
    monkeypatch.setattr(simhash, "TILE", tile)
    df = spark.createDataFrame([(int(v),) for v in values], "fp long").repartition(3)
    edges = np.array([tuple(r) for r in simhash.links(df).collect()]).reshape(-1, 2)
    at = {int(v): i for i, v in enumerate(values)}
    near = np.bitwise_count(values.view(np.uint64)[:, None] ^ values.view(np.uint64)[None]) <= 4
    i, j = np.nonzero(near)
    whole = simhash.forest(len(values), i, j)
    own = simhash.forest(len(values), np.array([at[int(a)] for a in edges[:, 0]]), np.array([at[int(b)] for b in edges[:, 1]]))
    assert (whole == own).all()


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)]
    vectors += [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    sound = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors[:300]}
    expected = []
    for q in range(0, 300, 50):
        scores = sorted((-sum(a * b for a, b in zip(sound[q], v, strict=True)), i) for i, v in sound.items() if i != q)
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:5], 1)]
    assert sorted(tuple(r) for r in topk.top_k(df, shard_rows=64).collect()) == expected
    assert topk.top_k(df.limit(0)).count() == 0


def test_only_staying_keeps_one_of_equal_rows(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (2, "b", 0), (None, None, 0)], "doc_id long, text string, stays int")
    from pyspark.sql import functions as F

    decided = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), (F.coalesce("doc_id", F.lit(0)) != 2).alias("stays"))
    assert sorted((r["doc_id"] or 0) for r in only_staying(df, decided, "doc_id", "text").collect()) == [0, 1]


def test_pipeline_stages_chain(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def brute_near_copies(rows):
    """For each of ``(doc_id, text)`` the index of its group; pairs of Jaccard 0.8 over five words are linked."""
    sets = []
    for _, text in rows:
        words = [w for w in WHITE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for j, y in enumerate(sets):
        for i in range(j):
            x = sets[i]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("common", [0, 1 << 18])
def test_pipeline_near_copies(spark, rows, monkeypatch, common):
    import corpus_pipeline

    monkeypatch.setattr(overlap, "COMMON", common)
    rng = np.random.default_rng(8)
    own = [(r[0], r[1]) for r in rows]
    # A chain of edits and a large group around one text; beyond a few edits two of them are not similar.
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    for i in range(60):
        words = list(base)
        for k in rng.integers(0, 120, i % 6):
            words[k] = f"odd{i}"
        own.append((1000 + i, " ".join(words)))
    expected = brute_near_copies(own)
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(4)
    names = {}
    for (i, _), group in zip(own, expected, strict=True):
        names.setdefault(group, []).append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    found = overlap.similar_groups(df).collect()
    assert pairs_of(found) == sorted(((i, least[g]) for (i, _), g in zip(own, expected, strict=True)), key=str)
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns and kept.count() == len(names)
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """The stage joins fingerprints of five words by tries; its pairs connect what links of four bits connect."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    texts = []
    for _ in range(6):
        base = [f"w{i}" for i in rng.integers(0, 5000, 500)]
        texts += [" ".join([*base[: 500 - k], *[f"odd{k}"] * k]) for k in range(4)] + [" ".join(base[:3])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, *bits: asked.append(prints.count()) or links(prints, *bits))
    marks = overlap.prefixes(df, np.empty(0, np.int64))
    nodes = [overlap.node_of(overlap.shingles(t.encode())) for t in texts]
    prints = [simhash.fingerprint(t.encode(), 5) % (1 << 64) for t in texts]
    assert {(r["doc_id"], r["node"], r["fp"] % (1 << 64)) for r in marks.collect()} == set(zip(range(len(texts)), nodes, prints, strict=True))
    pairs = [(nodes.index(r["a"]), nodes.index(r["b"])) for r in overlap.fingerprint_pairs(marks).collect()]
    near = [(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 4]
    forests = [simhash.forest(len(texts), *np.array(x).T) for x in (pairs, near)]
    assert (forests[0] == forests[1]).all() and len(near) > 6
    corpus_pipeline.drop_near_copies(spark, df, "").count()
    assert len(asked) == 2 and asked[0] == asked[1] == len(set(prints))


def test_bitmaps_bound_what_sets_have_apart():
    rng = np.random.default_rng(12)
    for n, m, both in [(0, 0, 0), (0, 5, 0), (5, 5, 5), (90, 100, 90), (2000, 2000, 1340), (3000, 2400, 2400), (1500, 2600, 700)]:
        own = rng.integers(-(1 << 63), 1 << 63, n + m - both)
        a, b = np.unique(own[:n]), np.unique(own[n - both :])
        assert (len(a), len(b)) == (n, m)
        x, y = overlap.parities(a), overlap.parities(b)
        assert overlap.least_apart(x, y) == overlap.least_apart(y, x) <= len(np.setxor1d(a, b))
        assert overlap.could_be_similar(n, x, m, y) >= overlap.similar(a, b)
        # Large sets of half the similarity need not be made again.
        assert both != 1340 or not overlap.could_be_similar(n, x, m, y)


@pytest.mark.parametrize("wide", [overlap.WIDE, 1])
def test_sets_around_one_text_need_few_pairs(spark, monkeypatch, wide):
    """Sets that share most of one text without being similar to it are not compared each with each."""
    monkeypatch.setattr(overlap, "WIDE", wide)
    rng = np.random.default_rng(14)
    base = [f"w{i}" for i in range(146)]

    def edited(words, edits, mark):
        words = list(words)
        for k in rng.choice(len(words), edits, replace=False):
            words[k] = f"{mark}_{k}"
        return words

    far = [edited(base, int(rng.integers(4, 7)), f"odd{i}") for i in range(150)]
    # Some are similar to one of those only, some lack words that others lack too.
    own = [base, *far, *[edited(x, 1, f"more{i}") for i, x in enumerate(far[:20])], *[base[:k] + base[k + 3 :] for k in range(0, 140, 7)]]
    rows = [(i, " ".join(words)) for i, words in enumerate(own)]
    met, bounded = [], overlap.Sets.bounded
    monkeypatch.setattr(overlap.Sets, "bounded", lambda self, pairs: met.append(pairs.count()) or bounded(self, pairs))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in overlap.similar_groups(df).collect()}
    assert [found[i] for i in range(len(rows))] == brute_near_copies(rows)
    assert sum(met) < 5 * len(rows)


def test_apartnesses_of_similar_sets_meet():
    rng = np.random.default_rng(15)
    away = 0
    for trial in range(3000):
        n = int(rng.integers(5, 200))
        words = np.unique(rng.integers(-(1 << 63), 1 << 63, 3 * n))
        middle, spare = np.sort(words[rng.permutation(len(words))[:n]]), words

        def near(of, most):
            lost = rng.permutation(len(of))[: rng.integers(0, most + 1)]
            return np.union1d(np.delete(of, lost), rng.choice(spare, rng.integers(0, most + 1), replace=False))

        x = near(middle, n // 3)
        y = near(x, max(1, n // 9))
        for a, b in ((x, y), (y, x)):
            if not len(a) or not len(b) or not overlap.similar(a, b) or overlap.similar(a, middle):
                continue
            away += 1
            p, many, looked, _ = overlap.apartness(a, middle, True)
            q, others, _, shown = overlap.apartness(b, middle, not overlap.similar(b, middle))
            both = np.intersect1d(p[:looked], q[:shown])
            assert len(both)
            # By the first of them in order, as many may follow as must be shared.
            at = min(p.tolist().index(w) for w in both), min(q.tolist().index(w) for w in both)
            assert 18 * min(many - at[0], others - at[1]) >= 9 * (many + others) - len(a) - len(b)
    assert away > 200


def test_prefixes_of_similar_sets_share_enough():
    rng = np.random.default_rng(16)
    for trial in range(300):
        words = np.unique(rng.integers(-(1 << 63), 1 << 63, int(rng.integers(1, 600))))
        other = np.union1d(np.delete(words, rng.permutation(len(words))[: len(words) // 9]), rng.integers(-(1 << 63), 1 << 63, len(words) // 10))
        if not overlap.similar(words, other):
            continue
        late = np.sort(words[:: int(rng.integers(1, 9))])
        shared = len(np.intersect1d(overlap.prefix(words, late), overlap.prefix(other, late)))
        assert shared >= 1 + min(len(words), len(other)) // overlap.EXTRA
        assert shared >= 1 + -(-4 * max(len(words), len(other)) // 5) // overlap.EXTRA


def pairs_of(found):
    return sorted(((r["doc_id"], r["component_id"]) for r in found), key=str)


def test_private_finds_spaced_cards(spark):
    digits = "4111111111111111"
    texts = ["card " + " ".join(digits), "card " + "-".join(digits), "- ".join(digits), " ".join(digits[:-1] + "2")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_card"], r["base_sha256"], r["spans"]) for r in private.private_digests(df).collect()}
    span = "card:5:36"
    none = hashlib.sha256(b"").hexdigest()
    own = (1, hashlib.sha256(span.encode()).hexdigest(), span)
    assert found == {0: own, 1: own, 2: (0, none, ""), 3: (0, none, "")}


@pytest.mark.parametrize("shard", [20_000, 50])
def test_toxicity_learns_rare_words(spark, shard):
    rng = np.random.default_rng(6)
    plain = ["word%d" % i for i in range(200)]
    bad = [i % 10 == 0 for i in range(200)]
    text = lambda b: " ".join([*rng.choice(plain, 20), *(["scum"] if b else [])])
    df = spark.createDataFrame([(i, text(b)) for i, b in enumerate(bad)], "doc_id long, text string")
    # The word is in ten of a hundred labelled documents; the other half is only scored.
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad) if i % 20 < 10], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["_tox"]["toxic"] for r in toxicity.toxicity(df, labels, shard=shard).collect()}
    assert min(found[i] for i, b in enumerate(bad) if b) > max(found[i] for i, b in enumerate(bad) if not b)


def test_long_words_merge_alike(monkeypatch):
    own = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(9)
    letters = list("aeiorstnhé")
    words = ["".join(rng.choice(letters, n)) for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1)]
    words += ["a" * n for n in range(bpe.LONG - 2, bpe.LONG + 3)]
    found = []
    for bound in (0, bpe.LONG, 1 << 30):
        monkeypatch.setattr(bpe, "LONG", bound)
        found.append(own.merged(words))
    assert found[0] == found[1] == found[2]
