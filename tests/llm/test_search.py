"""Ranked search, language identification and centroid clustering against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import centroids, langid, private, ranked, topk, urls
from ledgerspark.session import settings

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def rank_all(docs, items, k=10):
    """Scores of every document for every item, by the contract's arithmetic."""
    counted = [(i, terms(t)) for i, t in docs]
    counted = [(i, Counter(t), len(t)) for i, t in counted if t]
    n, length = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        mine = set(terms(text))
        scores = []
        for i, c, size in counted:
            m = 10 + 90 * size * n // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in mine if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for place, (score, none, i) in enumerate(sorted(scores)[:k]):
            out.append((item, place + 1, None if none else i, -score))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library():
    rng = np.random.default_rng(11)
    words = ["the", "Of", "ÜBER", "stone", "x1", "42", "don't", "a-b", "rare1", "rare2", "É", "_under_", "日本"]
    p = np.array([9, 8, 3, 3, 2, 2, 2, 2, 0.2, 0.1, 1, 1, 1])
    texts = [" ".join(rng.choice(words, rng.integers(1, 50), p=p / p.sum())) for _ in range(150)]
    texts += [texts[0]] * 30 + [None, "", " \t!!", "the " * 20_000 + "rare1", "a" * 50_000, "x1\x80\u0085y"]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(None, "rare2 stone without id"), (3, texts[3]), (3, texts[3]), (3, "another text of id 3 x1")]
    items = [(0, "Rare1 rare2 the"), (1, "stone STONE über don't"), (2, None), (3, ""), (4, "zzz absent"), (5, texts[0]), (6, "t 42 _ 日本")]
    return docs, items


def answers(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ranked_search_equals_brute_force(spark, library):
    docs, items = library
    table = spark.createDataFrame([(*d, 1.0, "x") for d in docs], "doc_id long, text string, score double, terms string").repartition(5)
    asked = spark.createDataFrame([(*i, 7, "y") for i in items], "item_id long, text string, rank int, n string")
    expected = rank_all(docs, items)
    assert answers(ranked.ranked(table, asked)) == expected
    # Many shards, many blocks of items.
    assert answers(ranked.ranked(table, asked, shard_postings=150, block_queries=2)) == expected
    assert answers(ranked.ranked(table, asked, k=3)) == rank_all(docs, items, 3)


def test_ranked_search_without_rows_and_with_repeats(spark, library):
    docs, items = library
    table = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert answers(ranked.ranked(table.limit(0), asked)) == []
    assert answers(ranked.ranked(table, asked.limit(0))) == []
    assert answers(ranked.ranked(table.where("text is null"), asked)) == []
    twice = answers(ranked.ranked(table, asked.unionByName(asked)))
    assert twice == sorted(rank_all(docs, items) * 2, key=str)
    named = spark.createDataFrame([("b", "stone x1"), ("a", "stone x1"), (None, "x1")], "id string, body string")
    found = ranked.ranked(named, asked, doc_id="id", text="body").where("item_id = 1").collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(found)] == [(1, "a"), (2, "b")]


def test_range_maxima_are_those_of_a_scan():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 70, 12)
    keys = np.concatenate([(np.int64(t) << 32) + np.sort(rng.choice(1000, s, replace=False)) for t, s in enumerate(sizes)])
    lists = ranked.Postings(keys, rng.integers(1, 9, len(keys)))
    ends = np.cumsum(sizes)
    for _ in range(300):
        t = rng.integers(len(sizes))
        a, b = np.sort(rng.integers(ends[t] - sizes[t], ends[t] + 1, 2))
        at, most = lists.largest(np.array([a]), np.array([b]))
        part = lists.impacts[a:b]
        assert most[0] == (part.max() if len(part) else 0)
        if len(part):
            assert at[0] == a + part.argmax()


def test_search_opens_few_intervals():
    """Bounds prune: documents that cannot be among the best are not scored."""
    rng = np.random.default_rng(4)
    n = 20_000
    rare, often = np.sort(rng.choice(n, 40, replace=False)), np.arange(n)
    keys = np.concatenate((often, (np.int64(1) << 32) + rare))
    impacts = np.concatenate((rng.integers(1, 100, n), rng.integers(500, 900, 40)))
    lists = ranked.Postings(keys, impacts)
    looked = []
    plain = lists.largest
    lists.largest = lambda low, high: looked.append(len(low)) or plain(low, high)
    found = ranked.best(lists, np.array([0, 1]), np.array([3, 50]))
    score = 3 * impacts[:n]
    score[rare] += 50 * impacts[n:]
    order = np.lexsort((often, -score))[:10]
    assert found == [(int(d), int(score[d])) for d in order]
    assert sum(looked) < n / 20


LANGS = {
    "en": "the and that with this from have there which would about could other into than".split(),
    "de": "der und die nicht mit eine über schön für wird auch können großen nach bei".split(),
    "ru": "это как его она они был только еще что всех был после время".split(),
}


@pytest.fixture(scope="module")
def spoken():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        lang = list(LANGS)[i % 3]
        rows.append((i, " ".join(rng.choice(LANGS[lang], rng.integers(3, 60))), lang))
    rows += [(400, None, "en"), (401, "", "en"), (402, "123 ... !!", "de"), (403, "the " * 100_000, "en"), (404, "UND", None)]
    rows += [(405, "日本語", None), (None, "the and that", "en"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (406, "a", None)]
    return rows


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def model_by_hand(rows):
    """Vectors, frequencies and clusters over the training rows, one after the other."""
    table = langid.letter_table()
    train = [(i, t, x) for i, t, x in rows if t is not None and x is not None and not held(i) and any(c.isalpha() for c in t)]
    df = np.zeros(langid.DIMENSIONS)
    for _, t, _ in train:
        df[np.unique(langid.grams(t.encode(), table))] += 1
    idf = np.log((1 + len(train)) / (1 + df)) + 1
    lines = {}
    for _, t, lang in train:
        at, value = langid.frequencies(t.encode(), table)
        v = langid.unit(at, value, idf).astype(np.float32)
        lines.setdefault(lang, []).append((at.astype(np.int32).tobytes(), v.tobytes(), at, v))
    names, stacked, radius = [], [], []
    for lang in sorted(lines):
        own = sorted(lines[lang], key=lambda x: x[:2])
        dense = np.zeros((len(own), langid.DIMENSIONS), np.float32)
        for line, (_, _, at, v) in zip(dense, own, strict=True):
            line[at] = v
        found, far = langid.cluster(dense, langid.CENTROIDS)
        names += [lang] * len(found)
        stacked += list(found)
        radius += list(far)
    return table, idf, names, np.array(stacked), np.array(radius)


def test_languages_equal_brute_force(spark, spoken):
    docs = spark.createDataFrame([(*r, "n", 0.0) for r in spoken], "doc_id long, text string, lang string, held_out string, score double")
    found = langid.languages(docs.repartition(4))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    table, idf, names, stacked, radius = model_by_hand(spoken)
    expected = []
    for i, t, _ in spoken:
        if t is None or not any(c.isalpha() for c in t):
            expected.append((i, held(i), "und", 0.0, True))
            continue
        at, value = langid.frequencies(t.encode(), table)
        similar = stacked[:, at] @ langid.unit(at, value, idf)
        best = int(similar.argmax())
        expected.append((i, held(i), names[best], float(similar[best]), bool(1 - similar[best] > radius[best])))
    mine = sorted((tuple(r) for r in found.collect()), key=str)
    for a, b in zip(mine, sorted(expected, key=str), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-5) and 0 <= a[3] <= 1
        assert a[4] == b[4] or b[2] == "und" or min(abs(1 - b[3] - radius)) < 1e-5
    labelled = {i: x for i, t, x in spoken if i is not None and i < 400}
    right = [a[2] == labelled[a[0]] for a in mine if a[1] and a[0] in labelled]
    assert len(right) > 50 and np.mean(right) > 0.97
    assert {a[0]: a[4] for a in mine}[405]


def test_languages_ignore_inputs_that_are_not_text(spark, spoken):
    docs = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    other = docs.selectExpr("doc_id", "text", "case when crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 5 = 0 then 'zz' else lang end as lang")
    get = lambda d: sorted(((r[0], r[2], round(r[3], 9)) for r in langid.languages(d).collect()), key=str)
    assert get(docs) == get(other)
    assert langid.languages(docs.limit(0)).count() == 0
    unlabelled = langid.languages(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {(r["lang_pred"], r["score"]) for r in unlabelled.collect()} == {("und", 0.0)}
    # A sample smaller than the rows still learns every language.
    few = langid.languages(docs, sample=20).collect()
    labelled = {i: x for i, t, x in spoken if i is not None and i < 400}
    assert np.mean([r["lang_pred"] == labelled[r["doc_id"]] for r in few if r["doc_id"] in labelled]) > 0.9


def test_wrong_labels_get_no_centroid():
    rng = np.random.default_rng(0)
    good = np.abs(rng.normal(size=(200, 30))) + 5 * (np.arange(30) < 15)
    bad = np.abs(rng.normal(size=(2, 30))) + 50 * (np.arange(30) >= 15)
    rows = np.concatenate((good, bad))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    found, _ = langid.cluster(rows, 3)
    assert (found @ rows[-1] < 0.9).all()


def lloyd(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    mid = [v for _, v in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(mid))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(mid)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                mid[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    final = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in final:
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in mid]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), names[c]) for i, d, c in final), key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(7, 64))
    rows = [(i, (middle[i % 7] + 0.4 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(40)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[9][1])]
    rows += [(500, None), (501, [1.0] * 63), (502, [1.0] * 63 + [None]), (503, [1.0] * 63 + [float("nan")])]
    rows += [(504, [1.0] * 63 + [float("inf")]), (505, []), (506, [0.0] * 64), (507, [-0.0] * 64), (508, [900.0] * 64)]
    return rows


def clusters_of(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_centroids_equal_brute_force(spark, vectors, monkeypatch):
    schema = "vec_id long, embedding array<float>, cluster string, ids long"
    table = spark.createDataFrame([(*r, "x", 1) for r in vectors], schema).repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert clusters_of(centroids.clustered(table)) == lloyd(vectors)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 17)
    assert clusters_of(centroids.clustered(table, rounds=6)) == lloyd(vectors, rounds=6)


def test_centroids_of_few_and_no_vectors(spark, vectors):
    schema = "vec_id long, embedding array<float>"
    table = spark.createDataFrame(vectors[:5], schema)
    assert clusters_of(centroids.clustered(table)) == lloyd(vectors[:5])
    assert clusters_of(centroids.clustered(table.limit(1))) == lloyd(vectors[:1])
    assert clusters_of(centroids.clustered(table.limit(0))) == []
    same = [(i, vectors[0][1]) for i in range(40)]
    assert clusters_of(centroids.clustered(spark.createDataFrame(same, schema))) == lloyd(same)


def test_heaps_look_at_few_vectors_and_lose_none():
    rng = np.random.default_rng(6)
    middle = rng.integers(-60, 60, (8, 16))
    v = (middle[rng.integers(0, 8, 3000)] + rng.integers(-9, 10, (3000, 16))).astype(np.int16)
    mids = v[rng.choice(3000, 8, replace=False)].astype(np.int64)
    block, used, looked = centroids.Block.first(v, mids), np.zeros(8), []
    for _ in range(8):
        sums = block.sums(8)
        moved = np.array([s[1:] // s[0] if s[0] else m for s, m in zip(sums, mids, strict=True)])
        used = centroids.accumulate(used, mids, moved)
        mids = moved
        row = {**block.packed(), "vectors": v.tobytes(), "kind": v.dtype.str, "width": 16}
        block = centroids.Block.unpacked(row)
        looked.append(block.move(mids, used))
        d = ((v[:, None].astype(np.int64) - mids) ** 2).sum(axis=2)
        assert (block.cluster == d.argmin(axis=1)).all()
        assert sorted(m for h in block.heaps for _, m in h) == list(range(3000))
    assert looked[-1] < 300


def test_top_vectors_count_every_row(spark):
    """Repeated rows and ids are rows of their own: candidates of each other, and queries of their own."""
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(120)]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (50, rows[50][1]), (50, rows[3][1]), (None, rows[0][1]), (7, [1.0] * 5)]
    schema = "vec_id long, embedding array<float>, row long, dim int, shard int, score string"
    df = spark.createDataFrame([(*r, 0, 9, 9, "x") for r in rows], schema).repartition(3)
    whole = [(i, np.floor(256 * np.float32(v).astype(np.float64))) for i, v in rows if i is not None]
    expected = []
    for n, (q, v) in enumerate(whole):
        if q % 50 == 0:
            scored = sorted((-int(v @ w), i) for m, (i, w) in enumerate(whole) if m != n and len(w) == len(v))
            expected += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:5])]
    assert sorted(tuple(r) for r in topk.top_k(df, shard_rows=40).collect()) == sorted(expected)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_trees_leave_subtrees_unopened():
    rng = np.random.default_rng(13)
    middle = rng.normal(size=(40, 8)) * 50
    v = np.floor(middle[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)))
    tree = topk.build_tree(v, 32)
    v, ids = v[tree.order], np.arange(4000)[tree.order]
    for child in (x for x in tree.nodes[:, 2] if x >= 0):
        assert tree.nodes[child, 1] == tree.nodes[child + 1, 0]
    for n in range(0, 4000, 400):
        found, opened = topk.search_one(tree, v, ids, ids, int(ids[n]), v[n], 5, float("-inf"))
        scores = v @ v[n]
        order = [i for i in np.lexsort((ids, -scores)) if i != n][:5]
        assert [(x[1], -x[0]) for x in found] == [(ids[i], scores[i]) for i in order]
        assert opened < len(tree.nodes) / 4


def best_vectors(rows, every, k=5):
    """``query_id, rank, vec_id, score`` of each query against all rows, one after the other."""
    whole = [(i, np.floor(256 * np.float32(v).astype(np.float64))) for i, v in rows]
    expected = []
    for n, (q, v) in enumerate(whole):
        if q % every == 0:
            scored = sorted((-int(v @ w), i) for m, (i, w) in enumerate(whole) if m != n and len(w) == len(v))
            expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(expected)


def test_top_vectors_broadcast_no_side(spark):
    """Queries times shards are some 5 MB here and grow with the square of the rows: no driver holds that."""
    rng = np.random.default_rng(14)
    rows = [(i, rng.normal(size=16).round(2).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    with settings(spark, {"spark.sql.maxBroadcastTableSize": "1m"}):
        found = topk.top_k(df, every=10, shard_rows=16)
        assert sorted(tuple(r) for r in found.collect()) == best_vectors(rows, 10)
    assert "Broadcast" not in found._jdf.queryExecution().toString()


def test_top_vectors_meet_in_many_cells(spark, monkeypatch):
    """Groups of blocks by groups of trees, with ties, repeated ids and two lengths."""
    for name, value in (("HELD_BYTES", 1), ("CELL_TREES", 2), ("QUERY_ROWS", 16), ("TOGETHER", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(15)
    rows = [(int(i), rng.normal(size=5).round(1).tolist()) for i in rng.integers(0, 300, 400)]
    rows += [(i, [0.5, float(i % 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(tuple(r) for r in topk.top_k(df, every=6, shard_rows=60).collect()) == best_vectors(rows, 6)


@pytest.mark.parametrize("scale", [1, 1000])
def test_queries_search_a_tree_together(scale):
    """Single and double precision; each query's best as if it searched alone, whatever the others open."""
    rng = np.random.default_rng(16)
    middle = rng.normal(size=(20, 8)) * 50
    v = np.floor(scale * (middle[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 8))))
    v[1000:1100] = v[0]
    tree = topk.build_tree(v, 32)
    v, ids = v[tree.order], tree.order % 700
    asking = np.arange(0, 2000, 5)
    first = topk.Asked(v[asking], asking, np.full(400, -np.inf), np.zeros(400, np.int64), 5)
    assert topk.search(tree, v, ids, np.arange(2000), first, first=True) < 400 * 8
    first.settle()
    asked = topk.Asked(v[asking], asking, first.least, first.least_id, 5)
    opened = topk.search(tree, v, ids, np.arange(2000), asked)
    assert opened < 400 * len(tree.nodes) / 2
    asked.settle()
    assert (asked.total * np.abs(v).max() < 2**22) == (scale == 1)
    query, score, of, row = asked.best
    for n, own in enumerate(asking):
        scores = v @ v[own]
        order = [i for i in np.lexsort((np.arange(2000), ids, -scores)) if i != own][:5]
        assert row[query == n].tolist() == order
        assert score[query == n].tolist() == scores[order].tolist()
        assert of[query == n].tolist() == ids[order].tolist()


def test_large_filters_are_built_in_linear_time(spark):
    """150,000 listed keys: a look-up per word of the filter would take minutes."""
    keys = spark.range(200_000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"), (F.col("id") % 4 > 0).alias("listed"))
    cascade = urls.build_cascade(keys)
    assert keys.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0


def believe(edges, rounds, support):
    """Rounds over the graph, one after the other."""
    score = {(i, k, s): float(s) for _, k, i, _, s, _ in edges}
    for step in range(rounds):
        total = {}
        for p, k, i, w, s, n in edges:
            t = total.setdefault((p, k), [0.0, 0, set(), set()])
            t[0] += n * score[i, k, s]
            t[1] += n
            if score[i, k, s] >= private.BELIEVED:
                t[2].add(i)
                t[3].add(w)
        found = {key: g / a for key, (g, a, i, w) in total.items() if len(i) >= support and len(w) >= support}
        for _, k, i, _, s, _ in edges:
            if not s:
                score[i, k, s] = max((found.get((p, k), 0.0) for p, kk, ii, _, ss, _ in edges if (kk, ii, ss) == (k, i, s)), default=0.0)
    return found


def test_pattern_scores_equal_brute_force(spark):
    rng = np.random.default_rng(14)
    edges = {(f"p{rng.integers(12)}", f"k{rng.integers(2)}", f"i{rng.integers(30)}", f"w{rng.integers(6)}", bool(rng.integers(3) == 0)): int(rng.integers(1, 5)) for _ in range(160)}
    rows = [(*key, n) for key, n in edges.items()]
    df = spark.createDataFrame(rows, "pattern string, kind string, instance string, wider string, seed boolean, n long")
    for rounds, support in ((1, 1), (3, 3)):
        found = {(r["pattern"], r["kind"]): r["confidence"] for r in private.score_patterns(df, rounds, support).collect()}
        assert found == pytest.approx(believe(rows, rounds, support))


def test_contexts_teach_and_do_not_mislead(spark):
    """A telling context finds unseen numbers and teaches a second one; a bare word it ends with does not."""
    texts = [f"please call desk at +1 202 555 {1000 + i} today" for i in range(14)]
    unseen = ["202 555 77 01", "202 555 77 02", "202 555 77 03"]
    texts += [f"please call desk at {n} today" for n in unseen]
    texts += [f"then kindly ring {n} again" for n in unseen]
    second = len(texts)
    texts += ["then kindly ring 303 444 88 09 again", "the room at 2000 33 11 was full", f"a {'x' * 90}desk at 404 555 66 08"]
    texts += [None, "", "at " * 3000 + "2000 33 11"]
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, texts[0], "n", 1), (0, texts[0], "n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pattern string, row int").repartition(3)
    found = private.private_digests(df)
    added = {r["doc_id"]: (r["spans"], r["n_added"]) for r in found.collect()}
    for i in (14, 15, 16):
        assert added[i] == ("phone:20:33", 1)
    for i in (17, 18, 19):
        assert added[i] == ("phone:17:30", 1)
    assert added[second] == ("phone:17:30", 1)
    assert [added[i] for i in range(second + 1, len(texts))] == [("", 0)] * 5
    assert added[0] == added[None] and added[0][1] == 0 and found.count() == len(rows)
    assert private.private_digests(df.limit(0)).count() == 0


CLASHING = ["_any", "_own_key", "_doc_id", "_text_key", "own_id", "row", "node", "key", "own_key", "n", "words", "text_key", "label", "shard", "batch"]


def test_whole_chain_on_odd_rows(spark, tmp_path):
    """NULLs, very long and empty texts, repeats and columns of every inner name go through all stages."""
    import corpus_pipeline

    rng = np.random.default_rng(15)
    words = ["stone", "river", "night", "house", "garden", "window", "letter", "winter", "summer", "market"]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(30)]
    texts += [texts[0], texts[1] + " ", None, None, "", "long " * 30_000, "x" * 40_000]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), *[f"{name}-{i}" for name in CLASHING]) for i, t in enumerate(texts)]
    rows += [rows[2], (None, texts[3], None, None, None, *[None] * len(CLASHING))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in CLASHING)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 30, 2)] + [(1, None, 1), (None, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = {(r[0], r[1]): r for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        kept.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        for r in docs.collect():
            assert tuple(r) == known[r["doc_id"], r["text"]], name
        if name == "exact dedup":
            bare = ["".join((t or "").split()) for t in texts]
            assert docs.count() == len(set(bare))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == docs.count() and all(r["n_tokens"] == len(r["ids"]) > 0 for r in last)
    by_id = {r[0]: r[1] for r in rows}
    assert all(r["decoded"].strip() == (by_id[r["doc_id"]] or "").strip() for r in last if r["doc_id"] is not None and r["doc_id"] < 30)


def test_whole_chain_without_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
