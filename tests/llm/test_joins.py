import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textveil.llm.components import connected_components
from textveil.llm.jaccard_join import choose_matches, jaccard_components, keep_first, least_common, partition_keys
from textveil.llm.paragraph_dedup import anchors, cut, remove_passages, repeated_passages, tuned
from textveil.llm.topk import Search, rotation_of, top_k
from textveil.llm.url_filter import evaluate, host_of

SF = "/root/testdata/sf0.01"


def brute_components(texts, k, percent):
    sets = {}
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in held[s])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            held[s].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def family(rng, size, words, edits):
    """Copies of a text with random edits, and exact copies."""
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"e{rng.randint(0, 9999)}"
        yield " ".join(own)


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, k, percent):
    rng = random.Random(k)
    texts = [None, "", " ", "a", "A", "a b", "A  b", "x y z", "x y z x y z x y z", "é À é"]
    for size, words, edits in ((60, 120, 6), (40, 60, 9), (5, 30, 2), (30, 12, 1), (25, 400, 30)):
        texts += family(rng, size, words, edits)
    texts += [f"common words in every one {i % 7} " + " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(3, 20))) for i in range(200)]
    by_id = dict(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in by_id.items()], "doc_id long, text string, component_id string")
    got = jaccard_components(docs.repartition(5), k=k, percent=percent, group_most=4, block_rows=16)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
    assert rows == brute_components(by_id, k, percent)
    kept = keep_first(docs, k=k, percent=percent)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, (_, c) in rows.items() if c == i}


def test_components_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, k=5, percent=80).collect()}
    assert got == brute_components({r.doc_id: r.text for r in docs.collect()}, 5, 80)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(docs).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert sorted(str(r.doc_id) for r in keep_first(docs).collect()) == ["1", "1", "None"]
    assert jaccard_components(docs.limit(0)).count() == keep_first(docs.limit(0)).count() == 0


def test_prefixes_and_parts_lose_no_link():
    rng = np.random.default_rng(3)
    frequent = np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64))
    for _ in range(1500):
        percent = int(rng.choice([80, 90]))
        base = np.unique(np.concatenate([rng.integers(0, 1 << 63, int(rng.integers(1, 300))).astype(np.uint64), rng.choice(frequent, int(rng.integers(0, 40)))]))
        other = np.unique(np.concatenate([base[rng.random(len(base)) > rng.random() * 0.12], rng.integers(0, 1 << 63, int(rng.integers(0, len(base) // 8 + 2))).astype(np.uint64)]))
        common = len(np.intersect1d(base, other))
        if len(other) and 100 * common >= percent * (len(base) + len(other) - common):
            keys = [np.concatenate(partition_keys(s, percent, frequent)) for s in (base, other)]
            assert len(np.intersect1d(*keys))
            demands = [choose_matches(np.zeros(len(s)), len(s), percent) for s in (base, other)]
            prefixes = [np.sort(s)[: d[1]] for s, d in zip((base, other), demands, strict=True)]
            assert len(np.intersect1d(*prefixes)) >= min(d[0] for d in demands)
    assert least_common(10, 90) == 9 and least_common(11, 90) == 10
    heavy = np.concatenate([np.zeros(90), np.full(10, 50.0)])
    assert choose_matches(heavy[::-1], 100, 90)[0] > choose_matches(np.zeros(100), 100, 90, unlisted=0)[0]


def test_connected_components(spark):
    rng, links = random.Random(9), []
    links += [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 60)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(90)] + [(5, 5), (None, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passages(spark):
    rng = random.Random(4)
    prose = lambda n, s: " ".join(f"{s}{rng.randint(0, 99999)}" for _ in range(n))
    passage, line = prose(55, "p"), prose(60, "l")
    edited = line.split()
    edited[30] = "other"
    texts = {
        1: prose(100, "a") + " " + passage + " " + prose(70, "a"), 2: prose(33, "b") + " " + passage + " " + prose(20, "b"), 3: prose(400, "c"),
        4: prose(60, "d") + "\n" + line, 5: " ".join(edited) + "\n" + prose(80, "e"), 6: None, 7: "", 8: "be " * 200, 9: "be " * 300, 10: passage, 11: f"{line[::-1]}\n{line[::-1]}",
    }
    docs = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in texts.items()], "doc_id long, text string, start string, n_chars long")
    found = repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == {2, 5, 9, 10} and {(r.doc_id, r.kept_id) for r in found} == {(2, 1), (5, 4), (9, 8), (10, 1)}
    for r in found:
        assert len(texts[r.doc_id][r.start : r.end].split()) >= 26
    left = {r.doc_id: r for r in remove_passages(docs).collect()}
    assert left[3].text == texts[3] and left[6].text is None and left[5].text == texts[5].split("\n")[1]
    assert all(r.n_chars == len(r.text or "") for r in left.values()) and list(left[3].asDict()) == docs.columns
    assert repeated_passages(docs.limit(0)).count() == remove_passages(docs.limit(0)).count() == 0
    assert 1 - (1 - 0.8**2) ** tuned(80, 0.99, 2) >= 0.99 and cut("ab\ncd", [(0, 2)]) == "cd" and cut("ab", [(0, 2)]) == ""


def test_anchors_of_shared_words_agree():
    rng = np.random.default_rng(0)
    for _ in range(60):
        shared = rng.integers(0, 1 << 63, 50).astype(np.uint64)
        found = []
        for _ in range(2):
            before, after = (rng.integers(0, 1 << 63, int(n)).astype(np.uint64) for n in rng.integers(0, 80, 2))
            h = np.concatenate([before, shared, after])
            found.append(set(anchors(h, np.array([0, len(h)]), 26, 25)[1].tolist()))
        assert found[0] & found[1]


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] + [0.0] * 7), (403, [float("inf")] + [0.0] * 7), (404, []), (405, rows[0][1]), (406, rows[0][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in top_k(frame, frame.where("vec_id % 50 = 0"), seeds=20, chunk=64, query_block=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all()}
    assert set(got) == {i for i in whole if i % 50 == 0}
    for q, hits in got.items():
        assert hits == sorted(((i, int(v @ whole[q])) for i, v in whole.items() if i != q), key=lambda x: (-x[1], x[0]))[:5]
    assert len(top_k(frame.where("vec_id < 3"), frame.where("vec_id = 0")).collect()) == 2
    assert top_k(frame.limit(0), frame).count() == top_k(frame, frame.limit(0)).count() == 0


def test_search_prunes():
    rng = np.random.default_rng(2)
    vectors = np.floor(rng.normal(0, 50, (4000, 32)) * np.exp(rng.normal(0, 1, (4000, 1))))
    search = Search(np.arange(20), vectors[:20], rotation_of(vectors[:500]), 8, 5)
    search.add(np.arange(4000), vectors)
    assert search.products < 0.5 * 20 * 4000


def test_url_lists(spark):
    day = lambda s: F.lit(s).cast("date")
    entries = spark.createDataFrame(
        [("block", "bad.example.com", True, "add", "2024-01-10"), ("block", "bad.example.com", True, "remove", "2024-02-01"), ("block", "Example.net.", False, "add", "2024-01-01"), ("allow", "ok.example.net", True, "add", "2024-03-01"), ("block", "tie.org", None, "add", "2024-01-01"), ("block", "tie.org", None, "remove", "2024-01-01"), ("block", None, True, "add", "2024-01-01")],
        "list string, key string, exact boolean, action string, day string",
    ).select("list", "key", "exact", "action", F.col("day").cast("date").alias("effective_at"))
    cases = [
        ("http://user@BAD.example.com:80/x", "2024-01-09", False), ("http://bad.example.com/x", "2024-01-10", True), ("http://bad.example.com?x", "2024-01-31", True), ("http://bad.example.com", "2024-02-01", False),
        ("https://a.b.example.net./", "2024-05-05", True), ("https://ok.example.net/", "2024-02-02", True), ("https://ok.example.net/", "2024-03-01", False), ("https://notexample.net/", "2024-03-01", False),
        ("http://sub.bad.example.com/", "2024-01-15", False), ("http://tie.org/", "2024-06-01", False), (None, "2024-06-01", False), ("/relative", "2024-06-01", False), ("http://example.net", None, False),
    ]
    captures = spark.createDataFrame([(i, u, d, "clash") for i, (u, d, _) in enumerate(cases + cases[:1])], "i long, url string, day string, blocked string").withColumn("fetched_at", F.col("day").cast("date"))
    got = {r.i: r.blocked for r in evaluate(captures, entries).collect()}
    assert got == {i: b for i, (_, _, b) in enumerate(cases + cases[:1])}
    assert evaluate(captures.limit(0), entries).count() == 0
    assert {r.blocked for r in evaluate(captures, entries.limit(0)).collect()} == {False}
    assert spark.range(1).select(host_of(F.lit("HTTP://h.x/"))).first()[0] == "h.x" and day


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = spark.createDataFrame(stage(spark, before, SF).toArrow())
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= before.count()
    texts = {r.doc_id: r.text for r in kept.collect()}
    components = brute_components(texts, 5, 80)
    assert len({c for _, c in components.values()}) > 0.97 * len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_whole_shared_runs_go(spark):
    rng = random.Random(5)
    prose = lambda n, s: [f"{s}{rng.randint(0, 99999)}" for _ in range(n)]
    texts, runs = {}, {}
    for n, words in enumerate((50, 55, 60, 100)):
        for copies in range(4):
            a, run = 10 * (4 * n + copies), prose(words, "p")
            for i in range(a, a + 3):
                before, after = prose(rng.choice([0, 30, 45, 60]), "b"), prose(rng.choice([0, 30, 45, 60]), "a")
                texts[i] = " ".join(before) + "\n" * bool(before) + " ".join(run[:20]) + "\n" + " ".join(run[20:]) + " " * bool(after) + " ".join(after)
                runs[i] = (" ".join(run), i - a)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cuts = {r.doc_id: " ".join(texts[r.doc_id][r.start : r.end].split()) for r in repeated_passages(docs).collect()}
    assert cuts == {i: run for i, (run, copy) in runs.items() if copy}


def test_passages_of_few_distinct_words(spark):
    rng = random.Random(6)
    prose = lambda n, s: [f"{s}{rng.randint(0, 99999)}" for _ in range(n)]
    runs = ["one two three four five".split() * 12, [rng.choice("a b c d e f g h".split()) for _ in range(60)], prose(60, "p") + ["be"] * 100 + prose(60, "q")]
    texts = {10 * i + j: " ".join([*prose(80, "b"), *run, *prose(80, "a")]) for i, run in enumerate(runs) for j in range(3)}
    found = repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: texts[r.doc_id][r.start : r.end].split() for r in found} == {10 * i + j: run for i, run in enumerate(runs) for j in (1, 2)}


def test_passages_of_the_table_equal_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    planted = [w for t in list(texts.values())[:40] for w in t.split()[:3]][:70]
    texts |= {10**6 + i: " ".join([f"x{i}_{j}" for j in range(90)] + planted + [f"y{i}_{j}" for j in range(90)]) for i in range(3)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = collections.defaultdict(list)
    for r in repeated_passages(docs).collect():
        spans[r.doc_id].append((r.start, r.end))
    words = {i: [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for i, t in texts.items()}
    cuts = {i: [any(a <= s and e <= b for a, b in spans[i]) for _, s, e in w] for i, w in words.items()}
    first = {n: {} for n in (26, 50)}
    for n, held in first.items():
        for i in sorted(words):
            for j in range(len(words[i]) - n + 1):
                held.setdefault(tuple(w for w, _, _ in words[i][j : j + n]), (i, j))
    lines = {(i, m.start(), m.end()): m[0] for i in sorted(texts) for m in re.finditer("[^\n]+", texts[i]) if len(m[0].split()) >= 50}
    names = list(lines)
    near = brute_components(dict(enumerate(lines.values())), 5, 80)
    n_runs = 0
    for i, w in words.items():
        # Nothing else goes: each word is in a window of 26 words, or in a line like one, of an earlier document.
        may = [False] * len(w)
        for j in range(len(w) - 25):
            if first[26][tuple(x for x, _, _ in w[j : j + 26])][0] < i:
                may[j : j + 26] = [True] * 26
        for at, (_, c) in near.items():
            if names[at][0] == i and names[c][0] < i:
                may = [m or (names[at][1] <= s and e <= names[at][2]) for m, (_, s, e) in zip(may, w, strict=True)]
        assert not [x for x, m, c in zip(w, may, cuts[i], strict=True) if c and not m]
        # Shared runs of 50 words go whole, unless a still earlier document takes a part of them from both.
        for j in range(len(w) - 49):
            run = tuple(x for x, _, _ in w[j : j + 50])
            a, b = first[50][run]
            if a < i and max(len(set(run[x : x + 26])) for x in range(25)) > 2:
                n_runs += 1
                assert all(cuts[i][j : j + 50]) or (any(cuts[i][j : j + 50]) and any(cuts[a][b : b + 50]))
    assert n_runs >= 42
