"""Hot keys, runs, hashes, clashing names and cuts: what must hold whatever the rows are."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textveil.llm import common, components
from textveil.llm.components import connected_components
from textveil.llm.jaccard_join import PAIRS, _prefix_pairs, _prefix_rows, _star_pairs, jaccard_components, keep_first, meta_of, shingle_sets, sketch, sketch_words
from textveil.llm.paragraph_dedup import cut, remove_passages, repeated_passages
from textveil.llm.quality_rules import score_repetition
from textveil.llm.topk import top_k
from textveil.llm.url_filter import evaluate
from test_joins import brute_components
from test_text_operators import rules


def thue_morse(n: int) -> tuple[str, str]:
    """Two different strings of 2**n letters for which sums of powers of any odd base, modulo 2**64, agree."""
    bits = [bin(i).count("1") & 1 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_no_two_words_or_lines_are_one_by_their_hash(spark):
    one, other = thue_morse(11)
    texts = {1: f"{one}\n{other}", 2: " ".join([one, *"bcdefgh"] * 2 + [other, *"bcdefgh"] * 2), 3: one, 4: other, 5: one, 6: "x " * 25 + one, 7: "x " * 25 + other}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in score_repetition(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules(texts[r.doc_id])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, k=3, percent=90).collect()}
    assert got == brute_components(texts, 3, 90)


def test_sketches_never_tell_more_than_the_difference():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 900))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.3], rng.integers(0, 1 << 63, int(rng.integers(0, 90))).astype(np.uint64)]))
        for words in (1, 2, 4, 8):
            apart = np.unpackbits(sketch(a, words) ^ sketch(b, words)).sum()
            assert apart <= len(np.setxor1d(a, b))
            if words > 1:
                whole = sketch(a, words).view("<u8")
                assert (whole[: words // 2] ^ whole[words // 2 :]).tobytes() == sketch(a, words // 2).tobytes()
    assert [sketch_words(n, 90) for n in (1, 228, 229, 500, 1000, 10**6)] == [1, 1, 2, 2, 4, 8]


def batches_of(columns, names, rows=100):
    table = pa.table(columns, names=names)
    return table.to_batches(max_chunksize=rows)


@pytest.mark.parametrize("run_rows", [150, 1 << 15])
def test_every_class_of_a_token_is_paired_or_marked(run_rows):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(900):
        own = list(base) if i % 2 else [f"v{rng.randint(0, 10**6)}" for _ in range(60)] + base[:3]
        own[rng.randrange(40, 60)] = f"e{i}"
        texts.append(" ".join(own))
    column = pa.array(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), column], ["id", "text"])
    rows = pa.Table.from_batches(_prefix_rows([batch], 3, 80, np.zeros(0, np.uint64), np.zeros(0))).to_pandas()
    rows = rows.sort_values(["token", "meta", "key"])
    sent = batches_of([pa.array(rows[c]) for c in rows], list(rows))
    out = pa.Table.from_batches(_prefix_pairs(iter(sent), 80, 64, 6, run_rows=run_rows)).to_pandas()
    marked, pairs = set(out[out.b.isna()].a), {(int(r.a), int(r.b)) for r in out[~out.b.isna()].itertuples()}
    assert [x.split()[0] for x in PAIRS.split(", ")] == list(out)
    sets = dict(zip(rows.key.drop_duplicates(), range(10**6), strict=False))
    assert len(sets) == len(texts) and len(pairs) <= 6 * len(rows)
    from textveil.llm.jaccard_join import class_keys

    own = [*shingle_sets(column, 3)]
    by_key = dict(zip(class_keys(own), own, strict=True))
    some = rng.sample(sorted(by_key), 150)
    for a in some:
        for b in some:
            common_ = len(np.intersect1d(by_key[a], by_key[b], assume_unique=True))
            if a < b and 100 * common_ >= 80 * (len(by_key[a]) + len(by_key[b]) - common_):
                assert (a, b) in pairs or (a in marked and b in marked)


@pytest.mark.parametrize("run_rows", [50, 1 << 15])
def test_stars_span_their_groups(run_rows):
    rng = np.random.default_rng(2)
    token = np.sort(np.concatenate([np.repeat(rng.integers(0, 1 << 60, 5), 300), np.repeat(rng.integers(0, 1 << 60, 80), 3), rng.integers(0, 1 << 60, 40)]))
    key = rng.integers(0, 1 << 62, len(token))
    rows = sorted(zip(token.tolist(), [int(meta_of(50, 0, 1))] * len(token), key.tolist(), strict=True))
    rows = [r for r in rows for _ in range(2)]  # tasks may send a class again
    sent = batches_of([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 2, 1)], ["token", "key", "meta"], 40)
    out = pa.Table.from_batches(_star_pairs(iter(sent), 80, 12, run_rows=run_rows)).to_pylist()
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in out:
        parent[root(r["a"])] = root(r["b"])
    groups = collections.defaultdict(set)
    for t, _, k in rows:
        groups[t].add(k)
    assert all(len({root(k) for k in g}) == 1 for g in groups.values())
    assert len(out) <= sum(len(g) + 3 for g in groups.values())


def test_hubs_are_looked_up(spark, monkeypatch):
    for module in (common, components):
        monkeypatch.setattr(module, "KEY_ROWS", 500)
    links = [(1, i) for i in range(2, 3000)] + [(5000 + i, 9000) for i in range(2000)] + [(9000, 2999)] + [(i, i + 1) for i in range(20000, 20040)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: 1 if x < 20000 else 20000 for a, b in links for x in (a, b)}
    rows = spark.createDataFrame([(7, i) for i in range(2000)] + [(i, i) for i in range(50)], "k long, v long")
    table = rows.groupBy("k").agg(F.max("v").alias("top"), F.count("*").alias("key_rows"))
    met = common.looked_up(rows, table, "k", rows.count())
    assert sorted(tuple(r) for r in met.select("k", "v", "top").collect()) == sorted((k, v, 1999 if k == 7 else k) for k, v in [(7, i) for i in range(2000)] + [(i, i) for i in range(50)])
    assert common.fresh("A", ["a", "a_"]) == "A__"


def test_many_exact_copies_and_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(common, "KEY_ROWS", 300)
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 500)}" for _ in range(80)]
    texts = [" ".join(words)] * 900
    for i in range(700):
        own = list(words)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(80)] = f"e{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(f"x{rng.randint(0, 10**6)}" for _ in range(80)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, k=3, percent=90).collect()}
    assert got == brute_components(dict(enumerate(texts)), 3, 90)
    assert keep_first(docs, k=3, percent=90).count() == sum(c == i for i, (_, c) in got.items())


def test_cuts_leave_other_lines_alone():
    text = "para one\n\npara two\n\nXX tail\n \nend"
    i = text.index("XX")
    assert cut(text, [(i, i + 3)]) == "para one\n\npara two\n\ntail\n \nend"
    assert cut("x\n\nPASS\n\ny", [(3, 7)]) == "x\n\n\ny" and cut("a b c d", [(0, 2), (4, 6)]) == "b d"
    assert cut("h P\nP t\nk", [(2, 5)]) == "h  t\nk" and cut("P\nk\n", [(0, 2)]) == "k\n"


def test_passages_beside_columns_of_any_name(spark):
    rng = random.Random(7)
    passage = " ".join(f"p{rng.randint(0, 99999)}" for _ in range(60))
    texts = {1: passage, 2: f"own words\n\n{passage}\n\nmore", 3: passage}
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in texts.items()], "doc_id long, text string, removals string, removal_id string, kept_id string")
    got = {r.doc_id: r for r in remove_passages(docs).collect()}
    assert set(got) == {1, 2} and got[2].text == "own words\n\n\nmore" and tuple(got[2])[2:] == ("a", "b", "c")


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_recall_of_edited_lines(spark, edits):
    """Lines of 60 to 90 words with single words changed: all pairs above the threshold, by exact Jaccard, against those found."""
    rng = random.Random(20 + edits)
    texts, links = {}, 0
    for f in range(60):
        words = [f"f{f}_{rng.randint(0, 10**6)}" for _ in range(rng.randint(60, 90))]
        edited = list(words)
        for _ in range(edits):
            edited[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        texts[2 * f], texts[2 * f + 1] = " ".join(words), " ".join(edited)
    true = brute_components(texts, 5, 80)
    wanted = {i for i, (_, c) in true.items() if c != i}
    docs = spark.createDataFrame([(i, f"head {i}\n{t}\ntail {i}") for i, t in texts.items()], "doc_id long, text string")
    spans = collections.defaultdict(int)
    for r in repeated_passages(docs).collect():
        spans[r.doc_id] += r.end - r.start
    whole = {i for i in wanted if spans[i] >= len(texts[i])}
    assert len(whole) >= 0.9 * len(wanted) and not [i for i in spans if i not in wanted and true[i][1] == i and i % 2 == 0]
    assert links == 0


def test_vectors_of_other_widths_take_no_part(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(300)] + [(300, [1.0] * 7), (350, [1.0]), (400, [0.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in rows if len(v) == 6}
    for block in (16384, 3):  # a block of all queries, and several blocks over a stored table
        got = collections.defaultdict(list)
        for r in top_k(frame, frame.where("vec_id % 50 = 0"), seeds=20, chunk=64, query_block=block).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert set(got) == {i for i in whole if i % 50 == 0}
        for q, hits in got.items():
            assert hits == sorted(((i, int(v @ whole[q])) for i, v in whole.items() if i != q), key=lambda x: (-x[1], x[0]))[:5]


def test_captures_with_columns_of_any_name(spark):
    entries = spark.createDataFrame([("block", "com", False, "add", "2024-01-01")], "list string, key string, exact boolean, action string, day string").select("list", "key", "exact", "action", F.col("day").cast("date").alias("effective_at"))
    taken = ["own_host", "best", "met_host", "met_time", "time", "key", "salt", "_host", "_best", "_time", "list"]
    captures = spark.createDataFrame([(f"http://h{i}.com/", "2024-02-02", *[f"{c}{i}" for c in taken]) for i in range(50)], ", ".join(f"`{c}` string" for c in ["url", "day", *taken])).withColumn("fetched_at", F.col("day").cast("date"))
    got = evaluate(captures, entries).collect()
    assert len(got) == 50 and all(r.blocked and r.matched_key == "com" and r["best"].startswith("best") and r["_host"].startswith("_host") for r in got)
