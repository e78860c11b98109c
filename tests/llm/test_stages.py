"""Each stage of the pipeline, on its own input, against a plain version of it."""

import collections
import math
import re
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from test_joins import brute_components

import corpus_pipeline
from textveil.llm.packing import Encoder
from textveil.llm.paragraph_dedup import repeated_passages
from textveil.llm.quality_rules import RepetitionRules
from textveil.llm.textblock import blocks
from textveil.llm.toxicity import Tokens, fit_field

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def inputs(spark):
    """What each stage gets, and what the last one gives: tables, and their rows by id."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(spark.createDataFrame(stage(spark, tables[-1], SF).toArrow()))
    return tables, [{r.doc_id: r.text or "" for r in t.collect()} for t in tables[:-1]]


def covered(words, k):
    n = collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return {j for i in range(len(words) - k + 1) if n[tuple(words[i : i + k])] > 1 for j in range(i, i + k)}


def unrepetitive(text):
    rules, words, seen, again = RepetitionRules(), re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    total = max(sum(map(len, words)), 1)
    for line in text.split("\n"):
        if own := re.findall(r"[^\x20\x09-\x0D]+", line):
            again += sum(map(len, own)) if line in seen else 0
            seen.add(line)
    if len(words) < rules.min_words or 100 * len(covered(words, rules.repeat_window)) > rules.max_repeat_percent * len(words):
        return False
    return again / total <= rules.max_line_share and all(sum(len(words[i]) for i in covered(words, k)) / total <= most for k, most in rules.ngram_limits.items())


def test_quality_rules(inputs):
    before, after = inputs[1][:2]
    assert after == {i: t for i, t in before.items() if unrepetitive(t)} and 0 < len(after) < len(before)


def toxicity(text, model):
    """A document's score by forward and backward sums of probabilities, word by word."""
    (block,) = blocks(pa.array([text]))
    tokens = Tokens(block, model.settings)
    move, p = [[math.exp(model.moves[a, b]) for b in (0, 1)] for a in (0, 1)], []
    for begin, length in zip(tokens.begin.tolist(), tokens.length.tolist(), strict=True):
        odds = [math.exp(model.bias + sum(float(model.weights[f[i]]) for f in tokens.features)) for i in range(begin, begin + length)]
        ahead = [[1.0, odds[0]]]
        for o in odds[1:]:
            now = [ahead[-1][0] * move[0][0] + ahead[-1][1] * move[1][0], (ahead[-1][0] * move[0][1] + ahead[-1][1] * move[1][1]) * o]
            ahead.append([x / sum(now) for x in now])
        back = [[1.0, 1.0]]
        for o in odds[:0:-1]:
            now = [move[s][0] * back[-1][0] + move[s][1] * o * back[-1][1] for s in (0, 1)]
            back.append([x / sum(now) for x in now])
        for a, b in zip(ahead, reversed(back), strict=True):
            p.append(a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]))
    w = model.document
    return 1 / (1 + math.exp(-(w[0] + w[1] * math.log(sum(p) + 1e-4) + w[2] * max(p, default=0.0))))


def test_toxicity(spark, inputs):
    before, after = inputs[1][1:3]
    model = fit_field(inputs[0][1], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {i: toxicity(t, model) for i, t in before.items()}
    assert set(after) == {i for i, s in scores.items() if s < model.settings.threshold} and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_ngram_jaccard_join(inputs):
    before, after = inputs[1][2:4]
    assert after == {i: before[i] for i, (_, c) in brute_components(before, 5, 80).items() if c == i} and len(after) < len(before)


def test_substring_dedup(inputs):
    before, after = inputs[1][3:5]
    spans = collections.defaultdict(list)
    for r in repeated_passages(inputs[0][3]).collect():  # held against brute force in test_joins
        spans[r.doc_id].append((r.start, r.end))
    expected = {}
    for i, text in before.items():
        marks = list(text)
        for a, b in spans[i]:
            marks[a:b] = [""] * (b - a)
        lines, at = [], 0
        for line in "".join(c if c else "\0" for c in marks).split("\n"):
            plain = line.replace("\0", "")
            if plain.strip() or "\0" not in line:
                lines.append(plain)
        expected[i] = "\n".join(lines)
        assert at == 0
    assert spans and after == {i: t for i, t in expected.items() if t.strip() or not spans[i]}
    first = {}
    for i in sorted(after):  # no run of 50 words is in two documents, unless it says one or two words over and over
        words = after[i].split()
        for j in range(len(words) - 49):
            run = tuple(words[j : j + 50])
            assert first.setdefault(run, i) == i or max(len(set(run[x : x + 26])) for x in range(25)) <= 2


def test_packing(inputs):
    texts, encoder, at = inputs[1][4], Encoder(public_tokenizers.path("byte_bpe_50k.json")), collections.defaultdict(int)
    ids = {i: [*encoder.library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    rows = sorted(inputs[0][5].collect(), key=lambda r: (r.doc_id, r.start))
    for r in rows:
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.doc_id][r.start : r.start + r.length]))
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    filled = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048
