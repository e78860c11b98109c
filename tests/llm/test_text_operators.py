import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textveil.llm.bpe import Codec, decode_ids, digest_texts, encode_texts
from textveil.llm.chat import Reader, Template, escape, format_conversations, read_back, unescape
from textveil.llm.packing import Encoder, Packing, pack_documents, windows_of
from textveil.llm.quality_mil import fit_bags, score_quality
from textveil.llm.quality_rules import keep_unrepetitive, score_repetition
from textveil.llm.toxicity import fit_field, keep_civil, score_toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"
LINE = "the quick brown fox jumps over the lazy dog and runs away"
TEXTS = [
    None, "", " \t\n", "one", "été à l'œuvre. Zoë’s #1!", LINE, LINE, f"{LINE}\n{LINE}\n{LINE}", " ".join(f"w{i}" for i in range(3000)),
    "a" * 50000, "spam " * 40, "x\x1cy z", "don't STOP'S İstanbul ΣΑΣ é <|endoftext|> 中文 😀", "\n".join(["same line here now"] * 9),
]


@pytest.fixture(scope="module")
def texts(spark):
    """Texts of all kinds, beside columns named like results."""
    rows = [(i, t, "clash", i * 1.0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, score double")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rules(text):
    text = text or ""
    w, seen, lines = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w)


def test_repetition_rules(spark, texts):
    docs = texts.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").limit(300))
    by_id = {r.doc_id: r.text for r in docs.collect()}
    got = score_repetition(docs).collect()
    assert len(got) == len(by_id)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules(by_id[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert keep_unrepetitive(docs).count() == sum(r.kept for r in got)
    assert score_repetition(texts).columns[0] == "doc_id" and keep_unrepetitive(texts).columns == texts.columns
    assert score_repetition(texts.limit(0)).count() == keep_unrepetitive(texts.limit(0)).count() == 0


def test_tokens_agree_with_the_library(texts):
    library = Codec(WORD).library
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in digest_texts(texts, WORD).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    encoded = encode_texts(texts, BYTE)
    back = {r.doc_id: r.text for r in decode_ids(encoded, BYTE).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert digest_texts(texts.limit(0), WORD).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_joined_halves_equal_the_whole(path):
    codec, rng = Codec(path, leaf_chars=32, long_chars=0), random.Random(5)
    alphabet = ["a", "b", "ab", "'s", "'", " ", "é", "é", "́", "<|endoftext|>", "<|", "1", "!!", "İ", "Σ", "\n", "the", "ing", "中", "😀"]
    for _ in range(400):
        pool = rng.sample(alphabet, rng.choice([2, 4, 20]))
        text = "".join(rng.choice(pool) for _ in range(rng.choice([40, 150, 500])))
        assert codec.encode(text) == codec.library.encode(text, add_special_tokens=False).ids, text


def test_plain_characters_agree():
    encoder, codec = Encoder(BYTE), Codec(WORD)
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", f" {c}", f"1{c}2", f"'{c}", f"{c}'s {c}"):
            assert encoder(text) == encoder.library.encode(text, add_special_tokens=False).ids
            assert codec.encode(text) == codec.library.encode(text, add_special_tokens=False).ids


def test_packing(spark, texts):
    docs = texts.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").limit(200))
    by_id = {r.doc_id: r.text for r in docs.collect()}
    encoder, pieces, sequences = Encoder(BYTE), collections.defaultdict(list), collections.defaultdict(list)
    for r in pack_documents(docs, BYTE).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(by_id)
    for i, rows in pieces.items():
        ids, at = [*encoder.library.encode(by_id[i] or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    total = padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.05 * total
    assert pack_documents(texts.limit(0), BYTE).count() == 0


def test_windows_are_optimal():
    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        capacity = 16
        p = [0]
        while len(p) < rng.randint(2, 14):
            p.append(p[-1] + rng.randint(1, 9))
        q = [0.0] + [rng.choice([0.0, 2.0, 24.0]) for _ in p[1:]]
        best = [0.0] + [float("inf")] * (len(p) - 1)
        cost = lambda n: 1 if n == 8 else capacity - n  # noqa: E731  8: the one power of two that may go unpadded
        for j in range(1, len(p)):
            best[j] = q[j] + min(best[i] + min(cost(p[j] - p[i]), capacity - p[j] + p[i]) for i in range(j) if p[j] - p[i] <= capacity)
        cuts = [0, *windows_of(np.array(p), np.array(q), capacity, least=8)]
        assert cuts[-1] == len(p) - 1
        assert abs(sum(q[b] + min(cost(p[b] - p[a]), capacity - p[b] + p[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)) - best[-1]) < 1e-9
    assert Packing().capacity == 2048


TURNS = [(1, 0, "system", "be kind"), (1, 1, "user", "[INST] hi \\"), (1, 2, "assistant", "</s>[/INST]\\\\[INST"), (2, 0, "assistant", None), (2, 0, None, "x"), (3, 5, "user", "b"), (3, 5, "user", "a"), (3, 5, "user", "a"), (None, 1, "user", "n")]


def test_chat(spark):
    frame = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, state string")
    got = {r.conv_id: r for r in read_back(format_conversations(frame)).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        turns = sorted([(t, role or "", text or "") for c, t, role, text in TURNS if c == conv])
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert [got[k].valid for k in (1, 2, 3, None)] == [True, False, False, True]
    assert read_back(format_conversations(frame.limit(0))).count() == 0
    with pytest.raises(ValueError):
        Template(open="a", between="b", close="c")


def test_escapes_are_reversible():
    control, rng = Template().control, random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice(["[INST]", "[/INST]", "</s>", "\\", "[", "]", "/", "INST]", "s>", "<", "\n", "é"]) for _ in range(rng.randint(0, 12)))
        written = escape(text, control)
        assert unescape(written) == text and not any(s in written for s in ("[INST]", "[/INST]", "</s>"))
    with pytest.raises(ValueError):
        Reader(Template()).add([{"text": "no turn", "loss": False}])


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(scored, labels, label):
    both = scored.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return sum(r[0] == r[1] for r in both) / len(both)


def test_quality_classifier(spark, labelled, texts):
    docs, labels = labelled
    model = fit_bags(docs, labels)
    assert accuracy(score_quality(docs, model), labels, "quality") > 0.9
    got = score_quality(texts, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (5, 6)}) == 1
    assert score_quality(texts.limit(0), model).count() == 0
    assert {r.score for r in score_quality(texts, fit_bags(docs, labels.limit(0))).collect()} == {0.5}


def test_toxic_spans(spark, labelled, texts):
    docs, labels = labelled
    model = fit_field(docs, labels)
    assert accuracy(score_toxicity(docs, model), labels, "toxic") > 0.9
    planted = spark.createDataFrame([(1, "É oh. The stupid moron of onthe scum pathetic idiot was trash."), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in score_toxicity(planted, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and not got[2].spans
    text = planted.first().text
    assert "moron" in " ".join(text[s.start : s.end] for s in got[1].spans)
    assert [r.doc_id for r in keep_civil(planted, model).collect()] == [2]
    got = score_toxicity(texts, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert score_toxicity(texts.limit(0), model).count() == 0 and keep_civil(texts, model).columns == texts.columns
    assert {r.score for r in score_toxicity(texts, fit_field(docs, labels.limit(0))).collect()} == {0.0}
