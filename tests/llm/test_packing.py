"""Packing against the tokenizer itself and against plain best fit."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seqloom.llm import configurations, packing

SCHEMA = "doc_id long, text string, length int, sequence_id string, task int, number int"


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rng = np.random.default_rng(5)
    words = ["alpha", "beta's", "  gamma", "δέλτα", "1234", "…", "\n", "x" * 30, " ", "don't", "\tq"]
    made = [" ".join(rng.choice(words, rng.integers(1, 90))) for _ in range(120)]
    return [None, "", " ", "one", made[0], made[0], "z" * 3000, " ".join(rng.choice(words, 4000)), *made]


def test_whole_documents(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(5, "one"), (None, "two")]
    df = spark.createDataFrame([(*r, 1, "s", 2, 3) for r in rows], SCHEMA).repartition(4)
    capacity = 64
    made = packing.packed(df, capacity, with_ids=True)
    got = made.collect()
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    model = tokenizer()
    want = Counter()
    for d, t in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        first = len(ids) % capacity or min(capacity, len(ids))
        stops = list(range(first, len(ids) + 1, capacity))
        for k, stop in enumerate(stops):
            start = 0 if k == 0 else stops[k - 1]
            part = np.array(ids[start:stop], "<u4")
            want[d, k, start, stop - start, zlib.crc32(part.tobytes()), tuple(ids[start:stop])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert sum(n for _, n in parts) <= capacity
    counts = Counter(r.length for r in got)
    assert len(held) <= sum(r.times for r in configurations.best_fit([], dict(counts), capacity))
    whole = {r.sequence_id: r.ids for r in packing.sequences(made).collect()}
    assert {k: len(v) for k, v in whole.items()} == {k: sum(n for _, n in v) for k, v in held.items()}
    assert all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in got)


def test_nothing(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_text_in_parts():
    model, rng = tokenizer(), np.random.default_rng(2)
    for _ in range(60):
        text = "".join(rng.choice(list("ab 1'.\n\té　 s"), 200))
        cut = packing.parts(text, 20)
        assert "".join(cut) == text
        ids = [i for p in cut for i in model.encode(p, add_special_tokens=False).ids]
        assert ids == model.encode(text, add_special_tokens=False).ids
    assert packing.parts("x" * 100, 10) == ["x" * 100] and len(packing.parts("ab " * 100, 10)) > 20


def test_encoder_like_the_library(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, encode, rng = tokenizer(), packing.Encoder(path), np.random.default_rng(6)
    monkeypatch.setattr(packing, "KNOWN", 300)
    signs = [*"abcZ   \x27\x27\x27sdt.,!-19\n\t\r²½ªéßšΩжѣ", "'ll", "'ve", " the", "…", "́"]
    odd = [" ", " ", "日本", "🙂", "\x1c", "\x85", "<|endoftext|>", "͸"]
    texts = ["", "<|endoftext|>", "a<|endoftext|> b", "日本語", *("".join(rng.choice(signs + odd, n)) for n in rng.integers(1, 60, 1500))]
    texts += ["".join(rng.choice(signs, n)) for n in rng.integers(1, 200, 1500)]
    for t in texts:
        assert encode(t).tolist() == model.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("seed", range(6))
def test_plans(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(20, 300))
    low, high = [(1, capacity), (capacity // 4, capacity // 2), (capacity // 5, capacity - 1)][seed % 3]
    counts = Counter(rng.integers(max(low, 1), high + 1, int(rng.integers(1, 4000))).tolist())
    runs = configurations.planned(dict(counts), capacity)
    held = Counter()
    for r in runs:
        assert r.times > 0 and r.free == capacity - sum(r.lengths) >= 0
        for length in r.lengths:
            held[length] += r.times
    assert held == counts
    n = sum(r.times for r in runs)
    assert -(-sum(k * v for k, v in counts.items()) // capacity) <= n
    assert n <= sum(r.times for r in configurations.best_fit([], dict(counts), capacity))
    assert len(runs) <= 40 * capacity


def test_groups_and_limits():
    groups = configurations.grouped({9: 3, 8: 5, 5: 4}, 3)
    assert groups == [(9, [[9, 3], [8, 1]]), (8, [[8, 4]]), (5, [[5, 4]])]
    chosen = configurations.configurations([9, 8, 5], [4, 4, 4], 17)
    assert sum(t for _, t in chosen) == 6
    with pytest.raises(ValueError, match="capacity"):
        configurations.planned({0: 1}, 8)
    assert configurations.planned({}, 8) == []
