"""Importance resampling against a plain version that puts every run of words together."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from convolake.llm import importance

SCHEMA = "doc_id long, text string, weight string, rank string, n string"


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target):
    s, t = Counter(), Counter()
    for text in docs.values():
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)}
    out, fit = {}, []
    for i, text in docs.items():
        words, found = features(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if len(words) >= 20:
            fit.append((-out[i][2], i))
    for place, (_, i) in enumerate(sorted(fit)[: 5 * len(fit) // 100]):
        out[i][3] = place + 1
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: rng.choice(["river", "Stone", "ÉCOLE", "中文", "x9", "under", "light", "İ", "K"]) + str(rng.randrange(30))
    out = {i: rng.choice([" ", "\n", ", ", "-"]).join(word() for _ in range(rng.randrange(60))) for i in range(300)}
    return out | {900: None, 901: "", 902: " \n.", 903: "a" * 3_000_000, 904: "long text " * 150_000, 905: "one two"}


def test_resample(spark, texts):
    target = [texts[i] for i in range(0, 40, 4)] + [None, "river1 stone2"]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts.items()], SCHEMA)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in importance.resample(docs, bench).collect()}
    want = plain(texts, target)
    assert got == want
    assert max(r[3] or 0 for r in want.values()) > 5
    ranked = importance.resample(docs, bench, percent=100)
    assert importance.drawn(docs, ranked).columns == docs.columns
    assert importance.drawn(docs, ranked).count() == sum(len(features(t)[0]) >= 20 for t in texts.values())


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + " more")], "doc_id long, text string")
    got = importance.resample(docs, docs, percent=100).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4] and {r.weight for r in got if r.doc_id == 1} == {r.weight for r in got if r.doc_id is None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    row = importance.resample(some, none).first()
    assert (row.n_features, row["rank"]) == (6, None)


def test_pieces_cut_no_word(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 7)
    text = "alpha beta gamma-delta  é中 epsilon " * 5
    found = [b for part, _ in importance.scan(text) for b in part.tolist()]
    assert sorted(found) == sorted(features(text)[1])
    assert [b for part, _ in importance.scan(text, n=1) for b in part.tolist()] == [zlib.crc32(w.encode()) % 10_000 for w in features(text)[0]]
