"""Windows of over 50 words that another document shares, against a plain count."""

import random
from collections import defaultdict

from convolake.llm import suffix_dedup


def plain(texts):
    seen = defaultdict(set)
    windows = []
    for i, t in enumerate(texts):
        w = (t or "").split()
        windows.append([tuple(w[j : j + 51]) for j in range(len(w) - 50)])
        for x in windows[-1]:
            seen[x].add(i)
    return [sum(len(seen[x]) > 1 for x in ws) for ws in windows]


def test_shared_windows(spark):
    rng = random.Random(5)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(n)]
    passages = [words(n) for n in (50, 51, 52, 60, 90, 200)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else words(rng.randrange(80))
        if rng.random() < 0.3:
            w[rng.randrange(len(w)) if w else 0 :] = words(3)
        texts.append(" ".join(w))
    once = words(70)
    texts += [None, "", "la " * 200, "la " * 120 + "end", " ".join(once + once), texts[0], texts[0]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_shared for r in suffix_dedup.remove_repeats(frame, passages=True).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)
    assert suffix_dedup.remove_repeats(frame.limit(0), passages=True).count() == 0
