"""Near duplicates of the pipeline come by bit-sliced fingerprints first, and none is lost."""

import random

from convolake.llm import simhash


def family(rng, n, words=60):
    """Texts around two others, some of which differ in a word or two, some in more."""
    bases = [[rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(words)] for _ in range(2)]
    out = []
    for k in range(n):
        t = list(bases[k % 2])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            t[rng.randrange(len(t))] = "x" + str(rng.randrange(30))
        out.append(" ".join(t))
    return out


def test_groups_come_by_fingerprints_first(spark, monkeypatch):
    rng = random.Random(9)
    texts = family(rng, 40) + family(rng, 150, 400) + ["", "one", "one two three four five"]
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda rows, *a: asked.append({(r.fp & (1 << 64) - 1, r.rep) for r in rows.select("fp", "rep").collect()}) or links(rows, *a))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(simhash._majority(simhash._hashes(simhash._shingles(t, 5))), i)
    assert asked == [set(first.items())]
    sets, group = [simhash._shingles(t, 5) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert got == dict(enumerate(group))
