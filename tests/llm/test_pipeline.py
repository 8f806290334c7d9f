"""The pipeline on the smallest tables, stage by stage, against plain Python."""

import hashlib
import os
import re

import numpy as np
import pytest

import corpus_pipeline
from convolake.llm import quality, simhash, vocab
from convolake.llm.common import cut

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF)))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "bpe"]


def test_quality_stage(spark, stages):
    scores = by_id(quality.quality(stages[0], spark.read.parquet(f"{SF}/labels.parquet")))
    assert set(by_id(stages[1])) == {i for i, r in scores.items() if r.score >= 0.5}


def test_near_dedup_stage(stages):
    docs = by_id(stages[1])
    sets = {i: simhash._shingles(r.text, 5) for i, r in docs.items()}
    group = {i: i for i in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            both = len(sets[a] & sets[b])
            if a < b and group[a] != group[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) > 0:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert set(by_id(stages[2])) == set(group.values())


def test_decontamination_stage(spark, stages):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    known = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        known |= {tuple(w[j : j + 13]) for j in range(max(1, len(w) - 12)) if w}
    keep = set()
    for i, r in by_id(stages[2]).items():
        w, hit = words(r.text), set()
        for n in {len(k) for k in known}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in known:
                    hit.update(range(j, j + n))
        if not hit or 20 * len(hit) < len(w):
            keep.add(i)
    assert set(by_id(stages[3])) == keep


def test_pii_stage(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    private = r"[a-z]+\.\d+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|password=\w+|AKIA\w{16}|token = \"\w+\""
    assert set(before) == set(after)
    for i, r in before.items():
        found = re.findall(private, r.text)
        assert all(x not in after[i].text for x in found)
        assert len(re.findall(r"\S+", r.text)) == len(re.findall(r"\S+", after[i].text)) and after[i].n_chars == len(after[i].text)


def test_bpe_stage(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocab.default_path())
    docs, out = by_id(stages[4]), by_id(stages[5])
    for i, r in docs.items():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
