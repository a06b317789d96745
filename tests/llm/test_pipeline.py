"""corpus_pipeline against a brute-force version, stage by stage."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from rillstore.llm import quality_bands
from rillstore.llm.queries import vocabulary

from .test_similar import groups_by_jaccard

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    have = {r.doc_id: r.text for r in docs.collect()}
    z = zstandard.ZstdCompressor(level=3)
    bands = quality_bands.calibrate(docs, spark.read.parquet(f"{SF}/labels.parquet"), least=20)
    # quality rules
    df = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    have = {i: t for i, t in have.items() if quality_bands.judge(t.encode(), z, bands)[-1]}
    assert df.columns == docs.columns and {r.doc_id: r.text for r in df.collect()} == have
    # line dedup
    df = corpus_pipeline.STAGES[1][1](spark, df, SF)
    seen, left = set(), {}
    for i in sorted(have):
        a = have[i].split("\n")
        gone = set()
        for p in range(len(a) - 2):
            w = tuple(a[p : p + 3])
            if w in seen and re.search(r"[^\x20\x09-\x0D]", "".join(w)):
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        t = "\n".join(x for p, x in enumerate(a) if p not in gone)
        if t or not gone:
            left[i] = t
    assert df.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in df.collect()} == {i: (t, len(t)) for i, t in left.items()}
    # near-duplicates
    df = corpus_pipeline.STAGES[2][1](spark, df, SF)
    kept = {i: left[i] for i in groups_by_jaccard(left)}
    assert df.columns == docs.columns and {r.doc_id: r.text for r in df.collect()} == kept
    # mixing: every copy is a whole document; no source is over its budget
    df = corpus_pipeline.STAGES[3][1](spark, df, SF)
    mixed = df.collect()
    assert df.columns == docs.columns and all(r.text == kept[r.doc_id] for r in mixed)
    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert sum(tokens(r.text) for r in mixed) <= sum(map(tokens, kept.values()))
    # BPE, and run() as a whole
    tk = Tokenizer.from_file(vocabulary())
    want = Counter()
    for r in mixed:
        e = tk.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_stages_of_odd_tables(spark):
    """Every stage by itself: null and repeated ids, null and empty texts, ties, a long text, clashing names, no rows."""
    good = " ".join(f"{w}{i}" for i, w in enumerate("river stone light paper wind garden road music".split() * 20))
    other = "\n".join(" ".join(f"{w}-{i}-{k}" for k, w in enumerate("one two three four five six seven".split())) for i in range(9))
    rows = [(1, good), (1, good), (2, good), (None, good), (None, other), (3, other), (4, None), (5, ""), (6, " \n\t"), (7, "\n".join(f"{good} {i}" for i in range(300)))]
    names = ["blocks", "need", "row", "kept", "key", "n", "i", "t", "root", "lines", "__key", "__row", "kept_text", "__n_removed", "a.b"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(i, t, None, "s", len(t or ""), *range(len(names))) for i, t in rows], schema)
    want = {"line dedup": 9, "SimHash near-dedup": 5, "mixing": 10, "BPE": 10}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        if name in want:
            assert len(got) == want[name], (name, [(r.doc_id) for r in got])
        if name != "BPE":
            assert out.columns == docs.columns and all(tuple(r[5:]) == tuple(range(len(names))) for r in got), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_quality_by_all_labels(spark, tmp_path):
    """The first stage's limits come from all documents labelled good: of 30 in a length class, a part would be too few to draw its limit in."""
    rnd, z, b = random.Random(8), zstandard.ZstdCompressor(level=3), quality_bands.Bands()
    word = lambda letters, most: "".join(rnd.choices(letters, k=rnd.randint(2, most)))
    good = {i: " ".join(word("etaoinshrdlu", 9) for _ in range(rnd.randint(130, 140))) for i in range(0, 60_000, 2_000)}
    litter = {60_000 + i: "".join(word("etaoinshrdlu", 4) + "### " for _ in range(110)) for i in range(10)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in {**good, **litter}.items()], "doc_id long, text string, lang string, source string, n_chars long")
    spark.range(60_000).selectExpr("id as doc_id", "1 as quality").write.parquet(f"{tmp_path}/labels.parquet")
    ratios = [len(t) / len(z.compress(t.encode())) for t in good.values()]
    top = next(k for k, x in enumerate(b.whole) if max(map(len, good.values())) <= x[0])
    assert {next(k for k, x in enumerate(b.whole) if len(t) <= x[0]) for t in [*good.values(), *litter.values()]} <= {top}, "one length class"
    limit = np.mean(ratios) + 5 * np.std(ratios)
    want = {i for i, t in {**good, **litter}.items() if len(t) / len(z.compress(t.encode())) <= limit}
    assert want == set(good) and all(quality_bands.judge(t.encode(), z, b)[-1] for t in litter.values())
    assert {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()} == want
