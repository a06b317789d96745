"""The near-duplicate stage's groups against brute-force Jaccard over all pairs."""

import os

import numpy as np
import pytest

from rillstore.llm import pipeline, similar

SF = "/root/testdata/sf0.001"


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups_by_jaccard(texts):
    """The smallest id of each group."""
    ids = sorted(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if 10 * len(x & y) >= 8 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted({find(i) for i in ids})


def text(*words):
    return " ".join(words)


def made():
    """Texts around the threshold: many shingles changed far apart, and few changed in a text that is mostly shared."""
    base = [f"w{i}" for i in range(200)]
    out = {0: text(*base)}
    for k in range(1, 12):  # k words changed, five shingles each: 0.95 down to 0.57
        out[k] = text(*(f"x{k}-{i}" if i % 16 == 8 and i // 16 < k else w for i, w in enumerate(base)))
    other = [f"v{i}" for i in range(60)]
    for k in range(30):  # a common passage, and a chain of neighbours at 0.8 or more
        out[100 + k] = text(*other, *(f"y{k + j}" for j in range(40)))
    for k in range(30):  # the passage alone is not enough
        out[200 + k] = text(*other, *(f"z{k}-{j}" for j in range(40)))
    return out | {300: "", 301: None, 302: "one two", 303: "One  two", 304: "one two three"}


def check(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = pipeline.near_duplicates(spark, docs, None)
    assert sorted(r.doc_id for r in got.collect()) == groups_by_jaccard(texts)


def test_made(spark):
    check(spark, made())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_documents(spark):
    check(spark, {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})


BIG = "/root/testdata/sf0.1"


def similar_pairs(sets, percent=80):
    """All pairs of different sets with that Jaccard similarity, from the postings of every shingle."""
    number = {}
    rows = [np.array([number.setdefault(s, len(number)) for s in x], np.int64) for x in sets]
    order = np.argsort(np.concatenate(rows), kind="stable")
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[order]
    ends = np.cumsum(np.bincount(np.concatenate(rows), minlength=len(number)))
    starts, n = ends - np.diff(np.r_[0, ends]), np.array([len(r) for r in rows])
    for i, r in enumerate(rows):
        common = np.bincount(np.concatenate([of[starts[s] : ends[s]] for s in r.tolist()]), minlength=len(rows))
        for j in np.flatnonzero(100 * common >= percent * (n[i] + n - common)):
            if j > i:
                yield i, int(j)


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables")
def test_recall_and_precision_against_all_pairs(spark, capsys):
    """Over all 10,000 texts: of the pairs of different sets at 0.8 or more, the share that ends in one group; and no group holds what no chain of such pairs joins."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_set = {}
    for i, t in texts.items():
        by_set.setdefault(frozenset(shingles(t)), []).append(i)
    sets = [s for s in by_set if s]
    got = {r.i: r.root for r in similar.similar(docs).collect()}
    assert all(len({got[i] for i in ids}) == 1 for ids in by_set.values())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = list(similar_pairs(sets))
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    mine = [got[by_set[s][0]] for s in sets]
    found = sum(mine[a] == mine[b] for a, b in pairs)
    joined = {}
    for k, m in enumerate(mine):
        joined.setdefault(m, set()).add(find(k))
    with capsys.disabled():
        print(f"\n{len(pairs)} pairs at 0.8 or more, {found} found; {len(set(map(find, range(len(sets)))))} groups, {len(set(mine))} found")
    assert len(pairs) > 40 and found >= 0.9 * len(pairs) and all(len(x) == 1 for x in joined.values())
