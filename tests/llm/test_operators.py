"""The dealt operators on small corpora with nulls, empties, ties, copies and clashing columns, against brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rillstore.llm import bpe_transducer, chat_format, credentials, exact_dedup, line_dedup, masked_lm, quality_bands, queries, secret_grammar, simhash_vptree, suffix_dedup, temperature_mix
from rillstore.llm.common import components

from .helpers import DOC, corpus

SPACES = re.compile(r"[\x20\x09-\x0D]")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# 1


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, tmp_path, rows, weak):
    more = rows + [(None, "the same", "a", "x", "y"), (None, "thesame", "a", "x", "y"), (7, rows[7][1], "a", "x", "y")]
    p = str(tmp_path / "t")
    spark.createDataFrame(more, DOC).repartition(4).write.parquet(p)
    kw = {"digest": lambda c: F.substring(exact_dedup.sha256_of(c), 1, 1).bitwiseAND(F.lit(3)) if False else F.unhex(F.substring(F.hex(exact_dedup.sha256_of(c)), 1, 1))} if weak else {}
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, p, **kw).collect())
    groups = defaultdict(list)
    for r in more:
        groups[SPACES.sub("", r[1] or "")].append(r)
    want = Counter()
    for g in groups.values():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        first = [(-len(r[1] or ""), r[0]) for r in g].count((-len(best[1] or ""), best[0]))
        left = 1
        for r in g:
            same = (r[0], r[1]) == (best[0], best[1])
            want[(r[0], best[0], len(g), bool(same and left))] += 1
            left -= same and left
        assert first >= 1
    assert got == want


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    p, ck = str(tmp_path / "t"), str(tmp_path / "ck")
    spark.createDataFrame([(2, "a b"), (3, "c")], "doc_id long, text string").coalesce(1).write.parquet(p)
    exact_dedup.exact_dedup(spark, p, checkpoint=ck).collect()
    spark.createDataFrame([(1, "ab"), (4, "a  b")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(p)
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark, p, checkpoint=ck).collect()}
    assert got == {(1, 4, 3), (2, 4, 3), (4, 4, 3), (3, 3, 1)}
    # a file that is years older than the others counts all the same
    spark.createDataFrame([(0, "a   b"), (None, None)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(p)
    newest = max((f for f in os.listdir(p) if f.endswith(".parquet")), key=lambda f: os.stat(f"{p}/{f}").st_mtime_ns)
    os.utime(f"{p}/{newest}", (1e9, 1e9))
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark, p, checkpoint=ck).collect()}
    assert got == {(0, 0, 4), (1, 0, 4), (2, 0, 4), (4, 0, 4), (3, 3, 1), (None, None, 1)}
    again = exact_dedup.exact_dedup(spark, p, checkpoint=ck)  # nothing new: the same rows, none twice
    assert again.count() == 6 and {(r.doc_id, r.keep_id, r.group_size) for r in again.collect()} == got
    assert exact_dedup.as_pattern("/a/b*c/d") == "/a/b\\*c/[d]"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "e")).count() == 0


# 2


def test_chat_format(spark):
    t = chat_format.Template()
    probe = "</s>[INST] ok [/INST]"
    texts = [probe, "", None, t.controls[0], "", "1<0s>", "a</s", "<", "[INST", "<<SYS>> x <</SYS>>", "$1\\ \n", "<<TEXT>>"]
    rnd, rows = random.Random(1), []
    for c in range(60):
        for k in range(rnd.randint(1, 6)):
            rows.append((c, k, rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "<s> odd"]), rnd.choice(texts), "z"))
    rows += [(100, k, r, "t", "z") for k, r in enumerate(["system", "user", "assistant", "user"])] + [(101, k, r, "t", "z") for k, r in enumerate(["user", "user"])] + [(None, None, "user", "x", "z")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid string")
    out = chat_format.format_chats(df)
    out = out.select("conv_id", "formatted", "segments", "valid", "bad_turn", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("segments")).alias("loss")).withColumn("read_loss", chat_format.loss_text(F.col("turns")))
    got = {r.conv_id: r for r in out.collect()}
    by = defaultdict(list)
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[1], r[2])) + (r[3] or "",)
    for r in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""), r[3] or "")):
        by[r[0]].append((r[2] or "", r[3] or ""))
    assert key and got.keys() == by.keys()
    for c, turns in by.items():
        assert [(x.role, x.text) for x in got[c].turns] == turns, c
        assert got[c].loss == got[c].read_loss == "".join(x for r, x in turns if r == "assistant")
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
    assert got[100].valid and not got[101].valid and got[101].bad_turn == 1
    assert chat_format.format_chats(df.limit(0)).count() == 0


# 3


def brute_components(fps, radius=3):
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs, rows, none):
    def slow(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = {r[0]: slow(r[1]) for r in rows}
    want = brute_components(fps)
    for shard, most in ((1024, 20_000), (8, 20_000), (8, 3)):
        got = simhash_vptree.near_dedup(docs, shard=shard, max_shard=most).collect()
        assert {r.doc_id: (r.fingerprint % (1 << 64), r.component_id) for r in got} == {i: (fps[i], want[i]) for i in fps}
    assert simhash_vptree.near_dedup(none).count() == 0
    kept = simhash_vptree.keep_one(docs, shingle=3)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_vantage_join_and_divided_shards(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False))) for b in base for _ in range(20)]
    x = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    a, b = simhash_vptree.Forest(len(x)), simhash_vptree.Forest(len(x))
    simhash_vptree.vantage_join(x, 3, a)
    simhash_vptree._brute(x, np.arange(len(x)), np.arange(len(x)), 3, b)
    assert (a.label == b.label).all()
    classes = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "__fp long")
    want = brute_components({int(v): int(v) % (1 << 64) for v in x.view(np.int64)})
    for shard, most in ((1024, 20_000), (16, 20_000), (16, 10)):
        got = {r.node: r.root for r in components(simhash_vptree.links(classes, 3, shard, most)).collect()}
        assert {v: got.get(v, v) for v in want} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (200, 300), (5, 5)] + [(1000, k) for k in range(1001, 1200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100, **{k: 1000 for k in range(1000, 1200)}}


# 4


def test_secret_base_and_scan(docs, rows, none):
    def slow(t):
        kw = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        out = [(m.start(), 0, m.end()) for m in re.finditer(kw + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])

    got = {r.doc_id: r for r in secret_grammar.scan(docs).collect()}
    for r in rows:
        base = slow(r[1] or "")
        assert got[r[0]].base_spans == secret_grammar.joined(base)
        assert set(filter(None, got[r[0]].base_spans.split(","))) <= set(filter(None, got[r[0]].spans.split(",")))
        assert (got[r[0]].n_assign, got[r[0]].n_access, got[r[0]].n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
    assert secret_grammar.scan(none).count() == 0
    for t in ("apikey=abc def token: x secret='aaaaaaa", "toKen=abcdefgh", "password=ab password=abcdefgh", "ſecret=abcdefgh", "é" * 30 + "AKIA" * 9):
        assert secret_grammar.base_spans(t) == slow(t)


def test_grammar_learns_formats():
    grammars = secret_grammar.infer(tuple(credentials.labelled()))
    # merged, but not to nothing: prefixes and lengths are states of their own
    states = {k: len(v) for k, v in grammars.items()}
    assert states["github"] == 41 and states["jwt"] < 100 and sum(states.values()) < 1000 and sum(n > 20 for n in states.values()) >= 9
    each = lambda s: secret_grammar.likelihood(s, grammars["github"]) / len(s)
    right = each("ghp_" + "a1B2" * 9)
    assert all(each(s) < right - 0.1 for s in ("ghq_" + "a1B2" * 9, "ghp_" + "a1B2" * 8, "ghp_" + "a1B2" * 10, "ghp-" + "a1B2" * 9))
    rnd = random.Random(2)
    for _ in range(20):  # merging never loses a count
        tree = secret_grammar.Automaton()
        values = ["".join(rnd.choices("abc", k=rnd.randint(1, 6))) for _ in range(200)]
        for v in values:
            tree.add(v)
        got = tree.merge_states(0.05)
        assert got.total[got.find(0)] >= 200 and sum(got.uses[q][-1] for q in got.states()) == 200


def test_scan_finds_keys_that_no_pattern_matches(spark):
    """Held-out values of every format planted in prose, one to a document, against documents without."""
    rnd = random.Random(12)
    prose = lambda: " ".join("".join(rnd.choices("etaoinshrdlucmfw", k=rnd.randint(2, 9))) for _ in range(80))
    rows, planted = [], {}
    for i, (_, value) in enumerate(credentials.labelled(20, seed=77)):
        a, b = prose(), prose()
        lead = rnd.choice([" ", ' key "', "\n", " (", "\u4e2d"])
        text = a + lead + value + rnd.choice([" ", '" ', "\n", ") ", "\u00e9"]) + b
        if not secret_grammar.base_spans(text):
            planted[i] = (len(a) + len(lead), len(a) + len(lead) + len(value))
        rows.append((i, text))
    clean = ["pneumonoultramicroscopicsilicovolcanoconiosis", "https://www.example.org/some/longer/path/to/a-page.html?x=12", "=" * 60, "-" * 60, "20240131123000000000", "some_snake_case_name_of_a_function", "2024-01-31T12:30:00.000000", "....................", "____________________"]
    rows += [(1000 + k, f"{prose()} {x} {prose()}") for k, x in enumerate(clean * 20)] + [(2000 + k, prose()) for k in range(300)]
    rows += [(None, None), (None, ""), (3000, "q" * 300_000), (3000, "ghp_" + "aB3" * 12 + " " + "word " * 100_000)]
    got = defaultdict(list)
    for r in secret_grammar.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r.doc_id].append([tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("model")])
    assert len(planted) >= 180 and sum(got[i] == [[x]] for i, x in planted.items()) >= 0.9 * len(planted)
    assert sum(len(x) for i, xs in got.items() if i is not None and 1000 <= i < 3000 for x in xs) <= 5
    assert got[None] == [[], []] and sorted(got[3000]) == [[], [(0, 40)]]


# 5


def test_quality(docs, rows, none):
    got = {r.doc_id: r for r in quality_bands.measure(docs).collect()}
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = Counter(grams)
        marked = {k + d for k, g in enumerate(grams) if many[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:k] for k, x in enumerate(lines)), len(marked))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and not (r.base_failed and r.kept)
    kept = quality_bands.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_bands.measure(none).count() == 0 and quality_bands.keep(none).count() == 0


def test_compression_bands():
    import zstandard

    z, b, rnd = zstandard.ZstdCompressor(level=3), quality_bands.Bands(), random.Random(1)
    prose = " ".join("".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 9))) for _ in range(900)).encode()
    noise = rnd.randbytes(6000)
    assert quality_bands.band_ratios(prose, z, b)[2] and not quality_bands.band_ratios(noise, z, b)[2] and not quality_bands.band_ratios(b"spam " * 800, z, b)[2]
    # half of a text repeats: the whole may pass, its chunks do not
    assert quality_bands.band_ratios(prose[:3000] + b"ab " * 1500, z, b)[1] > 0.3
    assert b"".join(quality_bands.chunks(prose, 2048)) == prose


def test_verdict(docs, rows):
    """kept, zstd_ratio and bad_chunk_share against a plain reading of the rules."""
    import zstandard

    rnd = random.Random(5)
    texts = {r[0]: (r[1] or "") for r in rows}
    prose = lambda n: " ".join("".join(rnd.choices("etaoinshrdlucmfw", k=rnd.randint(2, 9))) for _ in range(n))
    texts |= {1000 + k: prose(n) for k, n in enumerate((49, 50, 60, 400, 2000, 20_000))}
    texts |= {2000: prose(600) + " x" * 3000, 2001: "".join(rnd.choices("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/ ", k=9000)), 2002: "spam and eggs " * 400, 2003: prose(30_000) + "a b c d " * 9000}
    df = docs.sparkSession.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_bands.measure(df).collect()}
    ratio = lambda b: len(b) / len(zstandard.compress(b, 3))
    bands = quality_bands.Bands()
    seen = set()
    for i, t in texts.items():
        b, r = t.encode(), got[i]
        inside, share = True, 0.0
        if b:
            low, high = next(x[1:] for x in bands.whole if len(b) <= x[0])
            inside = low <= ratio(b) <= high
            assert abs(r.zstd_ratio - ratio(b)) < 0.02 * ratio(b)
        if len(b) > 2048:
            n = len(b) // 2048 + (len(b) % 2048 >= 1024)
            cut = [b[2048 * k : 2048 * (k + 1) if k < n - 1 else None] for k in range(n)]
            low, high, most = next(x[1:] for x in bands.chunks if len(b) <= x[0])
            share = sum(not low <= ratio(c) <= high for c in cut) / n
            inside = inside and share <= most
        assert r.bad_chunk_share == share and r.kept == (inside and not r.base_failed), i
        seen.add((r.base_failed, r.kept))
    assert len(seen) == 3


def test_calibrated_bands(spark, none):
    rnd = random.Random(4)
    prose = lambda: " ".join("".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 9))) for _ in range(rnd.randint(150, 300)))
    rows = [(i, prose(), "a", "x", "y") for i in range(150)] + [(None, prose(), "a", "x", "y"), (900, None, "a", "x", "y")]
    litter = [(1000 + i, "".join(w + rnd.choice(["### ", "$$$ ", "%%% "]) for w in prose().split()), "a", "x", "y") for i in range(40)]
    docs = spark.createDataFrame(rows + litter, DOC)
    labels = spark.createDataFrame([(i, 1) for i in range(150)] + [(900, 1), (None, 1)] + [(1000 + i, 0) for i in range(40)], "doc_id long, quality int")
    bands = quality_bands.calibrate(docs, labels)
    assert all(a[1] == b[1] and a[2] <= b[2] for a, b in zip(bands.whole, quality_bands.Bands().whole, strict=True)) and bands != quality_bands.Bands()
    got = {r.doc_id: r.kept for r in quality_bands.measure(docs, bands=bands).collect()}
    assert all(got[i] for i in range(150)) and sum(not got[1000 + i] for i in range(40)) >= 8
    assert quality_bands.calibrate(none, labels) == quality_bands.calibrate(docs, labels.limit(0)) == quality_bands.Bands()


def test_limits_of_all_labelled_texts(spark, tmp_path):
    """Of 60,000 ids labelled good, every one that has a text counts: op5's verdict and the limits against a plain reading."""
    import zstandard

    rnd, z, b = random.Random(6), zstandard.ZstdCompressor(level=3), quality_bands.Bands()
    texts = {}
    for i in range(0, 60_000, 250):
        words = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 9))) for _ in range(rnd.randint(55, 300))]
        texts[i] = "".join(w + (rnd.choice(["# ", "$$ "]) if rnd.random() < i / 90_000 else " ") for w in words)
    bad = {60_000 + i: "".join("".join(rnd.choices("etaoin", k=rnd.randint(2, 4))) + "### " for _ in range(rnd.randint(100, 300))) for i in range(40)}
    spark.createDataFrame([*texts.items(), *bad.items(), (None, texts[0]), (70_000, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(60_000).selectExpr("id as doc_id", "1 as quality").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    seen = {}
    for t in texts.values():
        raw = t.encode()
        if not quality_bands.judge(raw, z, b)[5]:
            seen.setdefault(next(k for k, x in enumerate(b.whole) if len(raw) <= x[0]), []).append(len(raw) / len(z.compress(raw)))
    want = [min(x[2], np.mean(seen[k]) + 5 * np.std(seen[k])) if len(seen.get(k, [])) >= 20 else x[2] for k, x in enumerate(b.whole)]
    bands = quality_bands.calibrate(docs, labels)
    assert np.allclose([x[2] for x in bands.whole], want, rtol=0, atol=1e-6) and sum(w < x[2] for w, x in zip(want, b.whole, strict=True)) >= 3
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    got = sorted(queries.op5_quality_rules(spark, str(tmp_path)).collect(), key=key)
    assert got == sorted(quality_bands.measure(docs, bands=bands).collect(), key=key) and len(got) == len(texts) + len(bad) + 2
    every = {**texts, **bad, None: texts[0], 70_000: ""}
    plain = {i: quality_bands.judge(t.encode(), z, replace(b, whole=tuple((*x[:2], h) for x, h in zip(b.whole, want, strict=True))))[-1] for i, t in every.items()}
    assert {r.doc_id: r.kept for r in got} == plain and any(plain[i] for i in texts) and not all(plain[i] for i in bad)


# 6


def test_suffix_dedup(spark, rows, none):
    more = rows + [(5, rows[5][1], "a", "x", "y"), (None, "null id, and long enough to hold windows of its own: " * 3, "a", "x", "y"), (900, "z" * 700, "a", "x", "y"), (901, "y" * 50 + "z" * 120, "a", "x", "y")]
    for width in (100, 36):
        seen, want = set(), {}
        for i, t in sorted({(r[0], r[1] or "") for r in more}, key=lambda x: (x[0] is not None, x[0] or 0)):
            b = t.encode()
            m = bytearray(len(b))
            for j in range(len(b) - width + 1):
                if (w := b[j : j + width]) in seen:
                    m[j : j + width] = b"\1" * width
                seen.add(w)
            want[i] = (len(b), sum(m), sum(1 for j in range(len(m)) if m[j] and (not j or not m[j - 1])), sha(bytes(x for x, y in zip(b, m) if not y)))
        for shard, bound in ((6_000_000, 1 << 18), (900, 64)):
            out = suffix_dedup.suffix_dedup(spark.createDataFrame(more, DOC).repartition(5), width=width, shard_bytes=shard, bound=bound, with_kept=True).collect()
            assert len(out) == len(more)
            for r in out:
                assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] and sha(bytes(r.kept)) == r.kept_sha256, (r.doc_id, width)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_regions_of_a_long_text_in_parts():
    rnd = random.Random(4)
    src = rnd.randbytes(3000)
    raw = src + b"-" + src[:900] + rnd.randbytes(400) + src[500:]
    whole = lambda raw, chunk: [(s + k, o) for b in suffix_dedup._make_regions(100, chunk)(iter([pa.RecordBatch.from_pydict({"raw": [raw], "id": [1], "key": [2]})])) for o, s, n in zip(b["owner"].to_pylist(), b["start"].to_pylist(), b["windows"].to_pylist()) for k in range(n)]
    got = sorted(p for p, _ in whole(raw, 700))
    assert got == list(range(len(raw) - 99))  # every window once


# 7


def test_line_dedup(spark, rows, none):
    more = rows + [(3, rows[3][1], "a", "x", "y"), (None, "q\nw\ne\nr", "a", "x", "y"), (500, "q\nw\ne", "a", "x", "y")]
    seen, want = {}, {}
    for i, t in sorted({(r[0], r[1]) for r in more if r[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        a = t.split("\n")
        gone = set()
        for p in range(len(a) - 2):
            w = tuple(a[p : p + 3])
            if not SPACES.sub("", "".join(w)):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.setdefault(w, 1)
        want[i] = (len(a), len(gone), "\n".join(x for p, x in enumerate(a) if p not in gone))
    df = spark.createDataFrame(more, DOC).repartition(4)
    out = line_dedup.dedup_lines(df).collect()
    assert len(out) == len(more)
    for r in out:
        assert (r["__n_lines"], r["__n_removed"], r["kept_text"]) == (want[r.doc_id] if r.text is not None else (0, 0, None)), r.doc_id
    assert line_dedup.dedup_lines(none).count() == 0


# 8


def test_few_files(spark, monkeypatch):
    """The narrow rows of 16 partitions, of unknown number, are one scratch file: for each file an executor starts two processes or more."""
    files = []
    monkeypatch.setattr(temperature_mix, "drop", lambda *tables: files.extend(len(t.inputFiles()) for t in tables))
    df = spark.range(400, numPartitions=16).selectExpr("id as doc_id", "concat('s', id % 3) as source", "repeat('a b ', 1 + id % 5) as text")
    got = temperature_mix.mix(df).collect()
    assert files == [1] and {r.doc_id for r in got} <= set(range(400)) and len(got) > 300


def plain_budgets(per, part=0.95, most=4.0, budget=None):
    """Tokens for each source, in plain Python."""
    total = sum(per.values())
    budget = budget or total

    def w(a):
        z = sum((m / total) ** a for m in per.values())
        return {s: (n / total) ** a / z for s, n in per.items()}

    def meet(f, goal, low, high):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) > goal else (low, mid)
        return (low + high) / 2

    a = 1.0
    if len(per) > 1:
        a = meet(lambda a: -sum(x * math.log(x) for x in w(a).values()), part * math.log(len(per)), 0.0, 1.0)
        repeats = lambda a: max(x * budget / per[s] for s, x in w(a).items())
        if repeats(a) > most and budget <= most * total:
            a = meet(repeats, most, a, 1.0)
    exact = {s: x * budget for s, x in w(a).items()}
    out = {s: math.floor(x) for s, x in exact.items()}
    for s in sorted(out, key=lambda s: (out[s] - exact[s], s is None, s or ""))[: budget - sum(out.values())]:
        out[s] += 1
    return out


def test_mixture(spark, docs, rows, none):
    n = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    per = Counter()
    for r in rows:
        per[r[2]] += n[r[0]]
    total = sum(per.values())
    want = plain_budgets(dict(per))
    assert sum(want.values()) == total
    for block in (1 << 20, 40):
        out = temperature_mix.mix(docs, block_tokens=block).collect()
        got, times = Counter(), defaultdict(list)
        for r in out:
            got[r.source] += r["__n_tokens"]
            times[r.doc_id].append(r["__pass"])
            assert r["__n_tokens"] == n[r.doc_id] and r.kept == "x"
        most = max(n.values())
        for s in per:
            assert want[s] - most < got[s] <= want[s], (s, block)
            whole = want[s] // per[s]
            for r in rows:
                if r[2] == s:
                    assert sorted(times[r[0]]) in (list(range(whole)), list(range(whole + 1)))
        assert sorted(map(str, out)) == sorted(map(str, temperature_mix.mix(docs.repartition(5), block_tokens=block).collect()))
    assert temperature_mix.mix(none).count() == 0


def test_mixture_cases(spark):
    """Clashing names, null ids, repeated rows, and a text of a million words."""
    names = ["doc_id", "text", "source", "blocks", "need", "__h", "__src", "row", "block", "__pass"]
    rows = [(None, "a b c", "s", 1, 2, 3, "x", "y", "z", 9)] * 3 + [(k, "a b c d", "s", 1, 2, 3, "x", "y", "z", 9) for k in (4, 4, 5)] + [(6, "w " * 1_000_000, "t", 1, 2, 3, "x", "y", "z", 9), (7, None, None, 1, 2, 3, "x", "y", "z", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, blocks int, need int, __h int, __src string, row string, block string, __pass int")
    out = temperature_mix.mix(df, budget=2_000_042, entropy_part=0.01)
    assert out.columns == [c for c in names if c != "__pass"] + ["__n_tokens", "__pass", "__block", "__rank"]
    got = out.collect()
    assert {(r.blocks, r.need, r["__h"], r["__src"], r.row, r.block) for r in got} == {(1, 2, 3, "x", "y", "z")}
    assert Counter(r.doc_id for r in got if r["__pass"] == 0) == {None: 3, 4: 2, 5: 1, 6: 1}
    assert temperature_mix.mixture(df, entropy_part=0.01).select("row.*").columns == names


def test_budgets_of_any_number_of_sources(spark):
    def got(per, **kw):
        df = spark.createDataFrame([(s, n) for s, n in per.items()], "__s string, __n long").repartition(4)
        rows = temperature_mix.plan(df, kw.get("part", 0.95), kw.get("most", 4.0), kw.get("budget"), 100).collect()
        return {r["__s"]: r.budget for r in rows}

    for per in ({"a": 1000, "b": 10, "c": 10}, {"a": 7}, {None: 5, "a": 5, "b": 5}, {f"s{k:03}": 1 + k % 7 for k in range(300)}):
        for kw in ({}, {"budget": 1009}):
            assert got(per, **kw) == plain_budgets(per, **kw), per
    many = {f"s{k:06}": 1 + k % 3 for k in range(120_000)}
    out = got(many, budget=300_000)
    assert len(out) == 120_000 and sum(out.values()) == 300_000 and out == plain_budgets(many, budget=300_000)


# 9

pt = pytest.importorskip("public_tokenizers")


def test_bpe_matches_the_library(docs, rows, none):
    from tokenizers import Tokenizer

    path = pt.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    for words in (3, 5000):
        got = {r.doc_id: r for r in bpe_transducer.encode_decode(docs, path, lexicon_words=words, with_ids=True).collect()}
        for i, t, *_ in rows:
            ids = tk.encode(t or "", add_special_tokens=False).ids
            assert got[i].ids == ids and got[i].n_tokens == len(ids)
            assert got[i].decoded == tk.decode(ids, skip_special_tokens=False) and got[i].decoded_sha256 == sha(got[i].decoded)
            assert got[i].ids_sha256 == sha(np.array(ids, "<u4").tobytes())
    assert bpe_transducer.encode_decode(none, path).count() == 0


def test_bpe_words_and_lexicon(tmp_path):
    from tokenizers import Tokenizer

    path = pt.path("byte_bpe_50k.json")
    tk, m, rnd = Tokenizer.from_file(path), bpe_transducer.Merger(path), random.Random(6)
    for w in ["a" * 5000, "ab" * 700, "é" * 300, *("".join(rnd.choices("abcdeéß漢", k=rnd.randint(1, 90))) for _ in range(300))]:
        if bpe_transducer.split_words([w], bpe_transducer._classes(path), [])[1][0] == 1:
            assert m.merge(w.encode()) == tk.encode(w, add_special_tokens=False).ids
    words = sorted({"".join(rnd.choices("abc", k=rnd.randint(1, 8))).encode() for _ in range(900)})
    lex = bpe_transducer.Lexicon(bpe_transducer.compile_lexicon((w, [k, k + 1]) for k, w in enumerate(words)))
    assert lex.numbers(words).tolist() == list(range(len(words)))
    held = set(words)
    other = [w for w in ("".join(rnd.choices("abcd", k=rnd.randint(1, 9))).encode() for _ in range(900)) if w not in held]
    assert (lex.numbers(other) == -1).all()
    assert len(lex.final) < sum(map(len, words)) / 4  # suffixes are shared
    al = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", " ", "　", "a", "é", "1", "٣", "!", "<|endoftext|>", "<|", "漢", "😀", "\x1c", "\x85", "S"]
    texts = ["".join(rnd.choices(al, k=rnd.randint(0, 14))) for _ in range(4000)]
    enc = bpe_transducer.Encoder(m, lex, bpe_transducer._classes(path), most=500)
    enc.lexicon = bpe_transducer.Lexicon(bpe_transducer.compile_lexicon([]))
    for part in (texts[:2000], texts[2000:]):
        for t, ids in zip(part, enc.encode(part), strict=True):
            assert ids.tolist() == tk.encode(t, add_special_tokens=False).ids, t


# 10


def test_masked_lm(spark, none):
    rnd = random.Random(8)
    a, b = ([f"{p}{i}" for i in range(30)] for p in "xy")
    text = lambda v: " ".join(rnd.choices(v, k=80))
    net = masked_lm.Network(side=16, dim=8, batch=64, mask=0.5, rounds=6, rate=0.3)
    train = [(i, text(a if i % 2 else b)) for i in range(300)] + [(300, None), (301, ""), (None, "x1 x2"), (7, "x1"), (7, "x1")]
    df = spark.createDataFrame([(*r, 1, 2) for r in train], "doc_id long, text string, log_prob int, word int").repartition(3)
    words, flat = masked_lm.fit(df, net=net, sized=False)
    p = words.net.unpack(flat)
    mean = lambda texts: sum(masked_lm.log_probs([t.encode() for t in texts], words, p)[1]) / (80 * len(texts))
    held = [text(a) for _ in range(20)] + [text(b) for _ in range(20)]
    assert mean(held) > -np.log(60) + 0.3  # beats one word in sixty: the sides tell which half the word is from
    mixed = [" ".join(rnd.choices(a + b, k=80)) for _ in range(40)]
    assert mean(held) > mean(mixed) + 0.2
    out = [tuple(r) for r in masked_lm.score(df, (words, flat)).collect()]
    got = {r[0]: r for r in out}
    assert len(out) == 305 and got[300][2] == 0 and got[300][3] is None and got[None][1] == 2
    assert sum(r[0] == 7 for r in out) == 3 and len({r for r in out if r[0] == 7}) == 2
    assert abs(got[1][2] - mean([train[1][1]]) * 80) < 1e-2
    again = masked_lm.fit(df, net=net, sized=False)
    assert (again[1] == flat).all() and again[0].ids == words.ids
    assert masked_lm.score_documents(none).count() == 0


def test_score_is_the_pseudo_likelihood_of_strings(spark):
    """Each token's log-probability from both sides, by plain loops over all ids, and each rare word's share by its letters."""
    rnd = random.Random(3)
    common = [f"w{i}" for i in range(30)]
    docs = [" ".join(rnd.choices(common, k=20) + ["".join(rnd.choices("abcdeé", k=rnd.randint(2, 7))) for _ in range(9)]) for _ in range(60)]
    net = masked_lm.Network(side=6, dim=4, window=2, batch=32, mask=0.5, rounds=2)
    words, flat = masked_lm.fit(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, text string"), net=net, sized=False)
    p, side = words.net.unpack(flat), net.side
    assert len(words.ids) == 30 and abs(sum(words.counts) - 60 * 29) < 1e-6
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    for d in docs[:10]:
        w = d.encode().split()
        ids = [words.ids.get(x, -1) for x in w]
        ids = [zlib.crc32(x) % side if i < 0 else i for x, i in zip(w, ids, strict=True)]
        total = 0.0
        for k, i in enumerate(ids):
            h = p["c"].copy()
            for j, o in enumerate((-2, -1, 1, 2)):
                if 0 <= k + o < len(ids):
                    h += p["E"][ids[k + o]] * p["P"][j]
            h = np.tanh(h)
            rows = soft(h @ p["A"] + p["a"])
            every = np.concatenate([rows[r] * soft((h * p["U"][r] + p["G"][r]) @ p["B"] + p["b"][r]) for r in range(side)])
            assert abs(every.sum() - 1) < 1e-4
            total += np.log(every[i])
            if w[k] not in words.ids:
                total += float(words.spelling.log_prob([w[k]])[0]) + np.log(side)
        assert abs(masked_lm.log_probs([d.encode()], words, p)[1][0] - total) < 1e-2
    # the spelling of words without an id sums to one with those that have one, over all words of up to two letters and what goes on from them
    sp = masked_lm.Spelling(np.ones(masked_lm.CLASSES**3), np.ones(256))
    cells = np.exp(sp.cells.reshape(masked_lm.CLASSES, -1, masked_lm.CLASSES)).sum(axis=2)
    assert np.allclose(cells, 1, atol=1e-4)
    of = masked_lm.BYTE_CLASSES[1:]
    assert np.allclose(np.bincount(of, np.exp(sp.byte[1:]))[np.unique(of)], 1, atol=1e-2)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_prose_scores_above_gibberish(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(4, "doc_id")
    words, flat = masked_lm.fit(docs.where("doc_id % 5 > 0"))
    rnd, al = random.Random(1), "abcdefghijklmnopqrstuvwxyz0123456789"
    junk = [(-k, " ".join("".join(rnd.choices(al, k=rnd.randint(3, 10))) for _ in range(200))) for k in range(1, 31)]
    held = [tuple(r) for r in docs.where("doc_id % 5 = 0").collect() if len((r.text or "").split()) >= 50]
    out = {r.doc_id: r.mean_log_prob for r in masked_lm.score(spark.createDataFrame(held + junk, "doc_id long, text string"), (words, flat)).collect()}
    prose = sorted(out[i] for i, _ in held)
    assert max(out[i] for i, _ in junk) < prose[len(prose) // 20]


def test_network_gradients():
    """Train steps raise the log-probability of a fixed batch."""
    net = masked_lm.Network(side=4, dim=6, rate=0.05)
    rng = np.random.default_rng(1)
    x, at, _, _ = masked_lm.lay_out([[int(v) for v in rng.integers(0, 16, 40)] for _ in range(3)], net)
    p = net.start(np.ones(16))
    acc = {k: np.full(v.shape, 0.01, np.float32) for k, v in p.items()}
    seen = [masked_lm.train_step(p, acc, x, at, net) for _ in range(400)]
    assert seen[-1] > seen[0] + 0.3
