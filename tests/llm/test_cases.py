"""Every operator on one odd table: null and repeated ids, repeated rows, ties, null, empty and very long texts, columns that have the names of results and of inner columns."""

import hashlib
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from rillstore.llm import bpe_transducer, exact_dedup, line_dedup, masked_lm, quality_bands, secret_grammar, simhash_vptree, similar, suffix_dedup, temperature_mix

NAMES = ["i", "t", "row", "raw", "fp", "key", "n", "s", "kept", "n_words", "spans", "word", "log_prob", "component_id", "fingerprint", "n_tokens", "__id", "__fp", "__t", "__raw", "__key", "blocks", "need", "a.b"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in NAMES)


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("etaoinshrdlucmfw", k=rnd.randint(2, 9)))
    bank = [word() for _ in range(4000)]
    line = lambda: " ".join(rnd.choices(bank, k=11))
    long = "\n".join(line() for _ in range(180_000))  # 12 MB
    short = "\n".join(line() for _ in range(8))
    one = "q" * 1_000_000
    return [(7, long), (9, long), (1, short), (1, short), (2, short), (None, short), (None, line()), (1, line()), (3, None), (4, ""), (5, " \n\t "), (6, "\n\n\n\n"), (8, one), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, "s", *range(len(NAMES))) for i, t in rows], SCHEMA).repartition(3)
    return df.cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(out, docs, rows, *cols):
    """(id, hash of the columns) of each row, sorted; for results that have the id only."""
    return sorted(((r.doc_id, *(r[c] for c in cols)) for r in out.collect()), key=str)


def test_exact(spark, docs, none, rows, tmp_path):
    plain = docs.drop("a.b")
    plain.write.parquet(str(tmp_path / "t"))
    got = exact_dedup.exact_dedup(spark, str(tmp_path / "t"))
    strip = lambda t: "".join((t or "").split())
    want = []
    for i, t in rows:
        group = [(-len(u or ""), j is None, j or 0, j) for j, u in rows if strip(u) == strip(t)]
        want.append((i, min(group)[3], len(group), strip(t)))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.digest)) for r in got.collect()), key=str) == sorted(((i, k, n, hashlib.sha256(s.encode()).digest()) for i, k, n, s in want), key=str)
    assert got.where("kept").count() == len({w[3] for w in want})


def test_simhash(docs, none, rows):
    got = sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in simhash_vptree.near_dedup(docs).collect()), key=str)
    fps = [(i, simhash_vptree.fingerprint((t or "").encode())) for i, t in rows]
    alike = lambda f: [j for j, g in fps if (f ^ g).bit_count() <= 3 and j is not None]
    assert got == sorted(((i, f, min(alike(f), default=None)) for i, f in fps), key=str)
    kept = simhash_vptree.keep_one(docs, shingle=3)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 1, 1, 3, 7, 8, None], key=str)
    assert simhash_vptree.near_dedup(none).count() == simhash_vptree.keep_one(none).count() == 0


def test_similar(docs, none):
    kept = similar.keep_one_similar(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 1, 1, 3, 7, 8, None], key=str)
    assert similar.keep_one_similar(none).count() == 0


def test_secrets(docs, none, rows):
    got = secret_grammar.scan(docs)
    want = sorted(((i, 0, 0, 0, "") for i, t in rows), key=str)
    assert by_text(got, docs, rows, "n_assign", "n_access", "n_hex", "base_spans") == want and secret_grammar.scan(none).count() == 0


def test_quality(docs, none, rows):
    z = zstandard.ZstdCompressor(level=3)
    want = sorted(((i, *(lambda j: (j[0], j[4], j[5], j[8]))(quality_bands.judge((t or "").encode(), z, quality_bands.Bands()))) for i, t in rows), key=str)
    assert by_text(quality_bands.measure(docs), docs, rows, "n_words", "n_repeat_words", "base_failed", "kept") == want
    assert quality_bands.keep(docs).count() == sum(w[-1] for w in want) and quality_bands.keep(none).count() == 0


def test_suffix(docs, none, rows):
    out = {}
    for r in suffix_dedup.suffix_dedup(docs.select("doc_id", "text", "key")).collect():
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans))
    long, short = len(rows[0][1]), len(rows[2][1])
    assert out[9] == [(long, long, 1)] and out[7][0][0] == long and out[7][0][1] < long // 1000  # the copy goes, the first stays
    assert out[2] == [(short, short, 1)] and sorted(out[1])[1:] == [(short, short, 1)] * 2  # null ids come first
    assert out[8] == [(1_000_000, 999_999, 1)] and out[4] == [(0, 0, 0)]
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_lines(docs, none, rows):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "__n_lines", "__n_removed", "kept_text"]
    out = {}
    for r in got.collect():
        assert tuple(r[3 : 3 + len(NAMES)]) == tuple(range(len(NAMES)))
        out.setdefault(r.doc_id, []).append((r["__n_lines"], r["__n_removed"], r.kept_text))
    assert out[7] == [(180_000, 0, rows[0][1])] and out[9] == [(180_000, 180_000, "")] and out[2] == [(8, 8, "")]
    assert out[3] == [(0, 0, None)] and out[6] == [(5, 0, "\n\n\n\n")] and out[8][0][:2] == (1, 0)
    assert line_dedup.dedup_lines(none).count() == 0


def test_mix(docs, none, rows):
    got = temperature_mix.mix(docs)
    assert got.columns == [*docs.columns, "__n_tokens", "__pass", "__block", "__rank"]
    once = got.groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in once} == {7: 1, 9: 1, 1: 3, 2: 1, None: 3, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1}  # one source: its own number of tokens
    assert temperature_mix.mix(none).count() == 0


def test_bpe(docs, none, rows):
    pt = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = pt.path("byte_bpe_50k.json")
    tk, known = Tokenizer.from_file(path), {}
    for _, t in rows:
        if t not in known:
            ids = tk.encode(t or "", add_special_tokens=False).ids
            known[t] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tk.decode(ids, skip_special_tokens=False).encode()))
    got = by_text(bpe_transducer.encode_decode(docs, path), docs, rows, "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(((i, *known[t]) for i, t in rows), key=str) and bpe_transducer.encode_decode(none, path).count() == 0


def test_lm(docs, none, rows):
    got = masked_lm.score_documents(docs).collect()
    n = sorted(((r.doc_id, r.n_tokens) for r in got), key=str)
    assert n == sorted(((i, len((t or "").split())) for i, t in rows), key=str)
    assert len({round(r.log_prob, 3) for r in got if r.n_tokens == 88}) == 1 and len({round(r.log_prob) for r in got if r.n_tokens > 10**6}) == 1
    assert all((r.mean_log_prob is None) == (r.n_tokens == 0) and np.isfinite(r.log_prob) for r in got)
    assert masked_lm.score_documents(none).count() == 0


def test_scratch_goes(spark, docs):
    """What an operator leaves is in this application's folder of the shared one, and clear() takes it."""
    from rillstore.llm import common

    line_dedup.dedup_lines(docs.where(F.length("text") < 1000)).count()
    fs, p = common._place(spark, f"{common.shared_dir(spark)}/rill/{spark.sparkContext.applicationId}")
    assert fs.exists(p)
    common.clear(spark)
    assert not fs.exists(p)
