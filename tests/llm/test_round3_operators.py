"""Operators 11 to 13."""
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ledgerlake.llm import fill_middle, optimise, toxicity, whitening
from tools.compare import duck, frame_rows

SMALL = "/root/testdata/sf0.001"


def table(spark, name, sf=SMALL):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- 11 ----------------------------------------------------------------------------------------------------

def spectrum(x, block):
    s = whitening.Spectrum(x.shape[1])
    for at in range(0, len(x), block):
        s.add_block(x[at:at + block])
    return s


def check_spectrum(s, x):
    off = x - x.mean(axis=0)
    scatter = off.T @ off
    size = max(1.0, np.abs(scatter).max())
    assert s.n == len(x) and s.sums == x.sum(axis=0).tolist()
    assert np.abs(s.basis @ np.diag(s.values) @ s.basis.T - scatter).max() < 1e-11 * size
    assert np.abs(s.basis.T @ s.basis - np.eye(len(s.values))).max() < 1e-11


@pytest.mark.parametrize("dim", [1, 2, 7, 40])
@pytest.mark.parametrize("block", [1, 5, 64])
def test_rank_one_updates_keep_the_spectrum_of_the_scatter(dim, block):
    rng = np.random.default_rng(dim * 100 + block)
    for x in (rng.integers(-300, 300, (90, dim)), rng.integers(-1, 2, (90, dim)), np.zeros((9, dim), int),
              np.repeat(rng.integers(-5, 5, (2, dim)), 20, axis=0), rng.integers(-9, 9, (1, dim)),
              rng.integers(-9, 9, (60, dim)) * (np.arange(dim) % 2), (10 ** np.arange(dim) % 97) * rng.integers(0, 3, (80, 1))):
        check_spectrum(spectrum(x, block), x)


def test_spectra_merge_by_rank_one_updates():
    rng = np.random.default_rng(5)
    x = rng.integers(-100, 100, (300, 12)) + np.arange(12) * 50
    total = spectrum(x[:100], 1)
    for part in (x[100:101], x[101:250], x[250:]):
        other = whitening.Spectrum.of_row(**spectrum(part, 7).row())
        total.merge(other)
    check_spectrum(total, x)


def test_secular_roots_against_eigenvalues():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 30):
        for spread in (1.0, 1e-6, 1e8):
            d = np.sort(rng.random(k)) * spread
            z = rng.normal(size=k) * 10.0 ** rng.integers(-5, 1, k)
            near, tau = whitening.secular_roots(d, z * z, 0.7)
            want = np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(z, z))
            assert np.abs(np.sort(d[near] + tau) - want).max() < 1e-13 * max(1.0, spread) * k


def brute_whitening(rows):
    """vec_id -> (n, deviation, |whitened| of up to four components, explained) by a plain eigendecomposition."""
    ok = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
          if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted(set(tuple(x) for _, x in ok)))
    n, sums = len(fit), fit.sum(axis=0)
    off = fit - sums / n
    e, u = np.linalg.eigh(off.T @ off / n)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    out = []
    for i, x in ok:
        x = np.array(x)
        out.append((i, n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)),
                    (x - sums / n) @ u / np.sqrt(e), e / np.trace(off.T @ off / n)))
    return out


def test_whitening_matches_a_plain_eigendecomposition(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, "embeddings").collect()]
    want = {w[0]: w for w in brute_whitening(rows)}
    got = E.queries()["op11_embedding_whitening"](spark, SMALL).collect()
    assert len(got) == 4 * len(want) == 4 * len(rows)
    signs = {}
    for r in got:
        _, n, deviation, white, explained = want[r["vec_id"]]
        k = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(abs(r["whitened"]) - abs(white[k])) < 1e-7 and abs(r["explained"] - explained[k]) < 1e-9
        if abs(white[k]) > 1e-3:
            signs.setdefault(k, set()).add(np.sign(r["whitened"] * white[k]))
        assert r["identity_error"] < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, nan, 2.0]), (104, [inf, 1.0, 1.0]), (105, [1.0, 2.0]),
           (3, good[5][1]), (3, good[5][1]), (None, good[7][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + odd], "vec_id long, embedding array<double>, x string, n long")
    got = whitening.contract(spark, df.repartition(7)).toPandas()
    want = {w[0]: w for w in brute_whitening(good)}
    assert len(got) == 3 * 43 and got.vec_id.isna().sum() == 3 and (got.vec_id == 3).sum() == 9
    assert set(got.n) == {40} and set(got.component) == {1, 2, 3}
    for r in got[(got.vec_id != 3) & got.vec_id.notna()].itertuples():
        assert r.deviation == want[r.vec_id][2] and abs(abs(r.whitened) - abs(want[r.vec_id][3][r.component - 1])) < 1e-9
    assert whitening.contract(spark, df.filter("false")).count() == 0
    assert whitening.contract(spark, df.filter("vec_id in (100, 101)")).count() == 0


def test_whitening_without_variance_and_beyond_long(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<double>")
    got = whitening.contract(spark, one).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, 0.0, 0.0, 0.0)}
    line = spark.createDataFrame([(i, [i / 4, i / 2, -i / 4]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.contract(spark, line).toPandas()
    assert set(got[got.component > 1].whitened) == {0.0} and abs(got[got.component == 1].whitened.std(ddof=0) - 1) < 1e-9
    far = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert whitening.contract(spark, far).filter("deviation is null").count() == 4


# ---- 12 ----------------------------------------------------------------------------------------------------

def test_fim_matches_oracle(spark):
    name = "op12_fill_in_middle"
    assert frame_rows(E.queries()[name](spark, SMALL).toPandas()) == frame_rows(duck(SMALL).execute(E.oracle_sql()[name]).df())


def plain_fim(id_, text):
    h = hashlib.sha256(f"1:{id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    if h4 % 100 < 20:
        return len(text), "spm", a, b, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return len(text), "psm", a, b, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def odd_texts():
    rng = random.Random(4)
    alphabet = "ab<PSM> \n\t\rüß漢🙂é́"
    return ["", "a", "<P>", "a<S>b", "<", "<M", "🙂", "漢字" * 50_000, "a" * 70_000, "é" * 32_768, "x" * 32_767 + "🙂" * 3, " \n "] + [
        "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 5, 40, 900]))) for _ in range(300)]


def test_fim_against_plain_cuts_and_round_trip(spark):
    texts = odd_texts()
    rows = [(i, t, "o") for i, t in enumerate(texts)] + [(0, texts[14], "o"), (7, None, "o"), (7, None, "o")]
    got = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, output string")).collect()
    assert len(got) == len(rows)
    for (i, t, _), r in zip(rows, got):
        t = t or ""
        assert (r["n"], r["form"], r["cut_1"], r["cut_2"], r["output"]) == plain_fim(i, t)
        assert fill_middle.restore(r["output"], r["form"]) == t
    nobody = spark.createDataFrame([(None, "abc def")], "doc_id long, text string")
    assert fill_middle.contract(spark, nobody).first()["restored_sha256"] == hashlib.sha256(b"abc def").hexdigest()
    assert fill_middle.contract(spark, nobody.filter("false")).count() == 0
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("error", [1, 16, 100])
def test_rank_index_is_exact_and_its_error_bounded(unit, error):
    for t in odd_texts()[:60]:
        blocks = list(fill_middle.boundaries(t.encode(), unit))
        want = np.concatenate(blocks)
        index = fill_middle.RankIndex.unpack(*fill_middle.fit(iter(blocks), error).pack())
        ranks = np.arange(len(want))
        assert (index.offsets(ranks) == want).all()
        assert np.abs(index.predict(ranks) - want).max() <= error + 1
        assert want[0] == 0 and want[-1] == len(t.encode()) and (np.diff(want) > 0).all()


def test_stored_index_gives_the_cuts_of_the_transform(spark):
    docs = table(spark, "documents")
    cuts = {r["id"]: r for r in fill_middle.fill_in_middle(docs).collect()}
    for r in fill_middle.rank_index(docs).collect():
        c = cuts[r["id"]]
        assert r["n"] == c["n"]
        if c["form"] != "plain":
            index = fill_middle.RankIndex.unpack(r["segments"], r["residuals"])
            assert index.offsets(np.array([c["cut_1"], c["cut_2"]])).tolist() == [c["byte_1"], c["byte_2"]]


def test_word_units_cut_between_words(spark):
    docs = spark.createDataFrame([(i, f"one two\nthree  four {i}") for i in range(50)], "doc_id long, text string")
    for r in fill_middle.fill_in_middle(docs, unit="word").collect():
        assert r["n"] == 5
        text = f"one two\nthree  four {r['id']}"
        if r["form"] != "plain":
            starts = [0, 4, 8, 15, 20, len(text)]
            assert r["byte_1"] in starts and r["byte_2"] in starts
        assert fill_middle.restore(r["output"], r["form"]) == text


# ---- 13 ----------------------------------------------------------------------------------------------------

def plain_features(text, grams, bits):
    """slot -> count, window by window."""
    out, mask = {}, (1 << 64) - 1
    t = f" {text.lower()} " if text else ""
    for n in grams:
        for i in range(len(t) - n + 1):
            h = n
            for c in t[i:i + n]:
                h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & mask
                h ^= h >> 29
            out[h >> (64 - bits)] = out.get(h >> (64 - bits), 0) + 1
    return {k: min(v, 255) for k, v in out.items()}


def test_features_against_a_plain_count(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    rng = random.Random(2)
    texts = [None, "", "a", "Ab", "🙂ß漢字 É" * 9, "aaaa" * 100] + [
        "".join(rng.choice("abc ÄÉ🙂") for _ in range(rng.randrange(150))) for _ in range(60)]
    got = list(toxicity.features(texts, (2, 4), 12))
    assert len(got) == len(texts)
    for t, (ids, counts) in zip(texts, got):
        assert dict(zip(ids.tolist(), counts.tolist())) == plain_features(t or "", (2, 4), 12)


def test_logistic_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    ids, x, owner = rng.integers(0, 9, 60), rng.normal(size=60), np.repeat(np.arange(20), 3)
    y, weight, theta = rng.integers(0, 2, 20), rng.random(20) + 0.5, rng.normal(size=10)
    _, g = toxicity.loss_and_gradient(theta, ids, x, owner, y, weight)
    for i in range(10):
        e = np.zeros(10)
        e[i] = 1e-6
        up, down = (toxicity.loss_and_gradient(theta + s, ids, x, owner, y, weight)[0] for s in (e, -e))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-5


def test_minimise_reaches_the_minimum():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 12))
    h, b = a.T @ a + 0.1 * np.eye(12), rng.normal(size=12)
    got = optimise.minimise(lambda x: (0.5 * x @ h @ x - b @ x, h @ x - b), np.zeros(12), 1e-9)
    assert np.abs(got - np.linalg.solve(h, b)).max() < 1e-6


def test_fit_equals_a_plain_fit(spark):
    """The model from Spark against the same classifier on one dense matrix, by gradient descent with Newton steps."""
    rng = random.Random(7)
    rows = [("".join(rng.choice("abcd ") for _ in range(30)) + (" xyxy" if i % 3 == 0 and i % 7 else ""), int(i % 3 == 0))
            for i in range(60)]
    grams, bits, ridge = (2, 3), 6, 0.5
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int").repartition(5), grams, bits, ridge)
    dense = np.zeros((60, 64))
    for i, (t, _) in enumerate(rows):
        for k, v in plain_features(t, grams, bits).items():
            dense[i, k] = math.log1p(v)
    y = np.array([r[1] for r in rows])
    p, q = dense[y == 1].sum(axis=0) + 1, dense[y == 0].sum(axis=0) + 1
    ratio = np.where(dense.sum(axis=0) > 0, np.log((p / p.sum()) / (q / q.sum())), 0)
    assert np.abs(ratio - model.ratio).max() < 1e-9
    x = dense * ratio
    x = np.column_stack([x / np.sqrt((x * x).sum(axis=1))[:, None], np.ones(60)])
    w = np.where(y == 1, 60 / (2 * y.sum()), 60 / (2 * (60 - y.sum())))
    hold = np.diag([ridge] * 64 + [0.0])
    theta = np.zeros(65)
    for _ in range(50):
        z = 1 / (1 + np.exp(-x @ theta))
        theta -= np.linalg.solve(x.T @ (x * (w * z * (1 - z))[:, None]) + hold, x.T @ (w * (z - y)) + hold @ theta)
    got = toxicity.scores([r[0] for r in rows], model, grams, bits)
    assert np.abs(got - 1 / (1 + np.exp(-x @ theta))).max() < 5e-3


def test_odd_inputs_of_toxicity(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "z", 5), (4, "fool " * 200_000, 5), (4, "fool", 5), (4, "fool", 5), (None, "x y", 5)],
                                 "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.contract(spark, docs, none).toPandas()
    assert len(got) == 7 and set(got.score.round(6)) == {0.0} and set(got.predicted) == {0}
    rows = [(i, "you friend" if i % 3 else "you fool", 0) for i in range(100, 200)]
    more = docs.unionAll(spark.createDataFrame(rows, docs.schema))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(100, 200)] + [(102, 1, 1), (None, 1, 1), (7, 1, None), (5, 1, 3)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.contract(spark, more, labels).toPandas()
    assert got.score.between(0, 1).all() and len(got) == 107
    assert (got[got.doc_id >= 100].predicted == (got[got.doc_id >= 100].doc_id % 3 == 0)).all()
    assert set(got[got.doc_id == 4].predicted) == {1} and set(got[got.doc_id.isin([1, 2])].predicted) == {0}
    assert toxicity.contract(spark, more.filter("false"), labels).count() == 0


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, "labels", sf)
    got = toxicity.contract(spark, table(spark, "documents", sf), labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    bad, good = held[held.toxic == 1], held[held.toxic == 0]
    assert len(bad) > 90 and bad.predicted.mean() > 0.85 and good.predicted.mean() < 0.01


def test_no_label_of_a_held_out_row_is_learned(spark):
    labels = table(spark, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = table(spark, "documents")
    one, two = (toxicity.contract(spark, docs, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert one.equals(two)


# ---- worker memory -----------------------------------------------------------------------------------------

def test_worker_memos_can_be_released():
    from ledgerlake.llm import common
    calls = []

    @common.worker_memo
    def kept(n):
        calls.append(n)
        return n
    assert [kept(1), kept(1), len(calls)] == [1, 1, 1]
    common.release_memos()
    assert [kept(1), len(calls)] == [1, 2]
    common._MEMOS.remove(kept)


def test_simhash_and_rules_release_what_packing_left(spark, monkeypatch):
    """Run the task functions here: whatever an earlier task of packing left in the process is gone afterwards."""
    from ledgerlake.llm import near_text, outliers, quality
    tasks = []
    docs = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema, *_: tasks.append(run) or df.limit(0))
    near_text.fingerprints(docs)
    with pytest.raises(Exception):                    # its columns come from the task, which does not run here
        outliers.statistics(docs, "doc_id", "text", ["lang"]).count()
    assert len(tasks) == 2
    for run in tasks:
        quality.features(16)
        assert quality.features.cache_info().currsize > 0
        list(run(iter([])))
        assert quality.features.cache_info().currsize == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_fingerprints_do_not_depend_on_blocks(block, monkeypatch):
    from ledgerlake.llm import near_text
    texts = [b"", b"One", b"one two", b"one two three", b"a b c d e f g a b c a b c d"]
    want = [near_text.fingerprint(t) for t in texts]
    monkeypatch.setattr(near_text, "_BLOCK", block)
    assert [near_text.fingerprint(t) for t in texts] == want
