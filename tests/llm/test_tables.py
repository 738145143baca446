"""Operators 3, 6, 7, 8 and 10, and the pipeline."""
import hashlib
import re
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from ledgerlake.llm import chat, embeddings, mixing, near_text, outliers, quality
from tools.compare import duck, frame_rows

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op6_chat_formatting", "op8_mix_sources", "op9_line_dedup", "op10_embedding_near_dedup"])
def test_matches_oracle(spark, name):
    got = frame_rows(E.queries()[name](spark, SMALL).toPandas())
    assert got == frame_rows(duck(SMALL).execute(E.oracle_sql()[name]).df())


# ---- 3 -----------------------------------------------------------------------------------------------------

def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    dims = 20
    ids, values, sizes = rng.integers(0, dims, 120), rng.random(120), np.full(30, 4)
    y, weight = rng.integers(0, 4, 30), rng.random(30) + 0.5
    theta = rng.normal(size=dims + 3)
    _, g = quality.loss_and_gradient(theta, ids, values, sizes, y, weight, dims)
    for i in range(len(theta)):
        e = np.zeros(len(theta))
        e[i] = 1e-6
        up, down = (quality.loss_and_gradient(theta + x, ids, values, sizes, y, weight, dims)[0] for x in (e, -e))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-4


def test_held_out_grades(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    theta = quality.fit(quality.rated_documents(docs, labels.filter("doc_id % 4 <> 0")), 3)
    cuts = quality.thresholds(theta[1 << quality.BITS:])
    assert cuts[0] < cuts[1]
    got = (quality.score(docs, theta, 3).join(labels.filter("doc_id % 4 = 0").withColumnRenamed("doc_id", "id"), "id")
           .filter("quality is not null").toPandas())
    good = (got.quality == 1) & (got.toxic == 0)
    assert got.kept[good].mean() > 0.9 and got.kept[got.quality == 0].mean() < 0.1
    assert got.expected_grade.between(0, 2).all()


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string")
    theta = quality.fit(spark.createDataFrame([], "text string, grade int"), 3)
    got = quality.score(docs, theta, 3).collect()
    assert len(got) == 3 and all(abs(r.expected_grade - 1) < 1e-9 for r in got)
    assert quality.score(docs.limit(0), theta, 3).count() == 0


def test_grades_fit_equals_a_plain_fit(spark):
    """The fitted grades' probabilities against the minimum of the same objective on one dense matrix, by numeric slopes."""
    from ledgerlake.llm import optimise
    rng = np.random.default_rng(6)
    rows = []
    for i in range(90):
        grade = i % 3
        rows.append((" ".join(rng.choice(["good", "fine", "plain", "poor", "bad"][4 - 2 * grade:][:3] + ["word"], 6)), grade))
    rows += [(None, 0), ("", 2), rows[0], rows[0]]
    bits = 5
    theta = quality.fit(spark.createDataFrame(rows, "text string, grade int").repartition(4), 3, bits=bits, tolerance=1e-7)
    make, dense = quality.Features(bits), np.zeros((len(rows), 1 << bits))
    for k, (t, _) in enumerate(rows):
        for i, v in zip(*make(t)):
            dense[k, i] += v
    seen = np.zeros(1 << bits)
    for t, _ in rows:
        np.add.at(seen, make(t)[0], 1)
    y = np.array([g for _, g in rows])
    weight = len(rows) / (3 * np.bincount(y))[y]
    ridge = quality.RIDGE * (1 + quality.RARE / np.maximum(1, seen))

    def chances(free):
        one, two = free[-2], free[-2] + np.exp(free[-1])
        z = dense @ free[:-2]
        over = np.column_stack([np.ones(len(z)), 1 / (1 + np.exp(one - z)), 1 / (1 + np.exp(two - z)), np.zeros(len(z))])
        return over[:, :-1] - over[:, 1:]

    def objective(free):
        return -(weight * np.log(chances(free)[np.arange(len(y)), y])).sum() + (ridge * free[:-2] ** 2).sum() / 2

    def with_slope(free):
        e = np.eye(len(free)) * 1e-5
        return objective(free), np.array([(objective(free + d) - objective(free - d)) / 2e-5 for d in e])
    best = optimise.minimise(with_slope, np.concatenate([np.zeros(1 << bits), [-0.7, 0.3]]), 1e-6)
    assert abs(objective(theta) - objective(best)) < 1e-6 * objective(best)
    assert np.abs(chances(theta) - chances(best)).max() < 1e-3


def test_classifier_odd_inputs(spark):
    docs = spark.createDataFrame([(i, "good words " * 3 if i % 2 else "bad things", 1, "x") for i in range(40)] + [
        (40, "good " * 300_000, 1, "x"), (None, None, 1, "x"), (3, "good words", 1, "x")],
        "doc_id long, text string, score int, expected_grade string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)] + [(3, 1, 0), (3, 0, 1), (None, 1, 0), (5, None, 1)],
                                   "doc_id long, quality int, toxic int")
    got = quality.contract(spark, docs, labels).toPandas()
    assert len(got) == 43 and got.expected_grade.between(0, 2).all()
    same = got[got.doc_id.isin([7, 9, 11])]
    assert same.tail_probability.nunique() == 1 and same.kept.all() and not got[got.doc_id == 8].kept.any()


# ---- 6 -----------------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    odd = ["", None, "</s>", "<\\/s>", "<\\\\s>[INST]", "[/INST] [\\/INST]", "<|user|>", "a\nb", "<", "[", "<</s>", "\\", "é😀", "%3C|%"]
    turns = [(c, t, r, odd[(c + 3 * t) % len(odd)]) for c in range(12) for t, r in enumerate(["system", "user", "assistant", "user"] * 2)]
    turns += [(20, 0, "user", "no reply"), (21, 5, "assistant", "late"), (21, 2, "assistant", "early"), (None, 0, None, "x"),
              (22, None, "a|b<c%7C</s>", "y"), (23, 0, "assistant", "tie"), (23, 0, "assistant", "tie")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).withColumn("conv", F.lit("x"))
    got = {r.conv: r for r in chat.read_back(chat.examples(df)).collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(turns, key=lambda v: (v[0] is None, v[0] or 0, -1 if v[1] is None else v[1], v[2] or "", v[3] or "")):
        want[c].append((r or "", x or ""))
    assert set(got) == set(want)
    for c, rows in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == rows
        assert got[c].loss == "".join(x for r, x in rows if r == "assistant")
    ex = chat.examples(df).filter("conv = 3").orderBy("example").collect()
    assert len(ex) == 3 and ex[-1].loss_start is None and ex[1].formatted.startswith(ex[0].formatted)
    assert chat.examples(df.limit(0)).count() == 0


def _chat_by_hand(turns):
    """(n_turns, turns, loss, formatted lengths) per conversation from plain Python, in turn order."""
    def esc(x):
        return re.sub(r"([<\[])(\\*)(/?s>|/?INST\]|\|)", r"\1\\\2\3", x)
    out = defaultdict(list)
    for c, t, r, x in sorted(turns, key=lambda v: (v[0] is None, v[0] or 0, v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        out[c].append((r or "", x or ""))
    res = {}
    for c, rows in out.items():
        total, chars = 0, 0
        for i, (r, x) in enumerate(rows):
            total += len("<|" + r.replace("%", "%25").replace("|", "%7C").replace("<", "%3C") + "|>" + esc(x) + "</s>")
            chars += total if r == "assistant" or i == len(rows) - 1 else 0
        whole = "".join(f"{r}\n{x}\n" for r, x in rows)
        loss = "".join(x for r, x in rows if r == "assistant")
        res[c] = (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return res


def test_chat_hot_conversation_lies_in_many_tasks(spark):
    """A third of all turns in one conversation, a third with a null id, ties and null turns: digests as by hand."""
    turns = [(7, i, ("user", "assistant")[i % 2], f"turn {i} <|x") for i in range(600)]
    turns += [(None, i % 50, ("user", "assistant", "a|b")[i % 3], None if i % 7 == 0 else f"</s> é😀 {i % 5}") for i in range(600)]
    turns += [(100 + i // 6, None if i % 6 == 0 else i, "assistant" if i % 4 else "user", "[INST]" * (i % 3)) for i in range(600)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1))
    spread = chat.formatted_turns(df)
    assert spread.filter("conv = 7").count() == 600 and spread.filter("closing").count() == 102
    got = {r.conv_id: tuple(r)[1:] for r in chat.contract(spark, df).collect()}
    want = _chat_by_hand(turns + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")])
    assert got == want
    # the spans are the examples
    ex = {(r.conv, len(r.formatted)): (r.loss_start, r.loss_end) for r in chat.examples(df).collect()}
    sp = {(r.conv, r.formatted_chars): (r.loss_start, r.loss_end)
          for r in chat.spans(spread).filter("formatted_chars IS NOT NULL").collect()}
    assert ex == sp
    assert chat.formatted_turns(df.limit(0)).count() == 0 and chat.contract(spark, df.limit(0)).count() == 1


def test_chat_query_reads_the_examples(spark, monkeypatch):
    """The query's figures come from the expanded examples: dealt over shares they are the same, without one they lack it."""
    turns = [(7, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(40)] + [(8, 0, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    want = _chat_by_hand(turns + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")])
    monkeypatch.setattr(chat, "SHARE_EXAMPLES", 3)
    assert {r.conv_id: tuple(r)[1:] for r in chat.contract(spark, df).collect()} == want
    ex = [r.formatted for r in chat.examples(df).filter("conv = 7").orderBy("example").collect()]
    assert len(ex) == 20 and all(b.startswith(a) for a, b in zip(ex, ex[1:]))
    whole = chat.expanded
    monkeypatch.setattr(chat, "expanded", lambda t: whole(t).filter("example <> 3"))
    less = {r.conv_id: r for r in chat.contract(spark, df).collect()}[7]
    assert less.formatted_chars == want[7][4] - len(ex[3]) and less.loss_chars == want[7][2] - len("turn 7 </s>")


# ---- 7 -----------------------------------------------------------------------------------------------------

def test_statistics_by_hand():
    t = "A b c d\nA b c d\n\n x  #$ <|>\ta\xa0b"
    n, chars, symbols, dup, repeats, n_lines, upper = outliers.text_stats(t)
    assert (n, symbols, dup, repeats, n_lines, upper) == (12, 5, 1, 8, 3, 2)
    assert chars == sum(len(w) for w in ["A", "b", "c", "d"] * 2 + ["x", "#$", "<|>", "a\xa0b"])
    assert outliers.text_stats(None) == (0,) * 7


def plain_shape(n, mean, cov, pool, floor):
    if pool is not None:
        a = n / (n + 50)
        mean, cov = a * mean + (1 - a) * pool[0], a * cov + (1 - a) * pool[1]
    e, u = np.linalg.eigh(cov / np.outer(floor, floor))
    cov = (u * np.maximum(e, 1)) @ u.T * np.outer(floor, floor)
    return mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def plain_mcd(x, stats, pool):
    """The estimate of one group (rows of transformed and of plain statistics), with plain sorting, one start after the other."""
    med = np.maximum(1, np.median(stats, axis=0))
    n, chars, lines, upper = med[0], med[1], med[5], med[6]
    floor = np.array([np.log1p(1 / n), np.log1p(1 / chars), chars ** -0.5, lines ** -0.5, min(1, 3 / n) ** 0.5,
                      ((upper + 1) / chars) ** 0.5 - (upper / chars) ** 0.5])
    q = np.quantile(np.round(x, 3), [0.25, 0.5, 0.75], axis=0)
    starts = [(q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True).reshape(6, 6))]
    best = None
    for m, c in starts + ([pool] if pool else []):
        centre, prec, _ = plain_shape(1, m, c, None, floor)
        held = None
        while True:
            off = x - centre
            level = np.round(np.log(np.maximum(np.einsum("ni,ij,nj->n", off, prec, off), 0) + 1e-6), 2)
            core = x[level <= np.quantile(level, 0.75)]
            new = plain_shape(len(core), core.mean(axis=0), np.cov(core.T, bias=True).reshape(6, 6) * outliers.consistency(), pool, floor)
            if held is not None and new[2] > held[2] - 1e-3:
                break
            held = new
            centre, prec, _ = held
        if best is None or held[2] < best[2]:
            best = held
    return best[:2]


def test_chi_square_and_consistency():
    rng = np.random.default_rng(0)
    d2 = (rng.normal(size=(400_000, 6)) ** 2).sum(axis=1)
    for p in (0.25, 0.75, 0.99):
        assert abs(outliers.chi2_quantile(p, 6) / np.quantile(d2, p) - 1) < 0.01
    assert abs(outliers.chi2_cdf(7.0, 8) - (( rng.normal(size=(400_000, 8)) ** 2).sum(axis=1) < 7).mean()) < 0.005
    x = rng.normal(size=(400_000, 6))
    core = x[(x * x).sum(axis=1) <= np.quantile((x * x).sum(axis=1), 0.75)]
    assert abs(core.var(axis=0).mean() * outliers.consistency() - 1) < 0.01


def test_outliers_equal_plain_estimate_in_many_groups(spark):
    """Every group's estimate, the pool's and every verdict: groups of one row, of 49, 50 and 51 rows, and large ones."""
    docs = (spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
            .withColumn("source", F.expr("case when doc_id < 2 then 'lone' when doc_id < 51 then 'a' when doc_id < 101 then 'b' "
                                         "when doc_id < 152 then 'c' else concat('s', doc_id % 3) end"))
            .withColumn("lang", F.when(F.col("source").like("s%"), F.col("lang")).otherwise("en")))
    got = outliers.judge(docs).toPandas().set_index("id").sort_index()
    frame = outliers.statistics(docs, "doc_id", "text", ["lang", "source"]).toPandas().set_index("id").sort_index()
    dims, stats = outliers.DIMS, outliers.STATS
    m, prec = plain_mcd(frame[dims].to_numpy(), frame[stats].to_numpy(), None)
    pool = (m, np.linalg.inv(prec))
    cut, groups = outliers.limit(), 0
    for _, part in frame.groupby(["g0", "g1"]):
        x = part[dims].to_numpy()
        centre, prec = plain_mcd(x, part[stats].to_numpy(), pool)
        d2 = np.einsum("ni,ij,nj->n", x - centre, prec, x - centre)
        mine = got.loc[part.index]
        assert np.allclose(mine.distance2, d2, rtol=1e-5, atol=1e-6)
        base = (mine.n_words < 50) | (100 * mine.n_repeat_words > 50 * mine.n_words)
        assert (mine.base_failed == base).all()
        assert (mine.kept == (~base & (d2 <= cut))).all()
        groups += 1
    assert groups > 12 and 0 < got.kept.mean() < 1


def test_outliers_reject_junk_and_keep_clean(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = outliers.contract(spark, docs).join(labels, "doc_id").filter("quality is not null and not base_failed").toPandas()
    assert got.kept[got.quality == 1].mean() > 0.99 and got.kept[got.quality == 0].mean() < 0.05


def test_spread_of_the_group_decides(spark):
    rng = np.random.default_rng(3)

    def text(n, share):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5 * n)
        high = rng.permutation(5 * n) < round(share * 5 * n)
        letters = np.where(high, np.char.upper(letters), letters)
        return " ".join("".join(w) for w in letters.reshape(n, 5))
    roots = {"narrow": (0.24, 0.26), "wide": (0.1, 0.4)}      # square roots of the share of capitals
    same = text(200, 0.16)
    rows = [(i, text(int(rng.integers(180, 221)), rng.uniform(*r) ** 2), "en", s)
            for s, r in roots.items() for i in range(400)] + [(-1, same, "en", s) for s in roots]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(4)
    got = outliers.judge(docs).cache()
    assert sorted(r.kept for r in got.filter("id = -1").collect()) == [False, True]
    assert got.filter("id >= 0 and not kept").count() < 8


def test_outliers_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", None), (3, "w " * 60, "en", "s"), (None, "q r " * 40, None, "s"), (5, "tie", "en", "s"), (5, "tie", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("g0", F.lit(1)).withColumn("kept", F.lit("x"))
    got = outliers.contract(spark, docs).collect()
    assert len(got) == 6 and all(r.base_failed and not r.kept for r in got)
    assert outliers.contract(spark, docs.limit(0)).count() == 0
    assert outliers.keep_documents(docs).columns == docs.columns
    long_ = docs.unionAll(spark.createDataFrame([(9, "many words of one long text " * 60_000, "en", "s", 1, "x")], docs.schema))
    assert [r.n_words for r in outliers.contract(spark, long_).filter("doc_id = 9").collect()] == [360_000]


def test_kept_rows_are_the_judged_ones(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("row", F.lit(1)).withColumn("g0", F.lit("x"))
    docs = docs.unionAll(docs.limit(5))
    kept = Counter(r.doc_id for r in outliers.keep_documents(docs).collect())
    assert kept == Counter(r.id for r in outliers.judge(docs).filter("kept").collect()) and sum(kept.values()) > 100


# ---- 8 -----------------------------------------------------------------------------------------------------

def test_mix_targets_and_sampling(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), None if i % 10 == 9 else f"s{min(i % 10, 5)}") for i in range(800)]
    rows += [(900, None, "s1"), (901, "", "empty"), (None, "a b", "s2"), (5, "w w", "s3"), (5, "w w", "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text")).withColumn("size", F.lit(0))
    got = mixing.taken_words(docs).collect()
    again = mixing.taken_words(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    sizes, takes, targets = Counter(), Counter(), {}
    for r in got:
        sizes[r.src] += r.size
        takes[r.src] += r.taken
        targets[r.src] = r.target
        assert 0 <= r.taken <= 2 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, capped = {}, set()
    total = 1.5 * sum(sizes.values())
    while True:                                       # reshare the excess by weight until none is above
        open_w = sum(weight[s] for s in order if s not in capped)
        want = {s: 2 * sizes[s] if s in capped else (total - sum(2 * sizes[c] for c in capped)) * weight[s] / open_w for s in order}
        above = {s for s in order if s not in capped and want[s] > 2 * sizes[s]}
        if not above:
            break
        capped |= above
    for s in order:
        assert math.isclose(targets[s], want[s], rel_tol=1e-9, abs_tol=1e-9) and abs(takes[s] - targets[s]) <= 2
    mixed = mixing.repeat_documents(docs)
    assert mixed.columns == docs.columns
    n = mixed.select("source", F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    assert {r["source"]: r["n"] for r in n.collect()} == {s: t for s, t in takes.items() if t}
    assert mixing.contract(spark, docs.limit(0)).count() == 0 and mixing.repeat_documents(docs.limit(0)).count() == 0


def plain_take(rows):
    """(id, source, size) -> how often each is taken beyond the whole repetitions, given (id, source, size, place, rest)."""
    out = {}
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    for src, docs in by.items():
        docs.sort(key=lambda r: (r[3], r[2]))
        left, k = docs[0][4], 0
        while k < len(docs) and docs[k][2] <= left:
            left -= docs[k][2]
            k += 1
        chosen = docs[:k]
        near = sorted(docs[k:], key=lambda r: (abs(r[2] - left), r[3], r[2]))
        if near and abs(near[0][2] - left) < left:
            chosen.append(near[0])
        out[src] = Counter((r[0], r[2]) for r in chosen)
    return out


def mixed_rows():
    """Sources of many shapes: one of null ids with a third of all rows, alike rows, ties, one long document, empty ones."""
    rng = np.random.default_rng(4)
    rows = [(None, "w " * (1 + i % 3), "nobody") for i in range(400)]
    rows += [(7, "same words here", "alike")] * 300 + [(i, "x y z", "tied") for i in range(40)]
    rows += [(i, "w " * int(rng.integers(1, 90)), f"s{i % 5}") for i in range(100, 500)]
    rows += [(900, "long " * 5000, "s1"), (901, None, "s2"), (902, "", "empty"), (903, " a\tb\n c  d ", None)]
    return rows


@pytest.mark.parametrize("weights,share", [((5, 2, 1), 1.5), ((1,), 0.37), ((1, 3), 1.93), ((2, 1), 0.01)])
def test_mix_equals_plain_choice(spark, weights, share):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.taken_words(docs, weights=weights, share=share).toPandas()
    import hashlib
    def place(i, t):
        name = str(i) if i is not None else "-" + hashlib.md5((t or "").encode()).hexdigest()
        return hashlib.md5(f"{name}|42".encode()).hexdigest()
    target = {(None if s is None or s != s else s): (t, z) for s, t, z in zip(got.src, got.target, got.source_size)}
    plain = []
    for i, t, s in rows:
        want, size = target[s]
        whole = int(want // size) if size else 0
        plain.append((i, s, len((t or "").split()), place(i, t), math.floor(want) - whole * size))
    want = plain_take(plain)
    for s, (t, z) in target.items():
        mine = got[got.src == s] if s is not None else got[got.src.isna()]
        whole = int(t // z) if z else 0
        extra = Counter()
        for i, size, taken in zip(mine.id, mine["size"], mine.taken):
            assert size == 0 and taken == 0 or taken in (whole * size, (whole + 1) * size)
            if size and taken > whole * size:
                extra[(None if i != i else int(i), size)] += 1
        assert extra == Counter({k: v for k, v in want[s].items() if k[1]})
    mixed = Counter(tuple(r) for r in mixing.repeat_documents(docs, weights=weights, share=share).collect())
    for r in mixed:
        assert r in set(rows)
    for s in target:
        mine = got[got.src == s] if s is not None else got[got.src.isna()]
        assert sum(n * len(r[1].split()) for r, n in mixed.items() if r[2] == s) == mine.taken.sum()


# ---- 10 ----------------------------------------------------------------------------------------------------

def plain_links(v, c=0.9):
    ok = [i for i, x in enumerate(v) if x and None not in x and np.isfinite(x).all() and np.any(x)]
    near = defaultdict(set)
    for i in ok:
        for j in ok:
            if i < j and len(v[i]) == len(v[j]):
                a, b = np.array(v[i], float), np.array(v[j], float)
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= c:
                    near[i].add(j)
                    near[j].add(i)
    return near


def reach(near, i):
    seen, todo = {i}, [i]
    while todo:
        for j in near[todo.pop()] - seen:
            seen.add(j)
            todo.append(j)
    return min(seen)


def test_embedding_links_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    v = []
    for d in (3, 64):
        for _ in range(40):
            x = rng.normal(size=d)
            for _ in range(int(rng.integers(1, 6))):
                v.append((x + rng.normal(size=d) * 0.35 * rng.random()).astype(np.float32).tolist())
    v += [v[7]] * 30 + [[2 * x for x in v[7]]] + [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [None] + [1.0] * 63]
    near = plain_links(v)
    table = spark.createDataFrame([(i, x, "a", 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, raw string, node long")
    for interval in (2048, 16):                       # one interval, and many: pairs of intervals by descent
        got = {r.id: r for r in embeddings.near_duplicates(table, interval=interval).collect()}
        assert len(got) == len(v)
        for i in range(len(v)):
            assert (got[i].n_links, got[i].component) == (len(near[i]), reach(near, i)), i
            assert got[i].kept == (reach(near, i) == i)
    assert embeddings.contract(spark, table.limit(0)).count() == 0


def test_distant_intervals_are_skipped(spark):
    rows = [(i, [math.cos(i / 200), math.sin(i / 200), 0.0]) for i in range(1200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    eps = math.sqrt(0.2)
    classes = embeddings.unit_vectors(table, "vec_id", "embedding").select("raw", F.lit(1).cast("long").alias("weight"), F.col("id").alias("low"))
    blocks = embeddings.intervals(classes, eps, 3, 32, 1000)
    n = blocks.count()
    assert embeddings.near_intervals(blocks, eps, 3).count() < n * (n + 1) / 4


def test_intervals_are_sent_once_a_tile(spark):
    """the bytes shuffled grow by the strips, not by the pairs of intervals; links are the same for every size of strip."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(50, 6))[rng.integers(0, 50, 900)] + rng.normal(size=(900, 6)) * 0.15
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    classes = embeddings.unit_vectors(table, "vec_id", "embedding").select("raw", F.lit(1).cast("long").alias("weight"), F.col("id").alias("low"))
    eps = math.sqrt(0.2)
    blocks = embeddings.intervals(classes, eps, 3, 16, 1000)
    pairs, n = embeddings.near_intervals(blocks, eps, 3), blocks.count()
    assert n > 50
    each = {}
    for side in (4, 17, n):
        sent, strips = embeddings.tiles(blocks, pairs, side), -(-n // side)
        assert sent.groupBy("block").count().agg(F.max("count")).first()[0] <= strips + 1
        assert sent.select(F.sum(F.size("mates"))).first()[0] == pairs.count()
        each[side] = sorted(map(tuple, embeddings.links(blocks, pairs, 0.9, side).collect()))
    assert each[4] and each[4] == each[17] == each[n]
    assert embeddings.tile_side(blocks, 4) == -(-n // 4) and embeddings.tile_side(blocks.limit(0), 4) == 1


# ---- pipeline ----------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    stage = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in outliers.contract(spark, docs).filter("kept").collect()}
    one = stage["quality_rules"](spark, docs, SMALL).cache()
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    two = stage["line_dedup"](spark, one, SMALL).cache()
    assert two.count() == one.count() and two.columns == docs.columns
    three = stage["simhash_near_dedup"](spark, two, SMALL).cache()
    comp = near_text.contract(spark, two).collect()
    assert {r.doc_id for r in three.collect()} == {r.component_id for r in comp}
    four = stage["mix_sources"](spark, three, SMALL).cache()
    assert four.columns == docs.columns
    takes = mixing.taken_words(three).agg(F.sum("taken")).first()[0]
    assert four.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == takes
    five = stage["best_fit_packing"](spark, four, SMALL)
    assert five.filter("piece = 0").count() == four.count()
    assert five.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_pipeline_drops_short_lines_whatever_ends_them(spark):
    ends = ["", "\r", "\t", " \f", "\x0b"]
    docs = spark.createDataFrame([(i, f"Home\n\nRead more{ends[i % 5]}\nown {i}\nwe all say this{ends[i % 5]}", "en", f"s{i}", 1)
                                  for i in range(6)], DOCS)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {0: "Home\n\nRead more\nown 0\nwe all say this"} | {i: f"\nown {i}" for i in range(1, 6)}


def test_pipeline_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
