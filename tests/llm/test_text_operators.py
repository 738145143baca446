"""Operators 1, 2, 4, 5 and 9 against plain restatements of what they must return."""
import hashlib
import random
import re
import sys
import time
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm import lines, near_text, packing, personal_data, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# columns whose names the operators use inside
EXTRA = ", row long, id string, k_id string, fp long, kept boolean, t string, `at` int"


def words(rng, n):
    syllables = ["ba", "né", "ko", "li", "ß", "ru", "ting", "the", "ou"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def frame(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{i % 7}", len(t or "")) for i, t in enumerate(texts)]
    if extra:
        return spark.createDataFrame([r + (1, "x", "y", 2, True, "z", 3) for r in rows], DOCS + EXTRA)
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    rng = random.Random(5)
    return [None, "", " ", "\n", "a", "a b", "x" * 5000, words(rng, 30_000), words(rng, 40), words(rng, 40),
            "İΣ ΑΣ é é ﬁ 𝔸𝔹 😀 a\x1cb \x85\xa0c", "don't  we'RE <|endoftext|> x<|startoftext|>y '", "tie", "tie"]


# ---- 1: personal data --------------------------------------------------------------------------------------

def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        check = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and check % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in out)


def test_base_spans_match_plain_patterns(spark):
    rng = random.Random(1)
    bits = ["a.b@c.de", "@", "x@y", "+1 (234) 555-0199", "+12", "4111 1111 1111 1111", "4111111111111112", "1.2.3.4", "1.2.3.400",
            "0001.2.3.4.5", "١٢٣", "é", " ", "\n", "-", ".", "77-88", "word", "00000000000000", "a@b.c@d.e", "+(1)"]
    texts = [None, "", *("".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 25))) for _ in range(300))]
    got = {r.doc_id: r for r in personal_data.contract(spark, frame(spark, texts, True)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [
            base.count(f"{k}:") for k in ("email", "ip", "card", "phone")]


def test_emails_equal_the_plain_pattern():
    rng = random.Random(3)
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(20_000):
        t = "".join(rng.choice("ab@.-_ é\n%") for _ in range(rng.randint(1, 30)))
        assert personal_data.emails(t) == [m.span() for m in pattern.finditer(t)]


def test_very_long_runs(spark):
    """Runs of zeros beyond what int() takes, unbroken runs before an at sign, long lists of short numbers."""
    texts = ["0" * 5000 + ".1.1.1", "0" * 9000 + "1.2.3.400", "a" * 400_000 + "!x@y.zz", ("b" * 50 + "@") * 8000,
             " ".join(str(i % 1000) for i in range(40_000)), "x" * 300_000 + " [at] " + "y" * 300_000, "1" * 200_000]
    began = time.time()
    got = {r.doc_id: r for r in personal_data.contract(spark, frame(spark, texts)).collect()}
    assert time.time() - began < 60
    for i, t in enumerate(texts[:2] + ["skipped"] + texts[3:4]):
        if t != "skipped":
            assert got[i].base_sha256 == hashlib.sha256(plain_base(t).encode()).hexdigest()
    assert got[0].n_ip == 1 and got[1].n_ip == 0 and (got[2].n_email, got[2].spans) == (1, "email:400001:400007")


def plain_patterns(text, start, end):
    left, right = text[:start].rpartition("\n")[2], text[end:].partition("\n")[0]
    near = ["^", "^"] + [w.lower() for w in re.findall(r"\w+", left)][-2:]
    after = ([w.lower() for w in re.findall(r"\w+", right)] + ["$"])[0]
    form = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "0", text[start:end]))
    return [f"{near[-2]} {near[-1]} _", f"{near[-1]} _ {after}", f"{near[-1]} {form}"]


def test_patterns_equal_plain_ones():
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice(["ab", "é1", " ", "\n", "-", "7", "w" * 200, "."]) for _ in range(rng.randint(1, 20)))
        s, e = sorted(rng.sample(range(len(t) + 1), 2)) if len(t) > 1 else (0, 1)
        if "\n" not in t[s:e]:
            assert personal_data.Context(t).patterns(s, e) == plain_patterns(t, s, e)


def test_context_discovers_unseen_identifiers(spark):
    seeds = [f"please call now +1 (2{i:02d}) 555-01{i:02d} today friend" for i in range(20)]
    unseen = ["please call now 0455 555 0199 today friend"]
    clean = [f"order number 10{i:02d}345 was sent" for i in range(20)] + ["nothing here"]
    docs = frame(spark, seeds + unseen + clean)
    got = {r.doc_id: r for r in personal_data.contract(spark, docs).collect()}
    a = unseen[0].index("0455")
    assert got[20].spans == f"phone:{a}:{a + 13}" and got[20].n_phone == 0
    assert all(got[i].spans == "" for i in range(21, 42))
    assert personal_data.contract(spark, docs.limit(0)).count() == 0


def test_as_many_unseen_as_seeds_are_discovered(spark):
    seeds = [f"please call now +1 (2{i:02d}) 555-01{i:02d} today friend" for i in range(6)]
    unseen = [f"please call now 04{i:02d}5550199 today friend" for i in range(6)]
    next_ = [f"ring 04{i:02d}5550199 at home" for i in range(6)] + ["ring 0499 5550188 at home"]
    # five cards and as many strings of their form that fail the check digit: the context is no evidence
    paid = [f"paid by {n} then" for n in ("4111111111111111", "5500000000000004", "340000000000009", "30000000000004",
                                          "6011000000000004", *(f"411111111111112{i}" for i in range(5)))]
    docs = frame(spark, seeds + unseen + next_ + paid + ["paid by 12345678 then"])
    got = {r.doc_id: r.spans for r in personal_data.contract(spark, docs).collect()}
    texts = seeds + unseen + next_
    for i, t in enumerate(texts[6:], 6):
        a = re.search("[0-9]", t).start()
        assert got[i] == f"phone:{a}:{max(m.end() for m in re.finditer('[0-9]', t))}"
    assert [got[i].partition(":")[0] for i in range(19, 24)] == ["card"] * 5
    assert all(got[i] == "" for i in range(24, 30))


def test_numbers_beside_base_spans_and_in_lists(spark):
    t = "host 10.20.30.40 5551234567"
    assert personal_data.candidates(t, personal_data.base_spans(t)) == [(17, 27)]
    t = "card 4111111111111111. 0455 555 0199"
    assert t.index("0455") in {s for s, e in personal_data.candidates(t, personal_data.base_spans(t)) if e == len(t)}
    many = " ".join(str(5550000000 + i) for i in range(30))
    assert {many[s:e] for s, e in personal_data.candidates(many, [])} >= set(many.split()) | {many}
    # a seed's context, then: a number after an address, a list of two
    seeds = [f"please call now +1 (2{i:02d}) 555-01{i:02d} today friend" for i in range(6)]
    seeds += [f"host 10.20.30.{i} +1 (3{i:02d}) 555-01{i:02d} up" for i in range(6)]
    tails = ["host 10.20.30.99 5551234567 up", "please call now 5551234567 5559876543 20"]
    texts = [re.sub(r"(?<=host 10\.20\.30\.)[0-5] ", "9 ", s) for s in seeds] + [tails[0].replace("99", "9"), tails[1]]
    got = {r.doc_id: r.spans.split(",") for r in personal_data.contract(spark, frame(spark, texts)).collect()}
    a, b = texts[12].index("555"), texts[13].index("555")
    assert f"phone:{a}:{a + 10}" in got[12] and f"phone:{b}:{b + 10}" in got[13]


# ---- 2: token counts ---------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def fst():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return token_counts.CountTransducer(f.read())


def test_transducer_and_chunk_maps_equal_library(fst):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    bits = ["<|endoftext|>", "'re", "'x", "  ", " ", "\n", "don't", "...", "12", "é", "日本", "\x1c", "\xa0", "𝔸", "the", "ing", "zz", "<|"]
    for _ in range(1500):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        n = len(lib.encode(s, add_special_tokens=False).ids)
        for size in (1, 3, 7, 1000):
            maps = [token_counts.chunk_map(fst, s[k:k + size]) for k in range(0, len(s), size)]
            assert token_counts.closed(fst, token_counts.scan(fst, maps)) == n, (s, size)


def test_compose_is_associative(fst):
    rng = random.Random(3)
    for _ in range(200):
        a, b, c = (token_counts.chunk_map(fst, words(rng, rng.randint(0, 3))[rng.randint(0, 4):]) for _ in range(3))
        left = token_counts.compose(fst, token_counts.compose(fst, a, b), c)
        assert left == token_counts.compose(fst, a, token_counts.compose(fst, b, c))


def test_synchronising_positions_in_any_script(fst):
    """Chinese, Japanese, Korean and digits: maps hold short ends, not texts; cuts anywhere give the library's counts."""
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    bits = ["中文字", "，", "。", "カナ", "ひら", "한국", "!", "'s", " ", "  ", "42", "7 8", "x", "é", "😀", "<|endoftext|>", "\n", "「", "」", "’", "ー", "《a》"]
    for _ in range(400):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))
        n = len(lib.encode(t, add_special_tokens=False).ids)
        size = rng.randint(1, 9)
        maps = [token_counts.chunk_map(fst, t[k:k + size]) for k in range(0, len(t), size)]
        assert token_counts.closed(fst, token_counts.scan(fst, maps)) == n, (t, size)
    for t in ("中文字句，再一句。" * 3000, "12 345 6 " * 4000, "한국어 문장 " * 3000):
        is_open, head, _, tail = token_counts.chunk_map(fst, t)
        assert not is_open and len(head) + len(tail) < 20


def test_token_counts_equal_library(spark):
    texts = odd_texts()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_counts.contract(spark, frame(spark, texts, True)).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        spec = f.read()
    for size in (1, 40):                              # chunks cut anywhere, composed over the shuffle
        few = frame(spark, texts[:5] + [texts[9]] + texts[10:])
        by_chunk = {r.id: r.n_tokens for r in token_counts.token_counts(few, spec, chunk=size).collect()}
        assert [by_chunk[i] for i in range(len(by_chunk))] == [
            len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts[:5] + [texts[9]] + texts[10:]]
    empty = frame(spark, ["x"]).limit(0)
    assert token_counts.contract(spark, empty).count() == 0
    twice = frame(spark, ["same text"]).unionAll(frame(spark, ["same text"]))
    assert [r.n_tokens for r in token_counts.contract(spark, twice).collect()] == [2, 2]


# ---- 4: packing --------------------------------------------------------------------------------------------

def test_pieces_and_places(spark):
    rng = random.Random(4)
    texts = odd_texts() + [words(rng, rng.randint(1, 900)) for _ in range(150)] + ["copy"] * 40
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.contract(spark, frame(spark, texts, True)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        got = sorted(by_doc[i], key=lambda r: r.piece)
        want = [(k, s, min(2048, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 2048))]
        assert [(r.piece, r.start, r.length) for r in got] == want
        for r in got:
            raw = b"".join(x.to_bytes(4, "little") for x in ids[r.start:r.start + r.length])
            assert r.ids_crc32 == zlib.crc32(raw)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(by_seq) <= least + 1
    assert packing.contract(spark, frame(spark, ["x"]).limit(0)).count() == 0


def test_histogram_plan_is_the_sequential_one():
    """Bin after bin on single pieces gives the same bins as the run-length plan."""
    rng = random.Random(6)
    for _ in range(40):
        cap = rng.choice([10, 30])
        left = [rng.randint(1, cap) for _ in range(rng.randint(1, 60))]
        plan = packing.best_two_fit({x: left.count(x) for x in set(left)}, cap)
        bins = [sorted(x for x, k in contents for _ in range(k)) for contents, times in plan for _ in range(times)]
        assert sorted(x for b in bins for x in b) == sorted(left) and all(sum(b) <= cap for b in bins)
        for got in bins:
            box, gap = [], cap
            for x in sorted(left, reverse=True):
                if x <= gap:
                    box.append(x)
                    gap -= x
            rest = list(left)
            for x in box:
                rest.remove(x)
            small, best = min(box), 0
            for i, a in enumerate(rest):
                for b in rest[i + 1:]:
                    if best < a + b <= gap + small:
                        best = a + b
            if gap and best > small:
                assert sum(got) == sum(box) - small + best
            else:
                assert got == sorted(box)
            for x in got:
                left.remove(x)


# ---- 5: SimHash --------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def near_copies(rng):
    texts = []
    for _ in range(25):
        w = words(rng, 300).split()
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 6)):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = "zz"
            texts.append(" ".join(v))
    return texts + [texts[0]] * 20


def test_simhash_equals_all_pairs(spark):
    texts = odd_texts() + near_copies(random.Random(7))
    got = {r.doc_id: r for r in near_text.contract(spark, frame(spark, texts, True)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    roots = plain_components(fps)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i].fingerprint == f"{fps[i]:016x}" and got[i].component_id == roots[i]
    assert len(set(roots)) < len(set(fps))            # links between different fingerprints are among them
    kept = near_text.drop_near_duplicates(frame(spark, texts, True))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots)) and len(kept.columns) == 12
    twice = frame(spark, texts).unionAll(frame(spark, texts))
    assert near_text.drop_near_duplicates(twice).count() == len(set(roots))
    assert near_text.contract(spark, frame(spark, ["x"]).limit(0)).count() == 0


# ---- 9: lines ----------------------------------------------------------------------------------------------

def plain_lines(rows):
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\x0b\f"):
                sites[line.strip(" \t\r\x0b\f")].add(s)
                first.setdefault(line.strip(" \t\r\x0b\f"), (i, k))
    out = {}
    for i, t, s in rows:
        keep = [line for k, line in enumerate((t or "").split("\n"))
                if len(sites[line.strip(" \t\r\x0b\f")]) < 5 or first[line.strip(" \t\r\x0b\f")] == (i, k)]
        out[i] = "\n".join(keep)
    return out


def test_lines_equal_plain_counts(spark):
    rng = random.Random(8)
    pool = [words(rng, n) for n in range(1, 30)]
    texts = odd_texts() + ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 9}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", s, 1, 2, "a", "b", 3, True, "c", 4) for i, t, s in rows], DOCS + EXTRA)
    want = plain_lines(rows)
    got = {r.doc_id: r for r in lines.clean_documents(docs).collect()}
    for i, t, _ in rows:
        assert got[i].text == (None if t is None else want[i])
    assert any(want[i] != (t or "") for i, t, _ in rows)
    out = {r.doc_id: r for r in lines.contract(spark, docs).collect()}
    assert all(out[i].text_sha256 == hashlib.sha256(want[i].encode()).hexdigest() for i, _, _ in rows)
    assert lines.clean_documents(docs.limit(0)).count() == 0


def test_short_lines_are_boilerplate_too(spark):
    docs = spark.createDataFrame([(i, f"Home\r\nown text of page {i}\n\n \n\tRead more", "en", f"s{i % 8}", 1) for i in range(16)], DOCS)
    out = {r.doc_id: r for r in lines.contract(spark, docs).collect()}
    assert [out[i].n_removed for i in range(16)] == [0] + [2] * 15 and {r.n_lines for r in out.values()} == {5}
    assert out[9].text_sha256 == hashlib.sha256(b"own text of page 9\n\n ").hexdigest()


def test_lines_near_the_threshold_are_counted_exactly(spark):
    docs = spark.createDataFrame([(i, f"line seen on {k} sites\nown line number {i} {k}", "en", f"s{s}", 1)
                                  for i, (k, s) in enumerate((k, s) for k in (3, 4, 5, 6, 40) for s in range(k))], DOCS)
    found = lines.boilerplate(lines.line_table(docs, "doc_id", "text", "source", 3))
    assert sorted(r.n_sites for r in found.collect()) == [5, 6, 40]


def test_simhash_hot_group_is_folded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("the same text here")).otherwise(
        F.concat(F.lit("own text number "), F.col("id").cast("string"))).alias("text"))
    got = near_text.contract(spark, docs).filter("doc_id % 3 > 0")
    assert got.filter("component_id = 1").count() == 2000


def test_encoder_memo_stays_bounded(monkeypatch):
    """Ids stay the library's when the memos start anew; full memos of common runs take at most 250 MB a worker process."""
    limit = packing.MEMO
    enc, tok = packing.WordEncoder(packing.word_spec()), Tokenizer.from_str(packing.word_spec().decode())
    rng = random.Random(2)
    enc.encode(words(rng, 4000))
    entry = sum(map(sys.getsizeof, [*enc.memo, *enc.memo.values()])) / len(enc.memo)
    assert (entry + 100) * limit * 5 / 3 < 250e6             # 100 bytes: a dictionary's slots; two thirds more: pre-tokens
    monkeypatch.setattr(packing, "MEMO", 60)
    for i in range(60):
        text = f"the cat's {words(rng, 12)} x{i} the"
        want = b"".join(t.to_bytes(4, "little") for t in tok.encode(text, add_special_tokens=False).ids)
        assert enc.encode(text) == want and len(enc.memo) <= 60
