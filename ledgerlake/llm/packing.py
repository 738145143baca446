"""Operator 4: best-two-fit packing of token sequences.

Where a piece goes depends on its length only, and there are at most ``cap`` lengths.  So the packing is worked
out on the histogram of lengths: one greedy bin after the other, as many equal bins at a time as the
histogram holds.  The pieces themselves then find their bin by their rank among the pieces of their
length, which takes one prefix count per (partition, length) and no sort.
"""
from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.char_classes import SPACE, Matcher
from ledgerlake.llm.common import prepare_python, worker_memo
from ledgerlake.session import cut_lineage

CAP, END_ID, MEMO, BLOCK = 2048, 0, 600_000, 1 << 20
# The word-level BPE's pre-token pattern (what is between the matches is dropped); the last
# alternative only separates runs.
PRE_TOKEN = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+|\n"


class WordEncoder:
    """Token ids (little-endian uint32 bytes) of whole texts, equal to the tokenizer library's.

    No pre-token and no step of the normalizer spans white space.  So a text is looked up blank-separated run by
    run in a bounded memo of each worker process.  A new run is split into pre-tokens, which have a memo of their own,
    and only new pre-tokens go to the library, a few hundred at once.  Texts that contain one of the file's special
    strings go to the library whole."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec.decode())
        self.words = Matcher(PRE_TOKEN)
        self.runs = re.compile(f"[^{SPACE}]+")
        self.controls = re.compile("[\\x1c-\\x1f]")   # str.split() takes these for white space
        self.special = re.compile("|".join(
            re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or r"(?!)")
        self.memo: dict[str, bytes] = {}
        self.word_memo: dict[str, bytes] = {}

    def ids_of(self, words: set[str]) -> None:
        """Have the library encode those ``words`` (normalised pre-tokens) that their memo doesn't hold."""
        memo = self.word_memo
        new = [w for w in words if w not in memo]
        if len(memo) + len(new) > MEMO * 2 // 3:
            memo.clear()
            new = list(words)
        for lo in range(0, len(new), 400):
            part = new[lo:lo + 400]
            got = self.tok.encode(" ".join(part), add_special_tokens=False)
            at = (4 * np.searchsorted(np.array(got.word_ids, dtype=np.int64), np.arange(len(part) + 1))).tolist()
            ids = np.array(got.ids, dtype="<u4").tobytes()
            memo.update(zip(part, [ids[x:y] for x, y in zip(at, at[1:])]))

    def learn(self, missing: set[str]) -> None:
        """Enter runs that the memo doesn't hold (a full memo starts anew)."""
        memo, new = self.memo, list(missing)
        if len(memo) + len(new) > MEMO:
            memo.clear()
        joined = "\n".join(new)
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ")      # lower() is context-free
        words = self.words.findall(joined.lower())    # a line feed between the runs
        distinct = set(words)
        distinct.discard("\n")
        self.ids_of(distinct)
        known, parts, out = self.word_memo, [], []
        for w in words:
            if w == "\n":
                out.append(b"".join(parts))
                parts = []
            else:
                parts.append(known[w])
        out.append(b"".join(parts))
        memo.update(zip(new, out))

    def block(self, text: str) -> bytes:
        runs = self.runs.findall(text) if self.controls.search(text) else text.split()
        parts = list(map(self.memo.get, runs))
        missing = [i for i, ids in enumerate(parts) if ids is None]
        if missing:
            self.learn({runs[i] for i in missing})
            memo = self.memo
            for i in missing:
                parts[i] = memo[runs[i]]
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        if self.special.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(text) <= BLOCK:
            return self.block(text)
        out, at = [], 0                               # very long texts: cut before a blank
        while at < len(text):
            end = min(len(text), at + BLOCK)
            while end < len(text) and text[end] not in " \n":
                end += 1
            out.append(self.block(text[at:end]))
            at = end
        return b"".join(out)


@worker_memo
def encoder(spec: bytes) -> WordEncoder:
    return WordEncoder(spec)


def pieces(docs: DataFrame, spec: bytes, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth): every text's ids and a closing 0, cut only where longer than
    ``cap``.  ``part`` is the task, ``nth`` the piece's rank among the task's pieces of its length."""
    spark = docs.sparkSession
    prepare_python(spark)
    shipped = spark.sparkContext.broadcast(spec)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.lit(0).cast("long")
    schema = src.select("id", F.lit(0).alias("piece"), long.alias("start"), long.alias("length"),
                        long.alias("ids_crc32"), F.lit(0).alias("part"), long.alias("nth")).schema

    def run(batches):
        enc, seen, part = encoder(shipped.value), np.zeros(cap + 1, dtype=np.int64), TaskContext.get().partitionId()
        for b in batches:
            take, rows = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = enc.encode(text) + END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, cap)):
                    length = min(cap, n - start)
                    take.append(i)
                    rows.append((k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), seen[length]))
                    seen[length] += 1
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(take, pa.int64())), pa.array(cols[0], pa.int32()),
                 *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array([part] * len(rows), pa.int32()),
                 pa.array(cols[4], pa.int64())], names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"])
    return src.mapInArrow(run, schema)


def best_two_fit(histogram: dict[int, int], cap: int = CAP) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for ``histogram`` (length -> number of pieces): a list of (contents, times), contents being
    (length, how many) in the order of placement.

    A bin is filled greedily with the longest piece that still fits.  Then its smallest piece gives way to two
    unpacked pieces that fill its expanded gap more tightly, the tightest pair there is (of equals, the one with
    the longest piece).  The bin is repeated while the histogram holds its contents."""
    left = np.zeros(cap + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan = []
    while left.any():
        gap, used = cap, {}
        while True:
            fit = np.flatnonzero(left[1:gap + 1] > 0) if gap else ()
            fit = [x + 1 for x in fit[::-1] if left[x + 1] > used.get(x + 1, 0)][:1] if len(fit) else []
            if not fit:
                break
            length = int(fit[0])
            k = min(int(left[length]) - used.get(length, 0), gap // length)
            used[length] = used.get(length, 0) + k
            gap -= k * length
        small = min(used)
        room = gap + small
        pair = (small, 0)
        if gap:
            free = left[:room + 1].copy()
            for length, k in used.items():
                if length <= room:
                    free[length] -= k
            sizes = [int(x) for x in np.flatnonzero(free > 0)]
            lo, hi = 0, len(sizes) - 1
            while lo <= hi:                           # two pointers over the lengths: the largest sum within room
                a, b = sizes[hi], sizes[lo]
                if a + b > room or (lo == hi and free[a] < 2):
                    hi -= 1
                    continue
                pair = max(pair, (a + b, a))
                lo += 1
        if pair[0] > small:
            used[small] -= 1
            for x in (pair[1], pair[0] - pair[1]):
                used[x] = used.get(x, 0) + 1
        bin_ = [(length, k) for length, k in used.items() if k]
        times = min(int(left[length]) // k for length, k in bin_)
        for length, k in bin_:
            left[length] -= times * k
        plan.append((bin_, times))
    return plan


_RANKS = 1 << 44                                      # more pieces of one length than any corpus has


def slots(plan: list[tuple[list[tuple[int, int]], int]]) -> pd.DataFrame:
    """One row per (bin pattern, length): from which rank of the length on, which sequences, where in them."""
    rows, rank, sequence = [], {}, 0
    for contents, times in plan:
        offset = 0
        for length, k in contents:
            first = rank.get(length, 0)
            rows.append((length * _RANKS + first, first, sequence, k, offset))
            rank[length] = first + k * times
            offset += k * length
        sequence += times
    return pd.DataFrame(rows, columns=["key", "first", "sequence", "k", "offset"], dtype="int64").sort_values("key")


def pack(docs: DataFrame, spec: bytes, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0 in each sequence).

    The pieces (some 40 bytes each) are written once to the shared folder, which fixes their ``part`` and
    ``nth``.  The driver sees the histogram only: at most ``cap`` rows.  A length that a third of
    all pieces have is ranked by its per-task counts, so no task gathers it.  Null and empty texts are one piece of
    length 1; repeated rows are packed each; an empty table gives an empty result."""
    spark = docs.sparkSession
    got = cut_lineage(pieces(docs, spec, id_col, text_col, cap), "pieces")
    counts = cut_lineage(got.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = counts.select("length", "part", (F.sum("n").over(
        Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    plan = spark.sparkContext.broadcast({c: v.to_numpy() for c, v in slots(best_two_fit(histogram, cap)).items()})
    # the offsets grow with the number of tasks: merged, never broadcast
    ranked = got.join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    cols = ["id", "piece", "start", "length", "ids_crc32"]
    schema = ranked.select(*cols, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def place(batches):
        p = plan.value
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(p["key"], length * _RANKS + rank, side="right") - 1
            within = rank - p["first"][i]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in cols), pa.array(p["sequence"][i] + within // p["k"][i], pa.int64()),
                 pa.array(p["offset"][i] + within % p["k"][i] * length, pa.int64())], names=schema.names)
    return ranked.select(*cols, "rank").mapInArrow(place, schema)


def word_spec(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


def contract(spark, docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(docs, word_spec(path)).withColumnRenamed("id", "doc_id")
