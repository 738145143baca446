"""Operator 12: fill-in-the-middle transformation over a learned rank index of each text's unit boundaries.

The boundaries of a text's units (code points, words or lines) are byte offsets in its UTF-8 form.  The index is a piecewise-linear
model from a boundary's rank to its offset: segments fitted in one pass, each within a stated error of all its
boundaries, and the residuals of all boundaries.  A cut after k units is predicted by the segment that holds rank k and
corrected by the stored residual, which gives the exact offset, so a cut never scans the text.
"""
from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import output_schema, prepare_python

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT, SPM_PERCENT, SEED = 90, 20, "1"
MAX_ERROR, SEGMENT = 16, 1 << 15
WORD_END = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


@dataclass
class RankIndex:
    """Segments (first rank, offset there, slope) and the residual of every boundary from its segment's prediction."""
    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[at] + np.floor(self.slope[at] * (ranks - self.first[at])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact byte offsets of the boundaries with these ranks."""
        return self.predict(ranks) + self.residual[ranks]

    @property
    def units(self) -> int:
        return len(self.residual) - 1

    def pack(self) -> tuple[bytes, bytes]:
        """(segments, residuals) as binary columns: 24 bytes a segment, one byte a boundary."""
        return (np.stack([self.first, self.base, self.slope.view(np.int64)]).tobytes(), self.residual.tobytes())

    @staticmethod
    def unpack(segments: bytes, residuals: bytes) -> RankIndex:
        first, base, slope = np.frombuffer(segments, dtype=np.int64).reshape(3, -1)
        return RankIndex(first, base, slope.view(np.float64), np.frombuffer(residuals, dtype=np.int8))


def longest_segment(y: np.ndarray, max_error: int) -> tuple[int, float]:
    """(how many of the offsets ``y`` one line through the first one meets within ``max_error``, its slope).

    A cone of slopes narrows with every boundary; the segment ends where it is empty."""
    low, high, done, step = -np.inf, np.inf, 1, 256
    while done < len(y):
        part = y[done:done + step]
        run = np.arange(done, done + len(part), dtype=np.float64)
        rise = (part - y[0]).astype(np.float64)
        lows = np.maximum.accumulate(np.maximum((rise - max_error) / run, low))
        highs = np.minimum.accumulate(np.minimum((rise + max_error) / run, high))
        bad = np.flatnonzero(lows > highs)
        if len(bad):
            k = bad[0]
            if k:
                low, high = lows[k - 1], highs[k - 1]
            done += k
            break
        low, high, done, step = lows[-1], highs[-1], done + len(part), step * 4
    return done, (low + high) / 2 if done > 1 else 0.0


def fit(blocks, max_error: int = MAX_ERROR) -> RankIndex:
    """The index of boundary offsets that come in ascending blocks, each fitted by itself, so that the offsets are never all
    held: memory is a byte a boundary and one block."""
    first, base, slope, residual, rank = [], [], [], [np.empty(0, np.int8)], 0
    for y in blocks:
        at = 0
        while at < len(y):
            n, m = longest_segment(y[at:], max_error)
            guess = y[at] + np.floor(m * np.arange(n)).astype(np.int64)
            first.append(rank + at)
            base.append(y[at])
            slope.append(m)
            residual.append((y[at:at + n] - guess).astype(np.int8))
            at += n
        rank += len(y)
    return RankIndex(np.array(first, np.int64), np.array(base, np.int64), np.array(slope), np.concatenate(residual))


def boundaries(raw: bytes, unit: str = "char"):
    """Blocks of the ascending byte offsets at which units end, 0 first.  A word ends after the white space that follows it
    (white space before the first word belongs to it); a line after its newline."""
    if unit == "char":
        for at in range(0, len(raw), SEGMENT):
            part = np.frombuffer(raw, np.uint8, min(SEGMENT, len(raw) - at), at)
            starts = np.flatnonzero((part & 0xC0) != 0x80).astype(np.int64) + at
            if len(starts):
                yield starts
        yield np.array([len(raw)], np.int64)
        return
    ends, last = [0], 0
    found = WORD_END.finditer(raw) if unit == "word" else re.finditer(rb"[^\n]*\n|[^\n]+", raw)
    for m in found:
        last = m.end()
        ends.append(last)
        if len(ends) == SEGMENT:
            yield np.array(ends, np.int64)
            ends = []
    if last < len(raw):                                # white space alone is one unit
        ends.append(len(raw))
    if ends:
        yield np.array(ends, np.int64)


def draws(id_: object, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from the sha256 of seed, colon and id (a null id: nothing)."""
    h = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).digest()
    return tuple(int.from_bytes(h[i:i + 4], "big") for i in (0, 4, 8, 12))


def transform(text: str, id_: object, unit: str = "char", seed: str = SEED, max_error: int = MAX_ERROR):
    """(units, form, cut 1, cut 2 in units, byte offsets of both, output).  Cuts and offsets are None in a plain document."""
    raw = text.encode()
    index = fit(boundaries(raw, unit), max_error)
    h1, h2, h3, h4 = draws(id_, seed)
    n = index.units
    if not raw or h3 % 100 >= FIM_PERCENT or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, None, None, text
    cuts = np.array(sorted((h1 % (n + 1), h2 % (n + 1))), np.int64)
    a, b = index.offsets(cuts).tolist()
    prefix, middle, suffix = raw[:a].decode(), raw[a:b].decode(), raw[b:].decode()
    if h4 % 100 < SPM_PERCENT:
        form, out = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, out = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, int(cuts[0]), int(cuts[1]), a, b, out


def restore(output: str, form: str) -> str:
    """The text of a transformed document.  No mark lies in a transformed text, and none can arise where text meets a mark
    (each begins with <), so the first of each kind is the mark."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    first, _, rest = output.removeprefix(one).partition(two)
    second, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: str = SEED,
                   max_error: int = MAX_ERROR) -> DataFrame:
    """Per row of ``docs``: id, n (units), form, cut_1, cut_2 (units before the middle and before the suffix), byte_1, byte_2 (where
    those cuts lie in the UTF-8 text) and ``output``.

    Nine of ten documents are cut at two places drawn from their id: prefix, suffix, middle (psm) or, one in five of those, suffix,
    prefix, middle (spm).  Plain ones stay as they are: the tenth, empty texts and texts that hold a mark.  Null
    texts are empty; rows that repeat an id draw alike; a null id draws as an empty one; an empty table gives an empty result.
    Nothing is shuffled; a text's index takes a byte a boundary."""
    if unit not in ("char", "word", "line"):
        raise ValueError(f"unit is char, word or line, not {unit}")
    prepare_python(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long_ = F.lit(0).cast("long")
    names = ["n", "form", "cut_1", "cut_2", "byte_1", "byte_2", "output"]
    schema = output_schema(src.select("id", *[(F.lit("") if c in ("form", "output") else long_).alias(c) for c in names]))

    def run(batches):
        types = [pa.string() if c in ("form", "output") else pa.int64() for c in names]
        for b in batches:
            rows = [transform(t or "", i, unit, seed, max_error)
                    for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist())]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             names=schema.names)
    return src.mapInArrow(run, schema)


def rank_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char",
               max_error: int = MAX_ERROR) -> DataFrame:
    """Per row of ``docs``: id, n (units), ``segments`` and ``residuals`` (RankIndex.unpack reads them), n_segments: the
    stored index, from which cuts for other seeds are read off without the text."""
    prepare_python(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = output_schema(src.select("id", F.lit(0).cast("long").alias("n"), F.lit(b"").alias("segments"), F.lit(b"").alias("residuals"),
                        F.lit(0).cast("long").alias("n_segments")))

    def run(batches):
        for b in batches:
            made = [fit(boundaries((t or "").encode(), unit), max_error) for t in b.column("text").to_pylist()]
            packed = [m.pack() for m in made]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([m.units for m in made], pa.int64()), pa.array([p[0] for p in packed], pa.binary()),
                 pa.array([p[1] for p in packed], pa.binary()), pa.array([len(m.first) for m in made], pa.int64())],
                names=schema.names)
    return src.mapInArrow(run, schema)


def _digests(made: DataFrame) -> DataFrame:
    """``made`` with output_sha256, and restored_sha256 of the text rebuilt from output and form; without the output."""
    kept = [c for c in made.columns if c != "output"]
    schema = output_schema(made.select(*kept, F.lit("").alias("output_sha256"), F.lit("").alias("restored_sha256")))

    def run(batches):
        def sha(t):
            return hashlib.sha256(t.encode()).hexdigest()
        for b in batches:
            out, form = b.column("output").to_pylist(), b.column("form").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(map(sha, out), pa.string()),
                 pa.array([sha(restore(o, f)) for o, f in zip(out, form)], pa.string())], names=schema.names)
    return made.mapInArrow(run, schema)


def contract(spark, docs: DataFrame) -> DataFrame:
    return _digests(fill_in_middle(docs)).select(
        F.col("id").alias("doc_id"), "n", "form", F.col("cut_1").alias("prefix_chars"),
        (F.col("cut_2") - F.col("cut_1")).alias("middle_chars"), "output_sha256", "restored_sha256")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                     WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
