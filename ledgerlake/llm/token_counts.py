"""Operator 2: token counts by a tokenizer compiled to a deterministic counting transducer.

The byte-level BPE vocabulary is compiled to a transducer whose state, after each byte of a pre-token, is the
last token of the encoding of the bytes read (it determines the rest).  Every transition is annotated
with the tokens it emits: the number of tokens up to where the last token starts, plus one, less the number
before (so a transition that merges earlier tokens emits a negative count).  Reading a whole pre-token from
the start state is one macro transition; its total is memoised in a bounded table.

A text is cut into chunks at arbitrary code points.  A chunk's state map is ``(open, head, count, tail)``:
whatever state the left neighbour ends in, it is a pre-token start after ``head`` (up to the chunk's
first synchronising position), ``count`` tokens follow, and ``tail`` is what the chunk leaves open.  A chunk without
such a position (one run of letters or digits, or of blanks and marks, throughout) is ``open``: its map is just its text.  Maps compose associatively (``compose``), so
the chunks of a text are scanned in parallel and combined in one aggregation.
"""
from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.char_classes import Matcher
from ledgerlake.llm.common import prepare_python, worker_memo

CHUNK, MEMO, PAIRS = 1 << 16, 1_200_000, 800_000
LIMIT = 512
# The byte-level BPE's pre-token pattern.
PRE_TOKEN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
# Characters that are letters or digits, and others that are marks, in every version of Unicode.
WORD, MARK = "A-Za-z0-9\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3", "\u3001\u3002\u300a-\u3011\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
# Positions that always begin a pre-token, whatever stands further left or right: the space between two word characters (it
# belongs to what follows), and the places between a word character and a mark (no alternative of the pattern holds both).
_SYNC = f"(?<=[{WORD}]) (?=[{WORD}])|(?<=[{WORD}])(?=[{MARK}])|(?<=[{MARK}])(?=[{WORD}])"
SYNC, LAST_SYNC = regex.compile(_SYNC), regex.compile("(?r)" + _SYNC)


def byte_letters() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class CountTransducer:
    """Counts the tokens of a text as the tokenizer file's own library does (its specials matched in the text)."""

    def __init__(self, spec: bytes):
        spec = json.loads(spec)
        letters = byte_letters()
        model = spec["model"]
        self.ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.rank = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[bytes(letters[c] for c in a), bytes(letters[c] for c in b)] = r
        self.back: dict = {}                          # trie of reversed tokens: steps to all tokens ending here
        for t in self.ids:
            node = self.back
            for x in reversed(t):
                node = node.setdefault(x, {})
            node[-1] = t
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        if any(SYNC.search(t) for t in self.specials):
            raise ValueError("a special string holds a synchronising position")
        self.split = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.words = Matcher(PRE_TOKEN)
        self.memo: dict[str, int] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, s: bytes) -> list[bytes]:
        """Plain BPE: merge the lowest-ranked pair, leftmost first, until none is left."""
        parts = [s[i:i + 1] for i in range(len(s))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def adjacent(self, a: bytes, b: bytes) -> bool:
        """Whether token ``b`` can follow token ``a``: their joined bytes encode to exactly these two."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return ok

    def emitted(self, piece: bytes) -> list[int]:
        """Run the transducer over one pre-token: the token count annotated on each byte's transition."""
        last: list[bytes] = [b""]
        total, out = [0], []
        for i in range(1, len(piece) + 1):
            node, ends, j = self.back, [], i
            while j and (node := node.get(piece[j - 1])) is not None:
                j -= 1
                if -1 in node:
                    ends.append(node[-1])
            for t in reversed(ends):                  # exactly one suffix token continues the prefix's encoding
                k = i - len(t)
                if k == 0 or self.adjacent(last[k], t):
                    last.append(t)
                    total.append(total[k] + 1)
                    break
            out.append(total[i] - total[i - 1])
        return out

    def macro(self, word: str) -> int:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        raw = word.encode()
        n = self.memo[word] = 1 if raw in self.ids and len(self.merged(raw)) == 1 else sum(self.emitted(raw))
        return n

    def plain(self, text: str) -> int:
        memo, words = self.memo, self.words.findall(text)
        try:
            return sum([memo[w] for w in words])
        except KeyError:
            return sum([memo[w] if w in memo else self.macro(w) for w in words])

    def count(self, text: str) -> int:
        """Tokens of a string that starts and ends at pre-token boundaries."""
        if self.split is None or "<" not in text:
            return self.plain(text)
        parts = self.split.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


@worker_memo
def compiled(spec: bytes) -> CountTransducer:
    """One transducer for each worker process and tokenizer file; its memo outlives the tasks."""
    return CountTransducer(spec)


def chunk_map(fst: CountTransducer, text: str) -> tuple[bool, str, int, str]:
    """The state map of one chunk: (open, head, count, tail)."""
    first = SYNC.search(text)
    if first is None:
        return True, text, 0, ""
    p, q = first.start(), LAST_SYNC.search(text).start()           # the last one is looked for from the end
    return False, text[:p], fst.count(text[p:q]), text[q:]


def known_ends(fst: CountTransducer, text: str, first: bool, last: bool) -> tuple:
    """The map of a chunk; a text's first chunk is read from the start state, its last up to the end of text: nothing stays open
    there, and a text of one chunk is read as it is."""
    if first and last:
        return False, "", fst.count(text), ""
    is_open, head, n, tail = m = chunk_map(fst, text)
    if is_open:
        return m
    return False, "" if first else head, n + (fst.count(head) if first else 0) + (fst.count(tail) if last else 0), "" if last else tail


def compose(fst: CountTransducer, left: tuple, right: tuple) -> tuple:
    """The map of two neighbouring spans (associative)."""
    lo, lh, lc, lt = left
    ro, rh, rc, rt = right
    if lo:
        return ro, lh + rh, rc, rt
    if ro:
        return False, lh, lc, lt + rh
    return False, lh, lc + fst.count(lt + rh) + rc, rt


def closed(fst: CountTransducer, m: tuple) -> int:
    """Tokens of the whole text whose composed map is ``m``: from the start state to the end of text."""
    is_open, head, n, tail = m
    return fst.count(head) if is_open else fst.count(head) + n + fst.count(tail)


def scan(fst: CountTransducer, maps: list[tuple]) -> tuple:
    """Pairwise (tree) reduction of the maps in text order."""
    maps = list(maps) or [(True, "", 0, "")]
    while len(maps) > 1:
        maps = [compose(fst, *maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def token_counts(docs: DataFrame, spec: bytes, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    ``spec`` is the tokenizer file's content (a fixed vocabulary of a few MB, shipped once as a broadcast).
    Null texts count as empty: 0 bytes, 0 tokens.  Repeated rows and null ids are counted row by row.
    Only the chunks' maps are shuffled, by row: texts stay where they were read."""
    spark = docs.sparkSession
    prepare_python(spark)
    shipped = spark.sparkContext.broadcast(spec)
    text = F.coalesce(F.col(text_col), F.lit(""))
    chunks = (docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("t"))
              .select("row", "id", F.expr(f"greatest(length(t) - 1, 0) div {chunk}").alias("end"), F.posexplode(F.expr(
                  f"transform(sequence(0, greatest(length(t) - 1, 0) div {chunk}), i -> substring(t, int(i) * {chunk} + 1, {chunk}))"))
                  .alias("at", "part")))
    schema = chunks.select("row", "id", "at", F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("open"),
                           F.lit("").alias("head"), F.lit(0).cast("long").alias("n"), F.lit("").alias("tail")).schema

    def maps(batches):
        fst = compiled(shipped.value)
        for b in batches:
            parts = b.column("part").to_pylist()
            got = [known_ends(fst, p, at == 0, at == end)
                   for p, at, end in zip(parts, b.column("at").to_pylist(), b.column("end").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("id"), b.column("at"), pa.array([len(p.encode()) for p in parts], pa.int64()),
                 pa.array([m[0] for m in got], pa.bool_()), pa.array([m[1] for m in got], pa.string()),
                 pa.array([m[2] for m in got], pa.int64()), pa.array([m[3] for m in got], pa.string())],
                names=["row", "id", "at", "bytes", "open", "head", "n", "tail"])

    per_row = (chunks.mapInArrow(maps, schema).groupBy("row")
               .agg(F.min("id").alias("id"), F.sum("bytes").alias("n_bytes"),
                    F.sort_array(F.collect_list(F.struct("at", "open", "head", "n", "tail"))).alias("maps"))
               .select("id", "n_bytes", "maps"))
    out = per_row.select("id", "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema

    def compose_rows(batches):
        fst = compiled(shipped.value)
        for b in batches:
            ns = [closed(fst, scan(fst, [(m["open"], m["head"], m["n"], m["tail"]) for m in ms]))
                  for ms in b.column("maps").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(ns, pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])

    return per_row.mapInArrow(compose_rows, out).withColumn("over_limit", F.col("n_tokens") > limit)


def contract(spark, docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        spec = f.read()
    return token_counts(docs, spec).withColumnRenamed("id", "doc_id")
