"""Operator 1: personal data by bootstrapped contextual extraction.

Base patterns find seed entities.  The words around a mention are its lexical patterns.  Spark scores the graph of patterns
and instances in rounds: a pattern's confidence in a kind is the smoothed share of its labelled distinct instances that are of
the kind (labelled: of a kind, or shown to be none), an instance's score is what its confident patterns agree on.  Identifier-like strings that the base
patterns missed, and that confident patterns point to, become new instances of the kind and feed the next
round, until no pattern is added, and at the end give additional spans.
"""
from __future__ import annotations

import bisect
import itertools
import re
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import output_schema, prepare_python
from ledgerlake.session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
# The base patterns.
# (an email: LOCAL characters, an at sign, DOMAIN)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Identifier-like strings: seven or more digits with separators; two names around an at sign, plain or spelt out.
NUMBERS = re.compile(r"\(?[0-9](?:[0-9()\x20./:-]*[0-9])?")
NUMBER = re.compile(r"\(?[0-9](?:[0-9()./:-]*[0-9])?")
LEAST_DIGITS, MOST_DIGITS = 7, 19                     # no kind has more digits than a card
# Digits that an unseen string of a kind can have (ip, card, phone).
DIGITS = {1: (7, 12), 2: (13, 19), 3: (7, 15)}
NAMES = re.compile(r"\x20?[\w-]+(?:\x20?(?:\.|[\[(]dot[\])])\x20?[\w-]+)*")
# Strings shown not to be identifiers, as they have a kind's form and fail its rule: card groups, four dotted numbers.
CARD_FORM = re.compile(r"[0-9]{13,19}|(?:[0-9]{4}[\x20-]){3,4}[0-9]{1,4}")
NO_KIND = -2
HAS_AT = re.compile(r"@|[\[(]at[\])]")
WORD = re.compile(r"\w+")

MIN_CONFIDENCE, MIN_SEEDS, SMOOTHING = 0.85, 5, 0.5
# Mentions that a task hands on at once, however many a text has.
MENTION_ROWS = 10_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def is_octet(digits: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def before(text: str, at: int, least: int, allowed: frozenset) -> int:
    """Where the run of ``allowed`` characters that ends at ``at`` begins, ``least`` at the lowest."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of the base pattern of an email, found from the at signs outward: no run of characters is read for
    more than one of them, so the work is linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = before(text, at, last, LOCAL)
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            out.append((start, last))
        at = text.find("@", max(last, at + 1))
    return out


def spelt(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Two names around an at sign, plain or spelt out, with or without blanks beside it."""
    out, last = [], start
    for m in HAS_AT.finditer(text, start, end):
        at = m.start()
        if at < last:
            continue
        edge = at - (at > last and text[at - 1] == " ")
        low = edge
        while low > last and (text[low - 1] in LOCAL or text[low - 1] == "_" or text[low - 1].isalnum()):
            low -= 1
        names = NAMES.match(text, m.end(), end) if low < edge else None
        if names:
            last = names.end()
            out.append((low, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start."""
    out = []
    out += [(0, s, e) for s, e in emails(text)]
    if "." in text:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text)
                if all(map(is_octet, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def numbers(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The numbers between ``start`` and ``end`` with seven or more digits: each blank-separated one, each run of them with as
    many digits as a kind can have, and the whole of each list."""
    out = set()
    for run in NUMBERS.finditer(text, start, end):
        parts = [(m.start(), m.end(), sum(map(str.isdigit, m.group()))) for m in NUMBER.finditer(text, run.start(), run.end())]
        if sum(p[2] for p in parts) >= LEAST_DIGITS:
            out.add((parts[0][0], parts[-1][1]))
        for i, (s, _, _) in enumerate(parts):
            n = 0
            for j in range(i, len(parts)):
                n += parts[j][2]
                if n > MOST_DIGITS and j > i:
                    break
                if n >= LEAST_DIGITS:
                    out.add((s, parts[j][1]))
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like spans in the gaps between base spans, by start; numbers and runs of them overlap."""
    out, at = [], 0
    for s, e in [*sorted((s, e) for _, s, e in taken), (len(text), len(text))]:
        if s > at:
            out += numbers(text, at, s)
            out += spelt(text, at, s)
        at = max(at, e)
    return sorted(set(out))


def can_be(kind: int, instance: str) -> bool:
    """Whether an unseen string has what every string of the kind has: an at sign, or as many digits."""
    if kind == 0 or HAS_AT.search(instance):
        return kind == 0 and bool(HAS_AT.search(instance))
    low, high = DIGITS[kind]
    return low <= sum(map(str.isdigit, instance)) <= high


def pointed(unseen: DataFrame, good: DataFrame) -> DataFrame:
    """(row, start, end, instance, kind, score): the spans of ``unseen`` whose confident patterns name one kind.  Of those that
    overlap, the one with the surest pattern stays, then the most patterns, then the longest."""
    hits = (unseen.join(good, "pattern").groupBy("row", "start", "end", "instance").agg(
                F.max("confidence").alias("score"), F.count(F.lit(1)).alias("n"),
                F.min("kind").alias("kind"), F.max("kind").alias("other")).filter("kind = other")
            .groupBy("row").agg(F.collect_list(F.struct("score", "n", "start", "end", "instance", "kind")).alias("hits")))
    schema = hits.select("row", F.inline("hits")).select("row", "start", "end", "instance", "kind", "score").schema

    def run(batches):
        for b in batches:
            out = []
            for row, found in zip(b.column("row").to_pylist(), b.column("hits").to_pylist()):
                starts, ends = [], []                 # of the chosen ones, in order of place
                for h in sorted(found, key=lambda h: (-h["score"], -h["n"], h["start"] - h["end"], h["start"])):
                    if can_be(h["kind"], h["instance"]):
                        i = bisect.bisect_left(starts, h["end"])
                        if not i or ends[i - 1] <= h["start"]:
                            starts.insert(i, h["start"])
                            ends.insert(i, h["end"])
                            out.append((row, h["start"], h["end"], h["instance"], h["kind"], h["score"]))
            cols = list(zip(*out)) or [()] * len(schema)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)
    return hits.mapInArrow(run, schema)


def no_identifier(text: str) -> bool:
    """Whether a candidate has the form of a card or address and fails its rule."""
    if CARD_FORM.fullmatch(text):
        return not luhn(re.sub("[ -]", "", text))
    return bool(IP.fullmatch(text)) and not all(map(is_octet, text.split(".")))


class Context:
    """The words and lines of a text, found once for all its mentions."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, array("q"), array("q")
        for m in WORD.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())
        self.breaks = array("q", (m.start() for m in re.finditer("\n", text)))

    def patterns(self, start: int, end: int) -> list[str]:
        """The lexical patterns of a mention: the last one and two words before it (with the form of the string), the words on
        both sides.  Words are lower-cased; a line's or text's edge counts as a word."""
        k = bisect.bisect_left(self.breaks, start)
        line = self.breaks[k - 1] + 1 if k else 0
        k = bisect.bisect_left(self.breaks, end)
        stop = self.breaks[k] if k < len(self.breaks) else len(self.text)
        near = ["^", "^"]
        k = bisect.bisect_left(self.starts, start) - 1          # the last word that begins before the mention
        for at in (1, 0):
            if k >= 0 and self.starts[k] >= line:
                near[at] = self.text[self.starts[k]:min(self.ends[k], start)].lower()
                k -= 1
        k = bisect.bisect_right(self.ends, end)                 # the first that ends after it
        after = "$"
        if k < len(self.starts) and self.starts[k] < stop:
            after = self.text[max(self.starts[k], end):self.ends[k]].lower()
        form = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "0", self.text[start:end]))
        return [f"{near[0]} {near[1]} _", f"{near[1]} _ {after}", f"{near[1]} {form}"]


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` one with ``head`` true (row, id, n_email.., base: its base spans), and one with ``head`` false for each of its
    mentions: row, kind (-1 for unseen or NO_KIND), start, end, instance and patterns.  A text with very many of them
    is handed on in parts."""
    spark = docs.sparkSession
    prepare_python(spark)
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = [f"n_{k}" for k in KINDS]
    spans_t = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = output_schema(src.select(
        F.lit(True).alias("head"), "row", "id", *[F.lit(0).cast("long").alias(c) for c in counts],
        F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint>>)").alias("base"), F.lit(0).alias("kind"),
        F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("instance"),
        F.expr("cast(array() as array<string>)").alias("patterns")))

    def found(batch):
        for row, id_, text in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "text"))):
            text = text or ""
            base = base_spans(text)
            yield (True, row, id_, *[sum(k == i for k, _, _ in base) for i in range(len(KINDS))],
                   [{"kind": k, "start": s, "end": e} for k, s, e in base], None, None, None, None, None)
            more = candidates(text, base)
            context = Context(text) if base or more else None
            for k, s, e in itertools.chain(base, ((NO_KIND if no_identifier(text[s:e]) else -1, s, e) for s, e in more)):
                yield (False, row, None, *[None] * len(KINDS), None, k, s, e, re.sub(r"\s+", " ", text[s:e].lower()),
                       context.patterns(s, e))

    def run(batches):
        for b in batches:
            types = [pa.bool_(), pa.int64(), b.schema.field("id").type, *[pa.int64()] * len(KINDS), spans_t, pa.int32(), pa.int64(),
                     pa.int64(), pa.string(), pa.list_(pa.string())]
            rows = found(b)
            while part := list(itertools.islice(rows, MENTION_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=schema.names)
    return src.mapInArrow(run, schema)


def confident_patterns(edges: DataFrame, unseen: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(pattern, kind, confidence) from the graph ``edges`` (pattern, instance, kind, -1 or NO_KIND), each edge once, and the
    ``unseen`` spans (row, start, end, instance, pattern).

    Unseen instances are neutral: a confidence is the share among the labelled ones.  Each round is two aggregations: per
    (pattern, kind) over its instances, per (instance, kind) over its patterns.  Both are partial sums, so a pattern with a
    third of all mentions ("the _") is never gathered.  A confident pattern stays, and rounds end when none is added."""
    known = edges.filter("kind >= 0").groupBy("instance", "kind").agg(F.lit(1.0).alias("score"))
    links = cut_lineage(edges.select("pattern", "instance").distinct(), "pii_links")
    never = (edges.filter(F.col("kind") == NO_KIND).select("instance").distinct()
             .join(known.select("instance").distinct(), "instance", "left_anti")
             .select("instance", F.lit(NO_KIND).alias("kind"), F.lit(1.0).alias("score")))
    known = cut_lineage(known.unionByName(never), "pii_known")
    fresh = unseen.join(known.select("instance").distinct(), "instance", "left_anti")
    scores, good = known, None
    while True:
        sizes = links.join(scores.groupBy("instance").agg(F.max("score").alias("score")), "instance").groupBy("pattern").agg(
            F.sum("score").alias("n"))
        now = (links.join(scores.filter("kind >= 0"), "instance").groupBy("pattern", "kind").agg(
                   F.sum("score").alias("hits"), F.count(F.lit(1)).alias("of_kind"))
               .filter(F.col("of_kind") >= min_seeds)
               .join(sizes, "pattern").withColumn("confidence", F.col("hits") / (F.col("n") + SMOOTHING))
               .filter(F.col("confidence") >= min_confidence).select("pattern", "kind", "confidence"))
        if good is not None:
            now = now.join(good, ["pattern", "kind"], "left_anti")
        now = cut_lineage(now, "pii_patterns")
        if not now.count():
            return now if good is None else good
        good = now if good is None else cut_lineage(good.unionByName(now), "pii_patterns")
        # an unseen string is as sure as its surest pattern, if its confident patterns name one kind
        new = (pointed(fresh, good).groupBy("instance").agg(
                   F.max("score").alias("score"), F.min("kind").alias("kind"), F.max("kind").alias("other"))
               .filter("kind = other").select("instance", "kind", "score"))
        scores = cut_lineage(known.unionByName(new), "pii_scores")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **graph) -> DataFrame:
    """Per row of ``docs``: id, n_email, n_ip, n_card, n_phone, ``base`` and ``spans`` (arrays of kind, start, end; code points, end
    exclusive; by kind, then start).  ``spans`` has the base spans and those that confident patterns discovered.

    Null texts are empty; repeated rows are judged row by row (an instance counts once per pattern, however many copies);
    an empty table gives an empty result.  Only mentions and their patterns are shuffled, never texts."""
    got = cut_lineage(mentions(docs, id_col, text_col), "pii_mentions")
    each = got.filter("not head").select("row", "kind", "start", "end", "instance", "patterns")
    edges = each.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct()
    unseen = cut_lineage(each.filter("kind = -1").select("row", "start", "end", "instance", F.explode("patterns").alias("pattern")),
                         "pii_unseen")
    good = confident_patterns(cut_lineage(edges, "pii_edges"), unseen, **graph)
    new = pointed(unseen, good).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    return (got.filter("head").join(new, "row", "left").withColumn("base", F.sort_array("base"))
            .withColumn("spans", F.when(F.col("more").isNull(), F.col("base")).otherwise(
                F.sort_array(F.concat("base", "more"))))
            .select("id", *[f"n_{k}" for k in KINDS], "base", "spans"))


def as_text(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def contract(spark, docs: DataFrame) -> DataFrame:
    return find(docs).select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in KINDS],
                             F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))
