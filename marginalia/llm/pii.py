"""Personal data by bootstrapped contextual extraction.

Fixed patterns find e-mail addresses, IP addresses, card numbers and phone numbers: the seeds. Around each seed, and around
every other token that looks like an identifier, the words before it (one and two of them) are lexical patterns for that kind
of identifier. Spark scores the bipartite graph of patterns and instances: a pattern is as good as the instances it
extracts, an instance as good as the patterns that extract it; seeds are certain, a pattern needs the support of seeds or of
instances that earlier rounds made certain enough, and tokens that look like no kind of
identifier at a pattern's place count against it. After a few rounds, instances of high confidence that the fixed patterns
don't cover are added as spans of the kind that their patterns stand for.

At scale: one pass over the texts gives each row's seeds and candidates; the graph is summed per (pattern, kind, instance) with
partial sums before each shuffle, and scores are joins of written tables, which adaptive execution splits where a word
is frequent. Nothing is gathered but a document's own spans.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import Scratch, lean

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SUPPORT = 3
PATTERN_CONFIDENCE = 0.6
INSTANCE_CONFIDENCE = 0.8

# The patterns of each kind, in forms that take linear time: repetitions are possessive, and runs are tried from their beginning only.
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens that may be an identifier: with an at sign, or with four digits or more.
_IN_TOKEN = r"[^\s,;<>\"'|()\[\]{}"
_TOKEN = re.compile(rf"(?<!{_IN_TOKEN}]){_IN_TOKEN}0-9@]*+[0-9@]{_IN_TOKEN}]*+")
#: Groups of digits that white space, dots, dashes and brackets part, in one line.
_GROUPS = re.compile(r"(?<![\w.+-])\(?[0-9]{1,6}+\)?(?:[ .-]{1,2}+\(?[0-9]{1,6}+\)?){1,7}+(?![\w-])")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_BEFORE = 80


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign to the left as far as its local part goes, but not into the match before, and to the right over the domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        width, low = 64, max(free, at - 64)
        while (start := len(text[low:at].rstrip(_LOCAL)) + low) == low > free:  # the whole window is local part
            width *= 2
            low = max(free, at - width)
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; per kind leftmost and non-overlapping, failing matches dropped."""
    out = []
    out += [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> int | None:
    """The kind that a token resembles without satisfying its fixed pattern."""
    digits = sum(c in "0123456789" for c in token)
    if "@" in token.strip("@") and any(c.isalpha() for c in token):
        return 0
    if token.count(".") == 3 and digits >= 4 and digits + 3 == len(token):
        return 1
    plain = re.sub(r"[-+. ()]", "", token)
    if len(plain) == digits and 12 <= digits <= 19:
        return 2
    if len(plain) == digits and 7 <= digits <= 15:
        return 3
    return None


def patterns(text: str, start: int) -> list[str]:
    """The last word and the last two words before a place, in lower case."""
    words = _WORD.findall(text[max(0, start - _BEFORE) : start].lower())
    return [f"1 {words[-1]}", *([f"2 {words[-2]} {words[-1]}"] if len(words) > 1 else [])] if words else []


def _digest(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)


def _after(spans: list[tuple[int, int]], at: int, start: int) -> int:
    while at < len(spans) and spans[at][1] <= start:
        at += 1
    return at


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, kind or -1, instance, seed, patterns): seeds, other tokens with digits or an at sign, and groups of
    digits that make up a number of the length of a card's or a phone's. Spans don't overlap."""
    covered, at = sorted((s, e) for s, _, e in base), 0
    out = [(s, e, k, _digest(text[s:e].lower()), True, patterns(text, s)) for s, k, e in base]
    if not (_DIGIT.search(text) or "@" in text):
        return out
    groups = []
    for m in _GROUPS.finditer(text):
        if shape(m[0]) in (2, 3) and " " in m[0].strip():  # what has no white space is a token
            groups.append((m.start(), m.end()))
            at = _after(covered, at, m.start())
            if not (at < len(covered) and covered[at][0] < m.end()):
                out.append((m.start(), m.end(), shape(m[0]), _digest(re.sub(r"\D", "", m[0])), False, patterns(text, m.start())))
    at = of = 0
    for m in _TOKEN.finditer(text):
        start, end = m.start(), m.end()
        token = m[0].rstrip(".!?:#$%&*")
        end = start + len(token)
        at, of = _after(covered, at, start), _after(groups, of, start)
        if at < len(covered) and covered[at][0] < end or of < len(groups) and groups[of][0] < end or len(token) < 5:
            continue
        kind = shape(token)
        out.append((start, end, -1 if kind is None else kind, _digest(token.lower()), False, patterns(text, start)))
    return out


_SPAN = "struct<start:long,kind:int,end:long>"
_CANDIDATE = "struct<start:long,end:long,kind:int,instance:long,seed:boolean,patterns:array<string>>"


def _extracted(docs: DataFrame, id_col: str, text_col: str, tmp: Scratch) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    candidate = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.int64()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, found = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                spans.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in base])
                found.append([dict(zip(("start", "end", "kind", "instance", "seed", "patterns"), o, strict=True)) for o in occurrences(text, base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(candidate))], names=["id", "base", "found"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, base array<{_SPAN}>, found array<{_CANDIDATE}>")
    return tmp.save(rows.withColumn("row", F.monotonically_increasing_id()), "extracted")


def _scored(extracted: DataFrame, tmp: Scratch, rounds: int) -> DataFrame:
    """Instances of high confidence: instance, kind."""
    each = extracted.select(F.explode("found").alias("f")).select("f.kind", "f.instance", "f.seed", F.explode("f.patterns").alias("pattern"))
    edges = tmp.save(each.groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")), "edges")
    # a pattern stands for a kind; tokens of any other kind, or of none, are evidence against it
    nodes = tmp.save(edges.groupBy("instance", "kind").agg(F.max(F.col("seed").cast("double")).alias("score")), "nodes-0")
    totals = tmp.save(edges.groupBy("pattern").agg(F.countDistinct("instance").alias("total")), "totals")
    for k in range(1, rounds + 1):
        scored = edges.filter("kind >= 0").join(nodes, ["instance", "kind"])
        good = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("good"), F.sum((F.col("seed") | (F.col("score") >= INSTANCE_CONFIDENCE)).cast("int")).alias("support"))
        good = tmp.save(good, f"good-{k}")
        confident = good.join(totals, "pattern").withColumn("confidence", F.col("good") / F.col("total"))
        confident = confident.filter((F.col("support") >= LEAST_SUPPORT) & (F.col("confidence") >= PATTERN_CONFIDENCE)).select("pattern", "kind", "confidence")
        confident = tmp.save(confident, f"confident-{k}")
        # an instance is missed only if all of its patterns are wrong
        miss = edges.join(confident, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))).alias("miss"))
        nodes = nodes.join(tmp.save(miss, f"miss-{k}"), ["instance", "kind"], "left")
        nodes = tmp.save(nodes.select("instance", "kind", F.greatest("score", 1 - F.exp(F.coalesce("miss", F.lit(0.0)))).alias("score")), f"nodes-{k}")
    return nodes.filter((F.col("score") >= INSTANCE_CONFIDENCE) & (F.col("kind") >= 0)).select("instance", "kind")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row: id, spans (array of start, kind, end in code points, sorted; base spans and discovered ones), base (the same of base spans only).

    Null and empty texts have no spans. Repeated rows and null ids are returned as they are. Other columns are ignored; an
    empty table gives an empty result. Discovered spans never overlap a base span.
    """
    tmp = Scratch(docs.sparkSession, "pii")
    extracted = _extracted(docs, id_col, text_col, tmp)
    sure = tmp.save(_scored(extracted, tmp, rounds), "sure")
    loose = extracted.select("row", F.explode("found").alias("f")).filter("NOT f.seed AND f.kind >= 0").select("row", "f.start", "f.kind", "f.end", "f.instance")
    added = loose.join(sure, ["instance", "kind"]).groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added"))
    out = extracted.join(tmp.save(added, "added"), "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{_SPAN}>"))))
    return out.select(F.col("id").alias(id_col), spans.alias("spans"), "base")


def _written(spans):
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def _number_of(kind: int):
    return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``find_pii`` as counts of base spans by kind, their digest, and all spans as text."""
    found = find_pii(docs, id_col, text_col)
    counts = [_number_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
