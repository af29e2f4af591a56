"""Personal data in texts: base patterns, and identifiers found by bootstrapped lexical contexts.

Base spans (emails, addresses, card and phone numbers that pass their checks) are seeds. What stands around
an identifier on its line gives its lexical patterns: the two words before it, the last of them, the one word
that starts its line, the two words after it. Patterns and instances form a graph: a pattern's score is the
mean belief in the distinct instances it introduces, one of which nothing is known counting half; the belief
in an instance that is no seed is the chance that one of its trusted patterns is right. Instances of enough
belief become seeds themselves, so that their other contexts may be trusted in the next round, until no more
are found. What trusted patterns introduce, if it has the kind's loose shape, becomes a span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.llm.common import drop_staged, slices, staged, with_text

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match never starts inside a run of digits: its first number is greedy and is followed by a dot.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Loose shapes of the same kinds, for what only a trusted context can tell.
_LOOSE = {
    # A spelled-out sign; a plain point stands between letters, so that the end of a sentence is none.
    0: re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+(?: ?(?:\(at\)|\[at\]) ?| at )[A-Za-z0-9-]++"
                  r"(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)[A-Za-z0-9-]++)+(?![A-Za-z0-9])"),
    1: re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
    2: re.compile(r"(?<![0-9A-Za-z+.-])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9A-Za-z-]|[ .-][0-9])"),
    3: re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9A-Za-z-]|[ .-][0-9])"),
}
_WORD = re.compile(r"\S+")


@dataclass(frozen=True)
class Bootstrap:
    """Most rounds, the least pattern score and distinct seeds, how far a context reaches, and the belief that makes a seed.

    A pattern of one word that is not its line's first needs twice the seeds and ``weak_score``.
    """

    rounds: int = 8
    least_score: float = 0.6
    least_seeds: int = 5
    reach: int = 80
    promoted: float = 0.6
    weak_score: float = 0.8


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping emails, in time linear in the text: each ``@`` looks at the run before it."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= free:
            run = text[free:at]
            start = free + len(run.rstrip(_LOCAL))
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                found.append((start, m.end()))
                free = m.end()
            else:
                free = at + 1
        at = text.find("@", at + 1)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind and start."""
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                spans.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append((3, *m.span()))
    return spans


def _contexts(text: str, start: int, end: int, reach: int) -> list[str]:
    """The lexical patterns of a span, from the words within ``reach`` characters on its own line, lower-cased."""
    cut = start > reach and "\n" not in text[start - reach:start]
    before = _WORD.findall(text[max(0, start - reach):start].rpartition("\n")[2].lower())
    before = before[1:] if cut else before  # the first word may have lost its beginning
    after = _WORD.findall(text[end:end + reach].partition("\n")[0].lower())
    after = after[:-1] if len(text) > end + reach and "\n" not in text[end:end + reach] else after
    out = []
    if len(before) > 1:
        out += [f"2 {before[-2]} {before[-1]}", f"1 {before[-1]}"]
    elif before and not cut:
        out.append(f"^ {before[0]}")
    if len(after) > 1:
        out.append(f"> {after[0]} {after[1]}")
    return out


def _loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What has a loose shape and touches no base span and no earlier loose span."""
    out: list[tuple[int, int, int]] = []
    digits = _DIGIT.search(text) is not None
    held = sorted((a, b) for _, a, b in taken)
    for kind, shape in _LOOSE.items():
        if kind == 0 and "at" not in text or kind and not digits or kind == 1 and ":" not in text:
            continue
        for m in shape.finditer(text):
            if all(m.end() <= a or m.start() >= b for a, b in held):
                out.append((kind, *m.span()))
        held += [(a, b) for k, a, b in out if k == kind]
    return out


def _plain(kind: int, text: str) -> str:
    return re.sub(r"[^0-9A-Za-z]", "", text).lower() if kind else text.lower()


FOUND = "array<struct<kind:int,start:int,end:int,patterns:array<string>,instance:string>>"


def _scan(reach: int):
    kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                                ("patterns", pa.list_(pa.string())), ("instance", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            base, loose = [], []
            for text in piece["text"].to_pylist():
                spans = base_spans(text)
                for rows, found in ((base, spans), (loose, _loose_spans(text, spans))):
                    rows.append([(k, a, b, _contexts(text, a, b, reach), _plain(k, text[a:b])) for k, a, b in found])
            loose = [[x for x in row if x[3]] for row in loose]
            yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(base, kinds), pa.array(loose, kinds)],
                                             names=["doc_id", "base", "loose"])

    return run


def trusted_patterns(base: DataFrame, loose: DataFrame, params: Bootstrap) -> DataFrame:
    """(kind, pattern, score) of the patterns that pass, from (kind, pattern, instance) occurrences.

    An instance that the base patterns find anywhere is a seed wherever it occurs; one that trusted patterns
    make likely enough is a seed from the next round on. Rounds end when there are no new seeds.
    """
    both = base.select("kind", "pattern", "instance", F.lit(1).alias("seed")).union(
        loose.select("kind", "pattern", "instance", F.lit(0)))
    edges = both.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"))
    seeds = base.select("kind", "instance").distinct().withColumn("known", F.lit(1))
    edges = staged(edges.join(seeds, ["kind", "instance"], "left").select(
        "kind", "pattern", "instance", F.when((F.col("seed") == 1) | (F.col("known") == 1), F.lit(1.0)).alias("belief")),
        "pattern-edges")
    weak = F.col("pattern").startswith("1 ")
    believed = F.col("belief") >= params.promoted
    passes = (F.col("score") >= F.when(weak, params.weak_score).otherwise(params.least_score)) & (
        F.col("seeds") >= F.when(weak, 2 * params.least_seeds).otherwise(params.least_seeds))
    trusted, sure = None, -1
    for _ in range(params.rounds):
        count = edges.where(believed).select("kind", "instance").distinct().count()
        if count == sure:
            break
        old, sure = [t for t in (trusted,) if t is not None], count
        trusted = staged(edges.groupBy("kind", "pattern").agg(
            F.avg(F.coalesce("belief", F.lit(0.5))).alias("score"), F.count_if(believed).alias("seeds")).where(passes), "pattern-scores")
        chance = (1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("chance")
        beliefs = edges.join(trusted, ["kind", "pattern"]).groupBy("kind", "instance").agg(chance)
        renewed = staged(edges.join(beliefs, ["kind", "instance"], "left").select(
            "kind", "pattern", "instance", F.greatest("belief", "chance").alias("belief")), "pattern-edges")
        drop_staged(edges, *old)
        edges = renewed
    return trusted


def find(docs: DataFrame, params: Bootstrap = Bootstrap()) -> DataFrame:
    """(doc_id, base, added) for every row: base spans and those that trusted contexts add.

    Both are arrays of (kind number, start, end) in code points, end exclusive, by kind and start; added
    spans never touch base spans. A null or empty text has none. Rows and ids may repeat or be null: each
    row comes out with its own spans. Only ``doc_id`` and ``text`` are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = with_text(docs, "doc_id").mapInArrow(_scan(params.reach), f"doc_id {kind}, base {FOUND}, loose {FOUND}")
    # The row number is written with the table and so is fixed from here on.
    scanned = staged(scanned.withColumn("row", F.monotonically_increasing_id()), "spans")
    base = scanned.select(F.explode("base").alias("x")).select("x.*", F.explode("x.patterns").alias("pattern"))
    loose = scanned.select("row", F.explode("loose").alias("x")).select("row", "x.*", F.explode("x.patterns").alias("pattern"))
    trusted = staged(trusted_patterns(base, loose, params), "trusted")
    added = (loose.join(trusted.select("kind", "pattern"), ["kind", "pattern"])
             .groupBy("row").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added")))
    bare = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    some = scanned.where(F.size("loose") > 0).join(added, "row", "left").select(
        "doc_id", bare.alias("base"), F.coalesce("added", none).alias("added"))
    return some.union(scanned.where(F.size("loose") == 0).select("doc_id", bare, none))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
