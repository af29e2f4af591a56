"""Removal of repeated line chunks with content-defined boundaries.

A line's hash and its predecessors' form a rolling hash; where it is divisible by ``divisor`` a chunk
ends. Boundaries depend on nearby lines only, so a passage moved to another place is cut at the same
inner lines. Chunks of two or more lines that occur more than once anywhere are compared byte for byte,
and all but the first occurrence are removed. All of it is DataFrame functions.

A repeated passage may share its first and last chunk with its surroundings, and a short one may lie in no
chunk of its own. ``remove_passages`` looks at every line and every pair of neighbouring lines, and
``remove_all`` lets it follow the chunks, so that no repeated passage depends on where a chunk happens to end.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.llm.common import drop_staged, small_side, staged


@dataclass(frozen=True)
class LineChunks:
    """Lines in the rolling window, its multiplier, the boundary divisor, the fewest lines of a chunk.

    Lists of at most ``broadcast_spans`` chunks and documents together are broadcast, longer ones joined by shuffle.
    """

    window: int = 2
    multiplier: int = 31
    divisor: int = 2
    least_lines: int = 2
    broadcast_spans: int = 500_000


@dataclass(frozen=True)
class Passages:
    """Words from which a line counts alone."""

    least_words: int = 8


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _chunks(lines: Column, params: LineChunks) -> Column:
    """Array of (first, last) line numbers, from 0, of the chunks of at least ``least_lines`` lines."""
    hashes = F.transform(lines, _number)

    def tuples(h: Column) -> Column:
        def ends(i: Column) -> Column:
            rolling = F.lit(0).cast("long")
            for back in reversed(range(params.window)):
                rolling = rolling * params.multiplier + F.coalesce(F.get(h, i - back), F.lit(0).cast("long"))
            return rolling % params.divisor == 0

        last = F.size(h) - 1
        bounds = F.array_union(F.filter(F.sequence(F.lit(0), last), ends), F.array(last))
        spans = F.transform(bounds, lambda b, k: F.struct(
            (F.coalesce(F.get(bounds, k - 1), F.lit(-1)) + 1).alias("first"), b.alias("last")))
        return F.filter(spans, lambda s: s["last"] - s["first"] + 1 >= params.least_lines)

    # One evaluation of the hashes: they are the single element of an array that is then unfolded.
    return F.flatten(F.transform(F.array(hashes), tuples))


def _text_of(lines: Column, span: Column) -> Column:
    return F.array_join(F.slice(lines, span["first"] + 1, span["last"] - span["first"] + 1), "\n")


def remove_repeated(docs: DataFrame, params: LineChunks = LineChunks()) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``, and ``n_removed_lines`` (long).

    The first occurrence stays: the one of the smallest (doc_id, hash of the text, chunk), null ids
    last. Rows that repeat both id and text are one document and come out alike. Chunks without a word
    are left alone. A null text stays null and an empty one empty, with nothing removed; a text of which
    everything is removed becomes empty. All columns are kept, whatever their names; a column
    ``n_removed_lines`` of the input is replaced.
    """
    lines = F.split("text", "\n", -1)
    key = F.xxhash64("text")
    cut = (docs.select("doc_id", key.alias("doc_key"), lines.alias("lines"))
           .where(F.size("lines") >= params.least_lines)
           .select("doc_id", "doc_key", "lines", F.explode(_chunks(F.col("lines"), params)).alias("span")))
    chunks = staged(cut.select("doc_id", "doc_key", "span", _text_of(F.col("lines"), F.col("span")).alias("chunk"))
                    .where(F.col("chunk").rlike(r"[^\x20\x09-\x0D]"))
                    .select("doc_id", "doc_key", "span", F.unhex(F.md5("chunk")).alias("hash")), "chunks")
    repeated = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    suspects = chunks.join(repeated, "hash").groupBy("doc_id", "doc_key").agg(F.collect_set("span").alias("spans"))
    suspects = staged(suspects, "suspects")

    # A suspect's own text, cut out again, is what is compared: equal bytes fall in one group.
    packed = docs.select(F.struct("*").alias("row"), key.alias("row_key"))
    found = packed.join(small_side(suspects.select(F.col("doc_id").alias("its_id"), F.col("doc_key").alias("its_key"),
                                                   "spans"), params.broadcast_spans, F.size("spans")), _same())
    one = found.select("its_id", "its_key", "spans", F.split("row.text", "\n", -1).alias("lines")).dropDuplicates(
        ["its_id", "its_key"])
    places = (one.select("its_id", "its_key", "lines", F.explode("spans").alias("span"))
              .select(_text_of(F.col("lines"), F.col("span")).alias("chunk"),
                      F.struct(F.col("its_id").isNull().alias("last"), "its_id", "its_key", "span").alias("place")))
    places = staged(places, "places")
    first = places.groupBy("chunk").agg(F.min("place").alias("first"))
    removed = (places.join(first.withColumnRenamed("chunk", "same"), F.col("chunk") == F.col("same"))
               .where("place != first").groupBy("place.its_id", "place.its_key")
               .agg(F.collect_list("place.span").alias("removed")))
    removed = small_side(staged(removed, "removed"), params.broadcast_spans, F.size("removed"))

    gone = lambda i: F.exists("removed", lambda r: (i >= r["first"]) & (i <= r["last"]))
    kept = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda _, i: ~gone(i)), "\n")
    count = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    out = packed.join(removed, _same(), "left")
    whole = F.col("removed").isNull()
    columns = [F.when(whole, F.col("row.text")).otherwise(kept).alias("text") if c == "text" else F.col(f"row.`{c}`")
               for c in docs.columns if c != "n_removed_lines"]
    return out.select(*columns, F.when(whole, F.lit(0).cast("long")).otherwise(count).alias("n_removed_lines"))


def remove_all(docs: DataFrame, params: LineChunks = LineChunks(), passages: Passages = Passages()) -> DataFrame:
    """``docs`` without repeated chunks and then without what is left of repeated passages, and ``n_removed_lines``.

    The chunks go first, whole and compared byte by byte; of the texts that remain, every repeated run of two
    or more lines and every repeated line of enough words goes. Rows, nulls, empty texts and columns are
    treated as by either step; the lines cut by both are added up.
    """
    name = f"chunk_lines_{uuid.uuid4().hex}"
    first = staged(remove_repeated(docs, params).withColumnRenamed("n_removed_lines", name), "without-chunks")
    both = remove_passages(first, passages)
    return both.withColumn("n_removed_lines", F.col("n_removed_lines") + F.col(name)).drop(name)


def _same() -> Column:
    return F.col("row.doc_id").eqNullSafe(F.col("its_id")) & (F.col("row_key") == F.col("its_key"))


def _pieces(lines: Column, params: Passages) -> Column:
    """Array of (first, last, digest): every pair of neighbouring lines with a word, every line with enough words."""
    space, other = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    wordy = f"^{space}*+(?:{other}++{space}++){{{params.least_words - 1}}}{other}"
    marked = F.transform(lines, lambda x: F.struct(
        x.alias("line"), x.rlike(other).alias("word"), x.rlike(wordy).alias("alone")))

    def pieces(m: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            after = F.get(m, i + 1)
            return F.array(F.when(x["alone"], _piece(i, i, x["line"])),
                           F.when(after.isNotNull() & (x["word"] | after["word"]),
                                  _piece(i, i + 1, F.concat(x["line"], F.lit("\n"), after["line"]))))
        return F.filter(F.flatten(F.transform(m, at)), lambda p: p.isNotNull())

    # One evaluation of the marks, as in _chunks.
    return F.flatten(F.transform(F.array(marked), pieces))


def _piece(first: Column, last: Column, text: Column) -> Column:
    digest = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    return F.struct(first.alias("first"), last.alias("last"), digest.alias("digest"))


def remove_passages(docs: DataFrame, params: Passages = Passages()) -> DataFrame:
    """``docs`` with every repeated passage cut from ``text``, and ``n_removed_lines`` (long).

    A line goes if it has ``least_words`` words and stands anywhere before, or if it and a neighbour, with
    a word between them, stand together anywhere before. So a repeated run of two or more lines goes whole,
    wherever it starts (but lines without a word that have only such neighbours stay), and the first
    occurrence of a line always stays. "Before" is the order (doc_id, hash of the text, line), null ids
    last. Pieces are equal when 128 bits of their SHA-256 are. Null, empty and repeated rows and columns are
    treated as by ``remove_repeated``.
    """
    key = F.xxhash64("text")
    pieces = staged(docs.select("doc_id", key.alias("doc_key"), F.explode(
        _pieces(F.split("text", "\n", -1), params)).alias("piece")).select("doc_id", "doc_key", "piece.*"), "pieces")
    place = F.struct(F.col("doc_id").isNull().alias("last_id"), "doc_id", "doc_key", "first", "last")
    # A document that is there twice is one place, so equal places are no repetition.
    kept = (pieces.groupBy("digest").agg(F.min(place).alias("kept"), F.max(place).alias("end"))
            .where("kept != end").select("digest", "kept"))
    removed = (pieces.join(kept, "digest").where(place != F.col("kept"))
               .select(F.col("doc_id").alias("its_id"), F.col("doc_key").alias("its_key"),
                       F.explode(F.sequence("first", "last")).alias("i"))
               .groupBy("its_id", "its_key").agg(F.collect_set("i").alias("removed")))
    # The list grows with the corpus: a merge join at every size.
    removed = staged(removed, "removed").hint("merge")
    drop_staged(pieces)

    packed = docs.select(F.struct("*").alias("row"), key.alias("row_key"))
    lines = F.split("row.text", "\n", -1)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed")
    left = F.array_join(F.flatten(F.transform(F.array(lines), lambda x: F.transform(numbers, lambda i: F.get(x, i)))), "\n")
    out = packed.join(removed, _same(), "left")
    whole = F.col("removed").isNull()
    columns = [F.when(whole, F.col("row.text")).otherwise(left).alias("text") if c == "text" else F.col(f"row.`{c}`")
               for c in docs.columns if c != "n_removed_lines"]
    count = F.when(whole, 0).otherwise(F.size("removed")).cast("long")
    return out.select(*columns, count.alias("n_removed_lines"))
