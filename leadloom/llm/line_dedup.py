"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines marks chunk boundaries,
so boundaries move with the text and not with its place in a document. Chunks
of several lines that come up more than once in the corpus are removed but for
the first occurrence, after their bytes have been compared.

A boundary looks at the lines before it, so chunks alone miss the ends of a
repeated passage. A repeated chunk is therefore a seed that grows on both sides
for as long as lines repeat (``edges``): every two neighbouring lines are a
unit beside the chunks, and a run of repeated units goes from its first line to
its last if it holds a seed. Short passages may have no two boundaries inside,
so a run of over ``WORDS`` words goes without a seed too, and so does a single
line of so many. Other repeated lines (a heading beside a blank line, a short
answer) stay.

First only (document, place, digest) moves. Texts move twice: to fetch the
bytes of candidates, and to take out what was verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import checked_broadcast, scratch

#: Lines that the rolling hash covers, and one boundary in so many places.
WINDOW, EVERY = 2, 2
#: Lines of a chunk at most, for stretches without a boundary (one line over and over).
LONGEST = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def chunk_spans(hashes: Column) -> Column:
    """(b, e) of each chunk of a text, from the hashes of its lines: places from b up to e.

    Place i (from 0) begins a chunk if the rolling hash over the ``WINDOW``
    lines before it says so. Stretches of over ``LONGEST`` lines without a
    boundary are cut at every ``LONGEST`` lines from their beginning; such cuts
    don't move with the text.
    """
    rolled = lambda i: F.xxhash64(*(F.get(hashes, i - k) for k in range(WINDOW, 0, -1)))
    # every value that is used more than once is bound, so the work is in proportion to the lines
    begins = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: (i == 0) | ((i >= WINDOW) & (F.pmod(rolled(i), F.lit(EVERY)) == 0)))

    def spans(begins: Column) -> Column:
        return F.transform(begins, lambda b, k: F.struct(b.alias("b"), F.coalesce(F.get(begins, k + 1), F.size(hashes)).alias("e")))

    def short(s: Column) -> Column:
        return F.transform(F.sequence(s["b"], s["e"] - 1, F.lit(LONGEST)), lambda b: F.struct(b.alias("b"), F.least(s["e"], b + LONGEST).alias("e")))

    return F.flatten(F.transform(_let(begins, spans), short))


#: A line of more words than this is a passage by itself.
WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _units(text: Column, edges: bool) -> Column:
    """(place, span, digest, size, inside, check, seed) of every chunk of several lines that isn't blank and, with
    ``edges``, of every two neighbouring lines that aren't both blank and of every long line.

    inside is the place of the chunk that holds the unit, or null; check is a
    second digest of chunks of over two lines, 128 bits in all. seed marks
    chunks of two lines or more that aren't blank.
    """

    def of(lines: Column, hashes: Column, spans: Column) -> Column:
        n = F.size(lines)
        blank = lambda i: ~F.get(lines, i).rlike(r"\S")
        # so many words have so many bytes at least
        long = lambda x: (F.octet_length(x) > 2 * WORDS) & (F.size(F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " ")) > WORDS)
        size = lambda i, span: F.aggregate(F.slice(lines, i + 1, span), F.lit(-1), lambda n, x: n + F.octet_length(x) + 1)
        check = lambda i, span: F.when(span > 2, F.xxhash64(F.lit(1), F.slice(hashes, i + 1, span))).otherwise(F.lit(0).cast("long"))
        unit = lambda i, span, digest, inside, seed: F.struct(
            i.alias("place"), span.alias("span"), digest.alias("digest"), size(i, span).alias("size"), inside.alias("inside"), check(i, span).alias("check"), seed.alias("seed")
        )
        told = lambda s: F.size(F.filter(F.slice(lines, s["b"] + 1, s["e"] - s["b"]), lambda x: x.rlike(r"\S"))) > 1
        full = F.filter(spans, lambda s: (s["e"] - s["b"] > 1) & F.exists(F.sequence(s["b"], s["e"] - 1), lambda i: ~blank(i)))
        chunks = F.transform(full, lambda s: unit(s["b"], s["e"] - s["b"], F.xxhash64(F.slice(hashes, s["b"] + 1, s["e"] - s["b"])), s["b"], told(s)))
        if not edges:
            return chunks

        def small(held: Column, ends: Column) -> Column:
            both = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i < n - 1) & ~(blank(i) & blank(i + 1)))
            alone = F.filter(F.sequence(F.lit(0), n - 1), lambda i: long(F.get(lines, i)))
            same = lambda i: F.when(F.get(held, i) == F.get(held, i + 1), F.get(held, i))
            # two lines that are a chunk of their own
            seed = lambda i: (F.get(held, i) == i) & (F.get(ends, i) == i + 2) & ~blank(i) & ~blank(i + 1)
            pairs = F.transform(both, lambda i: unit(i, F.lit(2), F.xxhash64(F.slice(hashes, i + 1, 2)), same(i), seed(i)))
            return F.concat(pairs, F.transform(alone, lambda i: unit(i, F.lit(1), F.xxhash64(F.slice(hashes, i + 1, 1)), F.get(held, i), F.lit(False))))

        # the chunk of each line: where it begins and ends
        held = F.flatten(F.transform(spans, lambda s: F.array_repeat(s["b"], s["e"] - s["b"])))
        ends = F.flatten(F.transform(spans, lambda s: F.array_repeat(s["e"], s["e"] - s["b"])))
        both = F.struct(held.alias("held"), ends.alias("ends"))
        return _let(both, lambda at: F.concat(F.filter(chunks, lambda c: c["span"] > 2), small(at["held"], at["ends"])))

    def hashed(lines: Column) -> Column:
        return F.struct(lines.alias("l"), F.transform(lines, lambda x: F.xxhash64(x)).alias("h"))

    spanned = lambda p: F.struct(p["l"].alias("l"), p["h"].alias("h"), chunk_spans(p["h"]).alias("s"))
    return _let(_let(_let(_lines(text), hashed), spanned), lambda p: of(p["l"], p["h"], p["s"]))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", edges: bool = True) -> DataFrame:
    """``docs`` with the text cleaned, and removed_chunks, removed_lines.

    Removed are, where equal bytes come earlier in the corpus, by (doc_id,
    place), without overlap: content-defined chunks of two or more lines with
    all that repeats beside them, and runs of lines of more than ``WORDS``
    words; without ``edges`` chunks alone, as they were cut. The first
    occurrence always stays. removed_chunks counts runs of removed lines. Null texts
    stay null; a text all of whose lines go is left empty. Null ids come last.
    Rows that share id and text are one document given twice and fare alike.
    Input columns named removed_chunks and removed_lines are replaced; an empty
    table gives an empty result.
    """
    docs = docs.drop("removed_chunks", "removed_lines")
    body, number = F.col(text), F.col(doc_id)
    # rows are told apart by id and text
    me = [number.alias("id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("mark")]
    kind = ["digest", "size", "span", "check"]
    # in two steps: what is selected beside a generator is computed again for each of its rows
    units = docs.select(*me, _units(body, edges).alias("units")).select("id", "mark", F.explode("units").alias("c"))
    units = scratch(units.select("id", "mark", "c.*"), "units")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "mark", "place")
    repeated = units.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("first")).where("n > 1").drop("n")
    overlaps = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")) & (F.col("place") < F.col("first.place") + F.col("span"))
    # from a table of its own both sides shuffle for this join alone, so a hot digest's partition can be split
    candidates = units.join(scratch(repeated, "repeated"), kind)
    # where a whole chunk goes, what is inside it needs no bytes of its own: the chunk's first occurrence has the same
    whole = (F.col("span") > 2) & ~own.eqNullSafe(F.col("first")) & ~overlaps
    by_chunk = candidates.withColumn("whole", whole).repartition("id", "mark").groupBy("id", "mark", "inside")
    by_chunk = by_chunk.agg(F.collect_set(F.struct("place", *kind, "seed")).alias("units"), F.bool_or("whole").alias("whole"))
    needed = F.when(F.col("inside").isNotNull() & F.col("whole"), F.filter("units", lambda u: u["span"] > 2)).otherwise(F.col("units"))
    wanted = by_chunk.groupBy("id", "mark").agg(F.flatten(F.collect_list(needed)).alias("wanted"))

    # the bytes of the candidates
    keyed = docs.select(*me, body.alias("text"))
    same_row = lambda a, b: a.id.eqNullSafe(b.id) & (a.mark == b.mark)
    held = keyed.join(wanted, same_row(keyed, wanted)).select(keyed.id, keyed.mark, "text", "wanted")
    cut = lambda lines, w: F.struct(w.alias("w"), F.array_join(F.slice(lines, w["place"] + 1, w["span"]), "\n").alias("bytes"))
    held = held.select("id", "mark", F.explode(_let(_lines(F.col("text")), lambda lines: F.transform("wanted", lambda w: cut(lines, w)))).alias("c"))
    held = scratch(held.select("id", "mark", "c.w.*", "c.bytes"), "candidates")
    # bytes move once, to be compared; where all that share a digest are equal, the digest stands for them after that
    places = held.select("id", "mark", "place", "seed", *kind)
    same = held.groupBy(*kind, "bytes").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n"))
    forms = scratch(same.groupBy(*kind).agg(F.count(F.lit(1)).alias("forms"), F.min("first").alias("first"), F.max("n").alias("n")), "first").where("n > 1")
    alike = places.join(forms.where("forms = 1").select(*kind, "first"), kind)
    # bytes that only share a digest are units of their own: each of them keeps its first occurrence
    clash = held.join(checked_broadcast(forms.where("forms > 1").select(*kind)), kind, "left_semi")
    firsts = clash.groupBy(*kind, "bytes").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    apart = clash.join(firsts, [*kind, "bytes"])
    verified = alike.unionByName(apart.select(*alike.columns)).where(~own.eqNullSafe(F.col("first")))
    verified = verified.where(~overlaps)
    # units that touch are one run of lines
    by = Window.partitionBy("id", "mark").orderBy("place", "span")
    ends = F.max(F.col("place") + F.col("span")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = verified.withColumn("new", F.coalesce((F.col("place") > ends).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("id", "mark", "run").agg(F.min("place").alias("b"), F.max(F.col("place") + F.col("span")).alias("e"), F.bool_or("seed").alias("seed"))
    gone = runs.groupBy("id", "mark").agg(F.collect_list(F.struct("b", "e", "seed")).alias("runs"))

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(*me, row)
    joined = rows.join(gone, same_row(rows, gone), "left").select("row", "runs")
    whole = F.col("row").getField(text)

    def chosen(lines: Column) -> Column:
        words = lambda x: F.when(x.rlike(r"\S"), F.size(F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " "))).otherwise(0)
        count = lambda r: F.aggregate(F.slice(lines, r["b"] + 1, r["e"] - r["b"]), F.lit(0), lambda n, x: n + words(x))
        return F.filter("runs", lambda r: r["seed"] | (count(r) > WORDS)) if edges else F.col("runs")

    joined = joined.withColumn("runs", F.when(F.col("runs").isNotNull(), _let(_lines(whole), chosen)))
    joined = joined.withColumn("gone", F.flatten(F.transform("runs", lambda r: F.sequence(r["b"], r["e"] - 1))))

    def rest(lines: Column) -> Column:
        # array_except hashes, so long texts stay linear
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    hit = F.coalesce(F.size("gone") > 0, F.lit(False))
    clean = F.when(hit, _let(_lines(whole), rest)).otherwise(whole)
    fields = [clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    counts = [F.when(hit, F.size(c)).otherwise(0) for c in ("runs", "gone")]
    return joined.select(*fields, counts[0].alias("removed_chunks"), counts[1].alias("removed_lines"))
