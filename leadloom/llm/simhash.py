"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most two bits differ in at most two
of their eight bytes, so they share at least six positional bytes. One posting
list for each single positional byte would hold 1/256 of all fingerprints, and
its pairs would grow with the square of the input; so a posting is keyed by
four positional bytes at once, in 14 blocks of four that form the Steiner
system S(3, 4, 8). In it every two places are avoided by exactly three blocks,
and every three by exactly one: fingerprints that share six positional bytes
are hit in three blocks or more, those that share five in one, and those that
share four in one at most. So hits are tallied for each pair, pairs under the
guaranteed minimum of three are dropped, and what is left is verified bit by bit.

A list of more than ``longest`` fingerprints is split, within the same index,
by two more positional bytes: fingerprints of a list that share six bytes share
at least two of the four outside its block, so they meet again in one of six
finer lists, and their tally is the same. A finer list leaves two bytes open,
so it holds at most 65,536 fingerprints, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import checked_broadcast, scratch, ship
from leadloom.llm.components import connected_components
from leadloom.llm.media import _parts

#: Row b: the bits of byte value b, lowest first.
BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint_batch(texts: list[bytes | None], words: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit SimHash fingerprints of UTF-8 texts; zero for a text without a word."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    counts, hashes = [], []
    for raw in texts:
        parts = (raw or b"").lower().split()
        if not parts:
            counts.append(0)
            continue
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        if len(parts) <= words:
            cuts = [(0, len(joined))]
        else:
            first = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1]
            cuts = zip(first.tolist(), ends[words - 1 :].tolist(), strict=True)
        found = [digest(joined[a:b], seed) for a, b in cuts]
        counts.append(len(found))
        hashes.append(np.array(found, np.uint64))
    n = np.array(counts, np.int64)
    if not hashes:
        return np.zeros(len(texts), np.uint64)
    h = np.concatenate(hashes)
    row = np.repeat(np.arange(len(texts)) * 256, n)
    out = np.zeros(len(texts), np.uint64)
    for p in range(8):
        byte = ((h >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64)
        seen = np.bincount(row + byte, minlength=256 * len(texts)).reshape(-1, 256)
        most = (seen @ BITS) * 2 > n[:, None]
        out |= (most.astype(np.uint64) << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * p)
    return out


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long. A-Z count as lower case."""
    ship(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                fp = fingerprint_batch(part.column(1).cast(pa.binary()).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(of, f"doc_id {kind}, fp long")


#: The blocks of S(3, 4, 8): the planes of the affine space of three bits.
BLOCKS = tuple(tuple(p for p in range(8) if (p & m).bit_count() % 2 == c) for m in range(1, 8) for c in (0, 1))
#: Blocks that two fingerprints with six positional bytes in common share at least.
LEAST = 3


def _bytes_at(fp: Column, places: tuple[int, ...]) -> Column:
    """The positional bytes at some places, side by side in one long."""
    parts = [F.shiftleft(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(0xFF), 8 * k) for k, p in enumerate(places)]
    return sum(parts[1:], parts[0])


def _finer(block: tuple[int, ...]) -> list[tuple[int, ...]]:
    outside = [p for p in range(8) if p not in block]
    return [(p, q) for i, p in enumerate(outside) for q in outside[i + 1 :]]


def list_pairs(lists: DataFrame) -> DataFrame:
    """(src, dst, bit) for every two of each list ``fps``, which is in order. Lists stream: no more than one row of pairs is held."""
    placed = lists.select("bit", "fps", F.posexplode("fps").alias("i", "src"))
    return placed.where(F.col("i") < F.size("fps") - 1).select("src", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("dst"), "bit")


def tallied(hits: DataFrame, least: int) -> DataFrame:
    """(src, dst) of the pairs that are hit in at least ``least`` blocks; hits: (src, dst, bit), one bit for each block."""
    return hits.groupBy("src", "dst").agg(F.bit_or("bit").alias("bits")).where(F.bit_count("bits") >= least).select("src", "dst")


def candidates(prints: DataFrame, longest: int = 64, least: int = LEAST) -> DataFrame:
    """(src, dst) of distinct fingerprints ``fp``, src < dst, that share at least ``least`` blocks of positional bytes."""
    keys = F.array(*(_bytes_at(F.col("fp"), block) for block in BLOCKS))
    postings = prints.select("fp", F.posexplode(keys).alias("block", "key"))
    sizes = scratch(postings.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "postings")
    held = postings.join(sizes, ["block", "key"]).withColumn("bit", F.expr("shiftleft(1, block)"))
    listed = F.array_sort(F.collect_list("fp")).alias("fps")
    short = held.where(F.col("n") <= longest).groupBy("bit", "key").agg(listed).select("bit", "fps")
    finer = F.element_at(F.array(*(F.array(*(_bytes_at(F.col("fp"), two) for two in _finer(block))) for block in BLOCKS)), F.col("block") + 1)
    split = held.where(F.col("n") > longest).select("fp", "bit", "key", F.posexplode(finer).alias("side", "more"))
    long = split.groupBy("bit", "key", "side", "more").agg(listed).where(F.size("fps") > 1).select("bit", "fps")
    return tallied(list_pairs(short.unionByName(long)), least)


def links(prints: DataFrame, longest: int = 64) -> DataFrame:
    """(src, dst): all links, of at most two differing bits, among distinct fingerprints ``fp``."""
    return candidates(prints, longest).where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 2)


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, longest: int = 64) -> DataFrame:
    """One row per document: doc_id, fp, component_id.

    component_id is the smallest doc_id reachable over links of at most two
    differing bits, the document's own included. Null and empty texts have the
    fingerprint zero and are linked like any other. Null ids are never a
    component_id unless no member has an id. Repeated rows come out as often
    as they go in. Extra columns are ignored; an empty table gives no rows.
    """
    rows = scratch(fingerprints(docs, text, doc_id, words), "fingerprints")
    classes = scratch(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    members = connected_components(links(classes.select("fp"), longest))
    members = members.join(classes, members.node == classes.fp).select("component", "fp", "least")
    lowest = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = members.join(lowest, "component").select("fp", "component_id")
    named = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # from a table of its own both sides shuffle for this join alone, so a hot fingerprint's partition can be split
    return rows.join(scratch(named, "named"), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3) -> DataFrame:
    """``docs`` with one document of each SimHash group, as in ``keep_one``."""
    return keep_one(docs, simhash_groups(docs, text, doc_id, words), doc_id)


def keep_one(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each of ``groups`` (doc_id, component_id), the one with the smallest id.

    Of rows that share the staying id one stays. Documents without an id can't
    be named and stay. Texts are shuffled only where the ids to drop are too
    many to broadcast.
    """
    groups = groups.where("doc_id IS NOT NULL")
    drop = scratch(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct(), "dropped")
    again = scratch(groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__id")).count().where("count > 1").select("__id"), "repeated")
    stay = docs.join(checked_broadcast(drop), docs[doc_id] == F.col("__id"), "left_anti")
    if again.isEmpty():
        return stay
    again = checked_broadcast(again)
    once = stay.join(again, stay[doc_id] == F.col("__id"), "left_anti")
    return once.unionByName(stay.join(again, stay[doc_id] == F.col("__id"), "left_semi").dropDuplicates([doc_id]))
