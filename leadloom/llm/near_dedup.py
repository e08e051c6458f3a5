"""SimHash's byte-position index for wider links: texts whose sets of five-word shingles overlap by 0.8 or more (Jaccard).

SimHash comes first: fingerprints of the shingles through op4's index, with its
tally and two bits; what they link is verified and is one group from the start.
Two of 64 bits are too strict for the other pairs (README), so for those the same
index runs over a longer signature: 128 positional bytes, each the low byte of a
MinHash value, which two texts share with the probability of their overlap.
Postings are keyed by four positional bytes at once, in 32 blocks; shared
blocks are tallied for each pair, and pairs under ``LEAST_BLOCKS`` are dropped.
A pair at 0.8 shares 13 of 32 blocks on average and fewer than three with a
probability of 1.2e-5. What is left is verified on the two whole sets of
shingles, so no pair below the threshold is linked.

Pairs just under 0.8 share many lists too, so a swarm of near copies would pay
for each two of them. Before a pair becomes a row it must pass an exact test: a
class carries the parities of its shingles in ``PARITIES`` cells, and in a cell
where two classes differ at least one shingle is in one of them alone. So their
sets differ by at least as many shingles as there are such cells, which bounds
the similarity from above: no link is lost.

Texts of equal words are one class and are never paired. In a posting list
every class is first held against ``PIVOTS`` of its classes, others in each list,
and one shared list is enough; classes that a verified link has brought into one
group need no further test, and only those of different groups are paired up
after that, in all lists that they share. So a swarm of near copies costs a few
pairs for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm import simhash
from leadloom.llm.common import checked_broadcast, scratch, ship
from leadloom.llm.components import connected_components
from leadloom.llm.media import _parts

#: Blocks of a signature and positional bytes of a block.
BANDS, BAND = 32, 4
#: Blocks that a pair must share.
LEAST_BLOCKS = 3
#: Rounds in which a list is held against some of its classes, and how many; each round adds jobs, so one with more classes is enough.
ROUNDS, PIVOTS = 1, 16
#: Shingles that are permuted at once.
STEP = 512
#: Cells of a class's parities, 64 in a long.
PARITIES = 1024

_random = np.random.default_rng(42)
_A = _random.integers(1, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, BANDS * BAND, np.uint64)
_PLACE = _random.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(raw: bytes | None, words: int = 5) -> tuple[int, np.ndarray]:
    """The hash of a text's words, and the sorted hashes of its distinct shingles; fewer words are one shingle."""
    import xxhash

    parts = (raw or b"").lower().split()
    whole = xxhash.xxh3_64_intdigest(b" ".join(parts))
    if len(parts) < words:
        return whole, np.array([whole] if parts else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = len(parts) - words + 1
    return whole, np.unique(_mixed(sum(h[k : k + n] * _PLACE[k] for k in range(words))))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each block of positional bytes: its number and its bytes. None for an empty set."""
    if not len(shingles):
        return shingles
    least = np.full(BANDS * BAND, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), STEP):
        h = _A[:, None] * shingles[at : at + STEP]
        h += _B[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    signature = _mixed(least).astype(np.uint8)
    return np.arange(BANDS, dtype=np.uint64) << np.uint64(32) | signature.view("<u4").astype(np.uint64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each cell is odd, one bit for each cell."""
    odd = np.bincount((shingles & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _arrow(docs: DataFrame, text: str, doc_id: str, words: int, bands: bool) -> DataFrame:
    """(doc_id, class, n, fp, bits, hashes): of each text the number of shingles, its SimHash fingerprint, parities and band keys, or nulls and its shingles."""
    ship(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                found = [shingle_set(raw, words) for raw in texts]
                prints = pa.array(simhash.fingerprint_batch(texts, words).view(np.int64)) if bands else pa.nulls(len(texts), pa.int64())
                bits = pa.array([parities(x) if bands else None for _, x in found], pa.list_(pa.int64()))
                hashes = [band_keys(x) if bands else x for _, x in found]
                ends = np.cumsum([0, *map(len, hashes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*hashes, np.zeros(0, np.uint64)]).view(np.int64)))
                whole = np.array([x for x, _ in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(whole), pa.array([len(x) for _, x in found], pa.int32()), prints, bits, lists], ["doc_id", "class", "n", "fp", "bits", "hashes"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(of, f"doc_id {kind}, class long, n int, fp long, bits array<long>, hashes array<long>")


def _alike(x: Column, y: Column, shared: Column, least: float) -> Column:
    return shared * (1 + least) >= (x + y) * least - 1e-9


def _at_most(n: Column, n2: Column, bits: Column, bits2: Column) -> Column:
    """Shingles that two sets can share: no more than the smaller one has, and of both those that no differing cell takes."""
    apart = sum((F.bit_count(bits[k].bitwiseXOR(bits2[k])) for k in range(PARITIES // 64)), F.lit(0))
    return F.least(n, n2, (n + n2 - apart) / 2)


def simhash_pairs(rows: DataFrame) -> DataFrame:
    """(src, dst) of classes that SimHash brings together: each with the first class of its fingerprint, and these where op4's index links their fingerprints."""
    prints = scratch(rows.groupBy("fp").agg(F.min("class").alias("head")), "prints")
    same = rows.select("class", "fp").distinct().join(prints, "fp").select(F.col("head").alias("x"), F.col("class").alias("y"))
    a, b = (prints.select(F.col("fp").alias(end), F.col("head").alias(name)) for end, name in (("src", "x"), ("dst", "y")))
    linked = simhash.links(prints.select("fp")).join(a, "src").join(b, "dst").select("x", "y")
    return same.unionByName(linked).where("x <> y").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, component_id.

    component_id is the smallest doc_id reachable over links of a Jaccard
    similarity of at least ``least``, the document's own included. Words are
    cut at ASCII white space, and A-Z count as lower case. Texts without a word
    are one group. Null ids are never a component_id unless no member has an
    id. Repeated rows come out as often as they go in.
    """
    rows = scratch(_arrow(docs, text, doc_id, words, True), "sketches")
    classes = scratch(rows.groupBy("class").agg(F.min("doc_id").alias("least")), "classes")
    postings = rows.select("class", "n", F.explode("hashes").alias("key")).distinct()
    met = scratch(postings.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("key"), "postings")
    held = scratch(postings.join(met, "key").join(rows.select("class", "bits").dropDuplicates(["class"]), "class"), "held")
    members, links = None, None

    def verified(pairs: DataFrame) -> DataFrame:
        nodes = scratch(pairs.select(F.explode(F.array("src", "dst")).alias("class")).distinct(), "nodes")
        ids = scratch(nodes.join(classes, "class").select(F.col("least").alias("__id")).distinct(), "ids")
        some = docs.join(checked_broadcast(ids), docs[doc_id].eqNullSafe(F.col("__id")), "left_semi")
        sets = _arrow(some, text, doc_id, words, False).select("class", "hashes").join(nodes, "class", "left_semi")
        sets = scratch(sets.dropDuplicates(["class"]), "sets")
        a, b = sets.select(F.col("class").alias("src"), F.col("hashes").alias("x")), sets.select(F.col("class").alias("dst"), F.col("hashes").alias("y"))
        both = pairs.join(a, "src").join(b, "dst")
        return both.where(_alike(F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y")), least)).select("src", "dst")

    tested = scratch(simhash_pairs(rows), "pairs")
    if not tested.isEmpty():
        links = scratch(verified(tested), "links")
        members = scratch(connected_components(links), "members")

    for at in range(ROUNDS + 1):
        own = held.withColumn("component", F.col("class"))
        if members is not None:
            own = held.join(members.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        some = [F.min_by("class", F.xxhash64("class", "key", F.lit(at * PIVOTS + k))) for k in range(PIVOTS if at < ROUNDS else 1)]
        live = own.groupBy("key").agg(F.array_distinct(F.array(*some)).alias("pivots"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        own = scratch(own.join(live.select("key"), "key", "left_semi"), "open") if at == ROUNDS else own
        other = own.join(live.select("key", F.explode("pivots").alias("class")), ["key", "class"]) if at < ROUNDS else own
        other = other.select("key", F.col("class").alias("class2"), F.col("n").alias("n2"), F.col("bits").alias("bits2"), F.col("component").alias("component2"))
        # sets of such different sizes can't overlap enough, nor can sets that differ in so many cells
        n, n2 = F.col("n"), F.col("n2")
        close = _alike(n, n2, F.least(n, n2), least) & _alike(n, n2, _at_most(n, n2, F.col("bits"), F.col("bits2")), least)
        pairs = own.join(other, "key").where((F.col("component") != F.col("component2")) & close)
        bit = F.expr("shiftleft(1, cast(shiftright(key, 32) as int))")
        pairs = simhash.tallied(pairs.select(F.least("class", "class2").alias("src"), F.greatest("class", "class2").alias("dst"), bit.alias("bit")), LEAST_BLOCKS if at == ROUNDS else 1)
        pairs = scratch(pairs.join(tested, ["src", "dst"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        if pairs.isEmpty():
            continue
        found = scratch(verified(pairs), "links")
        links = found if links is None else links.unionByName(found)
        members = scratch(connected_components(links), "members")

    named = classes.select("class", F.col("least").alias("component_id"))
    if members is not None:
        members = members.join(classes, members.node == classes["class"]).select("component", "class", "least")
        lowest = members.groupBy("component").agg(F.min("least").alias("component_id"))
        found = members.join(lowest, "component").select("class", "component_id")
        named = classes.join(found, "class", "left").select("class", F.coalesce("component_id", "least").alias("component_id"))
    # from a table of its own both sides shuffle for this join alone, so a hot class's partition can be split
    return rows.select("doc_id", "class").join(scratch(named, "named"), "class").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group, as in ``simhash.keep_one``."""
    return simhash.keep_one(docs, near_groups(docs, text, doc_id, words, least), doc_id)
