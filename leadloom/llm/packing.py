"""Best-fit packing of tokenised documents into training sequences.

Sequences of up to ``capacity`` tokens are bins, and piece lengths are whole
numbers up to it, so a corpus of any size is a histogram of at most
``capacity`` counts. Over that histogram the configuration linear program
(how often to use each way of filling a sequence) is solved by multiplicative
weights: lengths that are covered least weigh most, and a knapsack dynamic
program prices the best configuration. Amounts are rounded down to whole
sequences, and what is left is packed by best fit, in groups of equal bins, so
that the work and the plan depend on the capacity and not on the corpus. Pieces
then find their places by their rank among those of equal length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import scratch, ship
from leadloom.llm.media import _parts

CAPACITY = 2048


#: How byte-level BPE files without a pattern of their own part a text (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: A run of white space (of any kind that a pattern's ``\s`` means) too long for the pattern's look-ahead.
LONG_SPACE = re.compile("[\t-\r \x85\xa0  -     　]{500,}")


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes: those of ``tokenizers`` with its defaults and no special tokens added.

    A plain byte-level BPE file is run by tiktoken, which takes its vocabulary
    as ranks and gives the same ids in a quarter of the time; any other file by
    ``tokenizers`` itself. Two things are done before tiktoken reads a text.
    Added tokens are cut out, as ``tokenizers`` does. And a long run of white
    space goes to ``tokenizers``, because tiktoken can't look ahead over it: no
    word of the pattern ends in white space, so one always ends where the run
    begins, and the next ends before the run's last character if text follows,
    else at the run's end. Cutting there changes no word.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens", [])
        plain = model["type"] == "BPE" and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True) and not spec.get("normalizer")
        plain = plain and not any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip"))
        self.fast, self.added = None, {}
        if plain:
            self.added = {t["content"]: t["id"] for t in added}
            self.marks = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) or r"(?!)")
            printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(b): b for b in printed} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printed)}
            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
            self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> list[int]:
        ids, at = [], 0
        for run in LONG_SPACE.finditer(text):
            a, b = run.span()
            b -= b < len(text)
            ids += self.fast.encode_ordinary(text[at:a]) if a > at else []
            ids += self.tokenizer.encode(text[a:b], add_special_tokens=False).ids
            at = b
        return ids + self.fast.encode_ordinary(text[at:]) if at else self.fast.encode_ordinary(text)

    def encode(self, text: str) -> bytes:
        if self.fast is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids, at = [], 0
            for mark in self.marks.finditer(text):
                ids += [*self._ids(text[at : mark.start()]), self.added[mark.group()]]
                at = mark.end()
            ids = ids + self._ids(text[at:]) if at else self._ids(text)
        return np.array(ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids followed by id 0.

    Only documents of more than ``capacity`` ids are cut, into pieces of that
    many, of which the first may be shorter.
    """
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part in _parts(batch, 4 << 20):
                rows: list[tuple] = []
                for i, text_ in enumerate(part.column(1).to_pylist()):
                    ids = encoder.encode(text_ or "") + bytes(4)
                    n = len(ids) // 4
                    at, end, piece = 0, (n - 1) % capacity + 1, 0
                    while at < n:
                        rows.append((i, piece, at, end - at, zlib.crc32(ids[4 * at : 4 * end])))
                        at, end, piece = end, end + capacity, piece + 1
                place, piece, start, length, crc = (np.array(x, np.int64) for x in (zip(*rows) if rows else [()] * 5))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(place)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def knapsack(lengths: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length is in the most valuable configuration; dynamic program over binary units."""
    item, times = [], []
    for i, m in enumerate(np.minimum(most, capacity // lengths).tolist()):
        unit = 1
        while m > 0:
            k = min(unit, m)
            item.append(i)
            times.append(k)
            m -= k
            unit *= 2
    best, took = np.zeros(capacity + 1), np.zeros((len(item), capacity + 1), bool)
    for u, (i, k) in enumerate(zip(item, times, strict=True)):
        w = int(lengths[i]) * k
        with_it = best[: capacity + 1 - w] + values[i] * k
        took[u, w:] = with_it > best[w:]
        best[w:] = np.maximum(best[w:], with_it)
    counts, room = np.zeros(len(lengths), np.int64), int(np.argmax(best))
    for u in range(len(item) - 1, -1, -1):
        if took[u, room]:
            counts[item[u]] += times[u]
            room -= int(lengths[item[u]]) * times[u]
    return counts


def configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, power: float, sharpness: float = 0.1, priced: int = 160, tail: float = 0.25) -> dict[tuple, int]:
    """A cover of the demand, configuration -> how often, by multiplicative weights.

    A length's price starts as its share of a sequence, raised to ``power``
    (over 1, long pieces come first, as in best-fit decreasing), and falls as
    its demand is covered. Each round adds the configuration of the highest
    price, rounded down to whole times: as often as demand lasts, but to at most
    a ``rounds``-th of the sequences that are needed, after which prices have
    moved. So each round uses up a length or such a part, and there are no more
    rounds than lengths and ``rounds`` together. The knapsack chooses among
    ``priced`` lengths at once: a quarter of them the dearest, the others
    spread evenly over the rest, by turns. The last ``tail`` of the tokens is
    left over: without small pieces to choose from, configurations leave gaps.
    """
    most = max(1, int((lengths * demand).sum() / capacity / rounds))
    rest, found = demand.astype(np.int64), defaultdict(int)
    for turn in range(len(lengths) + 2 * rounds):
        open_ = np.flatnonzero(rest)
        if (lengths * rest).sum() <= tail * (lengths * demand).sum():
            break
        part = 1 - rest[open_] / demand[open_]
        price = (lengths[open_] / capacity) ** power * np.exp(-sharpness * (part - part.min()))
        if len(open_) > priced:
            order = np.argsort(-price, kind="stable")
            dear, others = order[: priced // 4], order[priced // 4 :]
            every = -(-len(others) // (priced - priced // 4))
            taken = np.concatenate([dear, others[turn % every :: every]])
            open_, price = open_[taken], price[taken]
        counts = knapsack(lengths[open_], price, rest[open_], capacity)
        used = np.flatnonzero(counts)
        times = int(min(most, (rest[open_[used]] // counts[used]).min()))
        content = sorted(((int(lengths[open_[i]]), int(counts[i])) for i in used), reverse=True)
        found[tuple(content)] += times
        rest[open_[used]] -= counts[used] * times
    return found


def best_fit(rest: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing, in groups of bins of equal content."""
    bins: dict[int, list[list]] = defaultdict(list)  # free room -> [content, copies]
    for length in sorted((x for x in rest if rest[x]), reverse=True):
        left = rest[length]
        for room in sorted(r for r in bins if r >= length):
            each = room // length
            groups, bins[room] = bins[room], []
            while groups and left:
                content, copies = groups.pop()
                full = min(copies, left // each)
                if full:
                    bins[room - each * length].append([(*content, (length, each)), full])
                    left -= full * each
                if full < copies:
                    if left:
                        bins[room - left * length].append([(*content, (length, left)), 1])
                        full, left = full + 1, 0
                    if full < copies:
                        groups.append([content, copies - full])
            bins[room] += groups
            if not left:
                break
        each = capacity // length
        if left // each:
            bins[capacity - each * length].append([((length, each),), left // each])
        if left % each:
            bins[capacity - left % each * length].append([((length, left % each),), 1])
    return [(content, copies) for groups in bins.values() for content, copies in groups]


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 100, power: float = 1.02) -> list[tuple[tuple, int, bool]]:
    """[(((length, times), ...), copies, planned), ...]: a packing of all pieces of the histogram.

    planned: the configuration comes from the linear program; the others are
    best fit for what rounding left.
    """
    done: list[tuple[tuple, int, bool]] = []
    rest = {x: n for x, n in histogram.items() if n}
    if rest.get(capacity):
        done.append((((capacity, 1),), rest.pop(capacity), True))
    if rest:
        lengths = np.array(sorted(rest), np.int64)
        demand = np.array([rest[x] for x in lengths.tolist()], np.float64)
        for content, copies in configurations(lengths, demand, capacity, rounds, power).items():
            done.append((content, copies, True))
            for x, k in content:
                rest[x] -= k * copies
        done += [(*each, False) for each in best_fit(rest, capacity)]
    return done


def _places(plan: list[tuple[tuple, int, bool]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, times a sequence, offset, planned), by length and rank."""
    rows, used, sequence = [], defaultdict(int), 0
    for content, copies, planned in plan:
        offset = 0
        for length, times in content:
            rows.append((length, used[length], sequence, times, offset, planned))
            used[length] += times * copies
            offset += length * times
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = 100) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ...) with sequence_id, offset and planned.

    Every sequence holds at most ``capacity`` tokens without a gap; planned says
    whether it was filled by a configuration of the linear program. Ranks among
    pieces of one length are counted in salted groups of bounded size. Repeated
    pieces are packed as often as they come. No piece, no row.
    """
    spark = pieces.sparkSession
    ship(spark)
    pieces = scratch(pieces, "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = spark.sparkContext.broadcast(_places(solve(histogram, capacity, rounds)))
    total = sum(histogram.values())
    if capacity >= 1 << 13:
        raise ValueError("length and rank share 63 bits: the capacity must be below 8192")
    group = min(65536, max(256, total // (8 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    salts = F.lit(-(-max([1, *histogram.values()]) // group)).cast("long")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts))
    sizes = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy(F.col("doc_id"), "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("rank"))
    columns = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        key = table[:, 0] * (1 << 50) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            _, first, sequence, times, offset, planned = table[np.searchsorted(key, length * (1 << 50) + rank, "right") - 1].T
            nth = rank - first
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(sequence + nth // times), pa.array(offset + nth % times * length), pa.array(planned > 0)],
                [*columns, "sequence_id", "offset", "planned"],
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long, planned boolean"
    return ranked.select(*columns, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Tokenise ``docs`` and pack all pieces. Null and empty texts are one piece of the one id 0.

    Null ids are kept; rows that share an id are packed one by one. Extra
    columns are ignored; an empty table gives an empty result.
    """
    return pack(token_pieces(docs, tokenizer, capacity, text, doc_id), capacity)
