"""Order without a single task: dense places, and greedy pages, by ranges of a sort.

Where a greedy page ends depends on all before it. But what a range of items
does to the pages is a small function of how full the page is on entry: the
first page that begins in the range is decided by that alone, and from there
the rest follows. So every range tabulates, for each item at which its first
page can begin, how many pages it adds and how full it leaves the last one;
composing those tables gives every range its entry, and then all number their
items at once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.session import materialize


def placed(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``rows`` with ``__range`` and ``__at``: the range of the sort and the place in it, stored with the rows."""
    at = F.monotonically_increasing_id()
    return materialize(rows.orderBy(*order).withColumn("__range", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND((1 << 33) - 1)), "placed")


def numbered(rows: DataFrame, order: Sequence[str | Column], start: int = 0, name: str = "change_id") -> DataFrame:
    """``rows`` with dense ids from start + 1 in order; only the ranges' counts meet."""
    at = placed(rows, order)
    offsets, total = [], start
    for r in sorted(at.groupBy("__range").count().collect()):
        offsets.append((r["__range"], total))
        total += r["count"]
    known = rows.sparkSession.createDataFrame(offsets, "__range long, __before long")
    return at.join(F.broadcast(known), "__range").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")


def _next(run: np.ndarray, cap: int, heads: np.ndarray) -> np.ndarray:
    """Where the page after one that begins at each item begins: where the sizes pass ``cap`` or a group begins, one item on at least."""
    n = len(run) - 1
    by_size = np.searchsorted(run, run[:-1] + cap, "right") - 1
    return np.minimum(np.maximum(by_size, np.arange(n) + 1), np.append(heads, n)[np.searchsorted(heads, np.arange(n), "right")])


def _table(sizes: np.ndarray, groups: np.ndarray, cap: int) -> list[tuple]:
    """(first item that begins a page, bytes before it, pages from there, how full the last one is) for each such item; n stands for none."""
    n, run = len(sizes), np.concatenate(([0], np.cumsum(sizes)))
    heads = np.flatnonzero(groups[1:] != groups[:-1]) + 1
    after = _next(run, cap, heads)
    pages, full = np.ones(n, np.int64), run[n] - run[:n]
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            pages[i], full[i] = pages[after[i]] + 1, full[after[i]]
    last = int(min(np.searchsorted(run, cap, "right") - 1, heads[0] if len(heads) else n))
    rows = [(i, int(run[i]), int(pages[i]), int(full[i])) for i in range(min(last, n - 1) + 1)]
    return [*rows, (n, int(run[n]), 0, 0)] if last == n else rows


def greedy_pages(rows: DataFrame, key: str, size: Column, limit: int, overhead: int, group: Sequence[str] = ()) -> DataFrame:
    """(group, key, page, used): items in the order of key fill a page until the next would pass the limit.

    An item above the limit has a page of its own. Each group has pages of its
    own, from 1. Equal keys are ordered by size. Null sizes count as 0; no row,
    no page. A task holds the keys and sizes of one range of the sort, the
    driver for each range as many numbers as items fit a page.
    """
    spark, cap = rows.sparkSession, limit - overhead
    sized = rows.select(*group, key, F.coalesce(size.cast("long"), F.lit(0)).alias("__size"), F.xxhash64(*group).alias("__group") if group else F.lit(0).cast("long").alias("__group"))
    # groups are kept together by their values, not by their hash
    at = placed(sized, [*group, key, "__size"])
    narrow = at.select("__range", "__at", "__size", "__group")

    def columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(table.column("__at").to_numpy(), kind="stable")
        return order, table.column("__size").to_numpy()[order], table.column("__group").to_numpy()[order]

    def tabulate(table: pa.Table) -> pa.Table:
        _, sizes, groups = columns(table)
        found = list(zip(*_table(sizes, groups, cap), strict=True))
        names = ["first", "before", "pages", "full"]
        lists = [pa.array([list(v)], pa.list_(pa.int64())) for v in found]
        ends = [pa.array([int(v)], pa.int64()) for v in (table.column("__range")[0].as_py(), groups[0], groups[-1])]
        return pa.table([*ends, *lists], ["__range", "head", "tail", *names])

    tables = narrow.groupBy("__range").applyInArrow(tabulate, "__range long, head long, tail long, first array<long>, before array<long>, pages array<long>, full array<long>")
    entries, page, used, tail = [], 0, 0, None
    for r in sorted(tables.collect(), key=lambda r: r["__range"]):
        # a new page is due at once at the start, and where a group begins with the range
        fresh = tail is None or r["head"] != tail
        i = 0 if fresh else bisect_right(r["before"], cap - used) - 1
        i = max(i, 0)
        entries.append((r["__range"], page, used, r["first"][i]))
        page += r["pages"][i]
        used = r["full"][i] if r["pages"][i] else used + r["before"][i]
        tail = r["tail"]
    known = spark.createDataFrame(entries, "__range long, __page long, __used long, __first long")

    def assign(table: pa.Table) -> pa.Table:
        order, sizes, groups = columns(table)
        run, n = np.concatenate(([0], np.cumsum(sizes))), len(sizes)
        after = _next(run, cap, np.flatnonzero(groups[1:] != groups[:-1]) + 1)
        begins, i = [], table.column("__first")[0].as_py()
        while i < n:
            begins.append(i)
            i = int(after[i])
        begins = np.array(begins, np.int64)
        which = np.searchsorted(begins, np.arange(n), "right")
        base = np.concatenate(([-table.column("__used")[0].as_py()], run[begins]))[which]
        out = {"__range": table.column("__range").to_numpy()[order], "__at": table.column("__at").to_numpy()[order], "page": table.column("__page")[0].as_py() + which, "used": run[1:] - base + overhead}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    numbers = narrow.join(F.broadcast(known), "__range").groupBy("__range").applyInArrow(assign, "__range long, __at long, page long, used long")
    out = at.join(numbers, ["__range", "__at"]).select(*group, key, "page", "used")
    if group:
        least = out.groupBy(*group).agg(F.min("page").alias("__least"))
        same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
        least = least.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), "__least")
        out = out.join(least, same).withColumn("page", F.col("page") - F.col("__least") + 1).select(*group, key, "page", "used")
    return out


def digits(column: Column) -> Column:
    return F.length(column.cast("string"))


def json_pages(items: DataFrame, key: str, text: str, head: str, limit: int, stem: str = "delta_packet", room: int | None = None) -> DataFrame:
    """(page, file, document): JSON documents of at most ``limit`` bytes that hold all items in the order of key.

    items: unique keys with one JSON object each; head: the members that every
    document begins with, as JSON text without braces. A document names its
    page, the number of pages, the next file and its own length in characters.
    Numbers of pages are given the room of the last one's digits, so once the
    number of pages is known, sizes are counted again until it stays. With
    ``room`` no number is given more digits than that, unless a document would
    then pass the limit. An item that fits no page is an error. No item: one
    page without items.
    """
    spark, total, count = items.sparkSession, 1, items.count()
    lead = f"{head}," if head else ""
    shape = lambda page, pages, following: f'{{{lead}"count":{count},"estimated_chars":,"pagination":{{"next_file":{following},"page":{page},"total_pages":{pages}}},"items":[]}}'
    name = lambda page: f'"{stem}.p{page}.json"'
    if not count:
        bare = shape(1, 1, "null")
        n = next(len(bare) + d for d in range(1, 20) if len(str(len(bare) + d)) == d)
        return spark.createDataFrame([(1, f"{stem}.json", bare.replace('"estimated_chars":', f'"estimated_chars":{n}', 1))], "page long, file string, document string")
    while True:
        wide = "9" * min(len(str(total)), room or len(str(total)))
        overhead = len(shape(wide, wide, name(wide)).encode()) + len(str(limit)) - 1
        pages = materialize(greedy_pages(items, key, F.octet_length(text) + 1, limit, overhead), "pages")
        top = pages.agg(F.max("page").alias("pages"), F.max("used").alias("most")).first()
        if top["most"] > limit:
            raise ValueError(f"an item does not fit a page of {limit} bytes")
        if len(str(top["pages"])) > len(str(total)):
            total = top["pages"]
            continue
        if len(wide) == len(str(total)):
            break
        # the last page names no next one, which leaves more than the digits need
        own = F.col("used") - 3 * len(wide) + digits(F.col("page")) + digits(F.col("page") + 1) + len(str(top["pages"]))
        if pages.where(F.col("page") < top["pages"]).agg(F.max(own)).first()[0] <= limit:
            break
        room = len(wide) + 1
    pages_n = F.lit(top["pages"])
    lists = items.join(pages.select(key, "page"), key).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, text))), lambda x: x[text]), ",").alias("list"))
    follow = F.when(F.col("page") < pages_n, F.concat(F.lit(f'"{stem}.p'), (F.col("page") + 1).cast("string"), F.lit('.json"'))).otherwise(F.lit("null"))
    rest = F.concat(F.lit(',"pagination":{"next_file":'), follow, F.lit(',"page":'), F.col("page").cast("string"), F.lit(',"total_pages":'), pages_n.cast("string"), F.lit('},"items":['), "list", F.lit("]}"))
    begin = f'{{{lead}"count":{count},"estimated_chars":'
    own = F.length(rest) + len(begin)
    chars = F.coalesce(*(F.when(digits(own + d) == d, own + d) for d in range(1, 12)))
    file = F.concat(F.lit(stem), F.when(F.col("page") == 1, "").otherwise(F.concat(F.lit(".p"), F.col("page").cast("string"))), F.lit(".json"))
    return lists.select("page", file.alias("file"), F.concat(F.lit(begin), chars.cast("string"), rest).alias("document"))
