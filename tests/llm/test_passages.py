"""Passage dedup on planted passages that chunk boundaries would not cut out, and against a plain restatement."""

import random
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from leadloom.llm import line_dedup

SCHEMA = "doc_id long, text string"


def cuts(lines):
    """(begin, end) of the chunks of lines, with the hashes of a library of its own."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    hashes = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in lines]
    begins = [0]
    for i in range(1, len(lines)):
        h = 42
        for k in range(line_dedup.WINDOW, 0, -1):
            h = xxhash.xxh64_intdigest(struct.pack("<q", hashes[i - k]), h) if i >= k else h
        if (i >= line_dedup.WINDOW and signed(h) % line_dedup.EVERY == 0) or i - begins[-1] == line_dedup.LONGEST:
            begins.append(i)
    return list(zip(begins, [*begins[1:], len(lines)], strict=True))


def plain(rows, seeds=True):
    """(doc_id, text, removed_lines) of every row; ids are distinct. Runs of repeated pairs (and long lines, and chunks) go
    if they hold a repeated chunk of two lines that aren't blank, or over fifty words."""
    seen, out = {}, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines, gone, sown = (text or "").split("\n"), set(), set()
        chunks = {(b, e - b): sum(bool(x.strip()) for x in lines[b:e]) > 1 for b, e in cuts(lines) if e - b > 1 and "".join(lines[b:e]).strip()}
        units = set(chunks) | {(k, 2) for k in range(len(lines) - 1) if (lines[k] + lines[k + 1]).strip()}
        units |= {(k, 1) for k in range(len(lines)) if len(lines[k].split()) > 50}
        for k, span in sorted(units):
            first = seen.setdefault(tuple(lines[k : k + span]), (i, k))
            if first != (i, k) and (first[0] != i or k >= first[1] + span):
                gone |= set(range(k, k + span))
                if chunks.get((k, span)) and seeds:
                    sown.add(k)
        at = 0
        while at < len(lines):
            end = at
            while end in gone:
                end += 1
            if end > at and not sown & set(range(at, end)) and len(" ".join(lines[at:end]).split()) <= 50:
                gone -= set(range(at, end))
            at = end + 1
        out.append((i, None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out


def planted():
    r = random.Random(3)
    line = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(n))
    rows, passages = [], []
    for p in range(30):
        passage = [line(60)] if p % 3 == 0 else [line(30) for _ in range(2 + p % 5)]
        passages.append(passage)
        for copy in range(3):
            before, after = [line(8) for _ in range(r.randrange(4))], [line(8) for _ in range(r.randrange(4))]
            rows.append((len(rows), "\n".join(before + passage + after), "\n".join(before + (passage if not copy else []) + after)))
    return rows, passages


def test_planted_passages_go_whole(spark):
    rows, _ = planted()
    df = spark.createDataFrame([r[:2] for r in rows], SCHEMA)
    got = {r["doc_id"]: (r["text"], r["removed_chunks"]) for r in line_dedup.line_dedup(df).collect()}
    assert got == {i: (want, int(i % 3 > 0)) for i, _, want in rows}
    # the chunks of lines lose most of them
    old = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df, edges=False).collect()}
    assert sum(old[i] != want for i, _, want in rows) > 20


def test_agrees_with_plain_restatement(spark):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice(["", " ", "a", "b", "c d", "e", "x " * 51, "y " * 50]) for _ in range(r.randint(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "same\n" * 500), (104, "z " * 51), (105, "z " * 51)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("removed_lines", F.lit("clash"))
    got = line_dedup.line_dedup(df).collect()
    want = plain(rows)
    assert Counter((x["doc_id"], x["text"], x["removed_lines"]) for x in got) == Counter(want)
    # it is the chunks that decide: without them fewer lines go
    assert 0 < sum(x[2] for x in plain(rows, seeds=False)) < sum(x[2] for x in want)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_headings_and_short_answers_stay(spark):
    texts = ["intro one\n\nSummary\n\nbody a", "intro two\n\nSummary\n\nbody b", "Yes\nNo", "Yes\n\nNo", "\nSummary\n"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == dict(enumerate(texts))


def test_long_texts_take_time_in_proportion(spark):
    """A text of 200,000 lines, and a copy of it under another beginning."""
    lines = [f"line {i * 7919 % 100_003} of a long text" for i in range(200_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "new\n" + "\n".join(lines)), (3, "x" * 10_000_000)], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df).collect()}
    # within the text the lines come round once
    assert got[1] == "\n".join(lines[:100_003]) and got[2] == "new" and len(got[3]) == 10_000_000


def test_equal_digests_are_compared_by_bytes(spark, monkeypatch):
    """With a digest that says nothing, only equal bytes go, later ones that differ from the first too."""
    from pyspark.sql import functions

    monkeypatch.setattr(functions, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 and "slice" in str(c[0]) else real(*c))
    a, b, c, d = (f"{x} " * 30 for x in ("aa", "bb", "cc", "dd"))
    texts = [f"{a}\n{b}", f"{c}\n{d}", f"{c}\n{d}\nend", f"{a}\n{b}\nfin"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: "end", 3: "fin"}


real = F.xxhash64
