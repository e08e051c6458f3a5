"""Every corpus operator against a plain restatement, on texts that are null, empty, long, tied or repeated."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadloom.llm import components, exact_dedup, license_scan, line_dedup, media, mixing, packing, quality, sharding, simhash, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; none may clash.
CLASH = ("digest", "fp", "h", "size", "rank", "copies", "bin", "salt", "votes", "u", "gone", "row", "source_", "text_sha256", "id", "mark", "parts", "target", "s")


def corpus(seed=1, n=140):
    r = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "ä", "le"]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [line(9) for _ in range(12)]
    rows = []
    for i in range(n):
        lines = [line(r.randint(1, 14)) for _ in range(r.randint(1, 9))]
        if i % 5 == 0:
            lines[1:1] = shared
        rows.append([i, "\n".join(lines)])
    for i in range(0, 40, 4):
        rows[i + 1][1] = rows[i][1]  # copies
        rows[i + 2][1] = rows[i][1].replace("alpha", "beta", 1)  # near copies
        rows[i + 3][1] = rows[i][1].replace(" ", " \t ")  # equal but for white space
    rows += [[500, None], [501, ""], [502, " \n\t "], [503, "one"], [504, "one two"], [505, "x y z " * 30_000], [506, None], [507, "\n".join(["same line"] * 500)]]
    rows += [[3, rows[3][1]], [None, "no id here at all"], [None, rows[0][1]]]
    return [(i, t, "en", None if i == 7 else f"s{(i or 0) % 4}", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(docs, rows, none):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t, *_ in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want[(i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    for heavy in (512, 2):
        got = Counter(tuple(r) for r in exact_dedup.exact_dedup(docs, heavy=heavy).collect())
        assert got == want
    assert exact_dedup.exact_dedup(none).count() == 0


def brute_fingerprint(t):
    import xxhash

    w = (t or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    tally = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            tally[b] += h >> b & 1
    return sum(1 << b for b in range(64) if parts and 2 * tally[b] > len(parts))


def brute_components(ids, linked):
    label = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("longest", [64, 2])
def test_simhash(docs, rows, longest):
    prints = {t: brute_fingerprint(t) for _, t, *_ in rows}
    nodes = sorted(set(prints.values()))
    label = brute_components(nodes, [(a, b) for a, b in itertools.combinations(nodes, 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for i, t, *_ in rows:
        k = label[prints[t]]
        if i is not None:
            least[k] = min(least.get(k, i), i)
    got = Counter((r["doc_id"], r["hex"], r["component_id"]) for r in simhash.simhash_groups(docs, longest=longest).withColumn("hex", simhash.hexadecimal(F.col("fp"))).collect())
    assert got == Counter((i, f"{prints[t]:016x}", least.get(label[prints[t]])) for i, t, *_ in rows)


@pytest.mark.parametrize("longest", [1000, 1])
def test_simhash_links_are_all_pairs(spark, longest):
    """Random swarms of fingerprints: whole and split lists give exactly the links of all pairs, and the tally drops pairs."""
    r, values = random.Random(longest), set()
    for _ in range(40):
        centre = r.getrandbits(64)
        for _ in range(12):
            values.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    nodes = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    shared = lambda a, b: sum(not (a ^ b) >> 8 * p & 255 for p in range(8))
    pairs = list(itertools.combinations(nodes, 2))
    want = {(a, b) for a, b in pairs if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    prints = spark.createDataFrame([(n,) for n in nodes], "fp long")
    assert {(x["src"], x["dst"]) for x in simhash.links(prints, longest).collect()} == want and len(want) > 200
    # the tally is exact: pairs with six positional bytes in common and no others, far fewer than meet in some list
    kept = {(x["src"], x["dst"]) for x in simhash.candidates(prints, longest).collect()}
    assert kept == {(a, b) for a, b in pairs if shared(a, b) >= 6}
    met = {(x["src"], x["dst"]) for x in simhash.candidates(prints, 1000, least=1).collect()}
    assert len(met) > 1.3 * len(kept)


def test_blocks():
    """S(3, 4, 8): every three places are in one block, so two are avoided by three blocks."""
    assert len(simhash.BLOCKS) == 14
    for t in itertools.combinations(range(8), 3):
        assert sum(set(t) <= set(b) for b in simhash.BLOCKS) == 1 == sum(not set(t) & set(b) for b in simhash.BLOCKS)
    for t in itertools.combinations(range(8), 2):
        assert sum(not set(t) & set(b) for b in simhash.BLOCKS) == 3


def test_one_of_each(docs, rows):
    got = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    groups = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    assert sorted(x for x in got if x is not None) == sorted({c for i, c in groups if i is not None and i == c})
    assert got.count(None) == 2


def test_fingerprints_of_nothing(none):
    assert simhash.simhash_groups(none).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (7, None), (3, 1), (12, 10), (12, 10)] + [(100, 100 + k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(60)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10} | {100 + k: 100 for k in range(300)} | {1000 + k: 1000 for k in range(61)}
    assert got == want


def test_sharding(docs, rows, none):
    written = sharding.write_shards(docs, shards=8, bucket_bytes=4000)
    got = [tuple(r) for r in sharding.placed(written).collect()]
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter(g[:3] for g in got) == want
    slots = defaultdict(list)
    for g in got:
        slots[g[4]].append(g[5])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = [tuple(r) for r in sharding.placed(sharding.write_shards(docs.repartition(7), shards=8, bucket_bytes=4000)).collect()]
    assert Counter(again) == Counter(got)
    assert set(docs.columns) < set(written.columns)
    assert sharding.write_shards(none).count() == 0
    order = [g[0] for g in sorted(got, key=lambda g: g[4:6])]
    assert order != sorted(order, key=lambda x: (x is None, x))


def test_fisher_yates():
    assert sorted(sharding.fisher_yates(50, [1, 2])) == list(range(50)) and list(sharding.fisher_yates(50, [1, 2])) == list(sharding.fisher_yates(50, [1, 2]))
    assert len(sharding.fisher_yates(0, [1])) == 0 and list(sharding.fisher_yates(1, [1])) == [0]
    seen = Counter(tuple(sharding.fisher_yates(3, [s])) for s in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_encoder(vocabulary, rows):
    """Ids are those of a plain ``Tokenizer.from_file``, long runs of white space and added tokens included."""
    from tokenizers import Tokenizer

    e, plain = packing.Encoder(vocabulary), Tokenizer.from_file(vocabulary)
    texts = ["", " ", "a  b", "it's we'll  ", "a\t\n b", "<|endoftext|> x", "a <|endoftext|><|endoftext|>  \n b<|endoftext|>", "naïve ßtraße 12345 ###", " x", "日本 語"] + [t for _, t, *_ in rows[:40] if t]
    r = random.Random(9)
    for space in ("\n", " ", "\t ", "　", "\x1c"):
        for n in (499, 500, 501, 5000):
            run = "".join(r.choice(space) for _ in range(n))
            texts += [run, "a" + run, run + "b", "a." + run + "b " + run + "\nc" + run, run + "<|endoftext|>" + run + "'s", "x" + run + "\x85y"]
    texts += [" " * 3_000_000, "a" + "\n" * 1_000_000 + "b"]
    assert e.fast is not None
    for t in texts:
        assert e.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:50]


def test_packing(docs, rows, vocabulary, none):
    from tokenizers import Tokenizer

    plain, want = Tokenizer.from_file(vocabulary), Counter()
    for i, t, *_ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        n, end, at, piece = len(ids) // 4, 0, 0, 0
        for end in [*range((n - 1) % 64 + 1, n + 1, 64)]:
            want[(i, piece, at, end - at, zlib.crc32(ids[4 * at : 4 * end]))] += 1
            at, piece = end, piece + 1
    got = [tuple(r) for r in packing.pack_documents(docs, vocabulary, 64).collect()]
    assert Counter(g[:5] for g in got) == want
    bins = defaultdict(list)
    for g in got:
        bins[g[5]].append((g[6], g[3]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(g[3] for g in got) // 64) * 1.02 + 1
    assert packing.pack_documents(none, vocabulary).count() == 0


def test_solve():
    r = random.Random(5)
    for capacity, shape in ((100, lambda: r.randint(1, 100)), (100, lambda: r.choice([34, 35, 51])), (100, lambda: r.randint(20, 60)), (2048, lambda: min(2047, int(r.expovariate(1 / 300)) + 1)), (10, lambda: 6)):
        h = Counter(shape() for _ in range(3000))
        plan = packing.solve(dict(h), capacity, rounds=60)
        used = Counter()
        for content, copies, _ in plan:
            assert sum(x * k for x, k in content) <= capacity
            for x, k in content:
                used[x] += k * copies
        assert used == h
        assert sum(c for _, c, by in plan if by) > 0.5 * sum(c for _, c, _ in plan)
        assert sum(c for _, c, _ in plan) <= 1.003 * sum(c for _, c in packing.best_fit(dict(h), capacity)) + 1
    assert packing.solve({}) == []


def test_knapsack():
    r = random.Random(2)
    for _ in range(20):
        n, cap = r.randint(1, 5), r.randint(5, 20)
        w, v, m = (np.array([r.randint(1, 7) for _ in range(n)]) for _ in range(3))
        got = packing.knapsack(w, v.astype(float), m, cap)
        assert (got <= m).all() and (got * w).sum() <= cap
        best = max(sum(a * b for a, b in zip(k, v)) for k in itertools.product(*(range(x + 1) for x in m)) if sum(a * b for a, b in zip(k, w)) <= cap)
        assert (got * v).sum() == best




def plain_chunks(lines):
    """Chunks of lines by the rolling hash, from the seeded hash of each line as Spark computes it."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    seed = 42
    hashes = [signed(xxhash.xxh64_intdigest(x.encode(), seed)) for x in lines]
    out, here = [], []
    for i, x in enumerate(lines):
        if i >= line_dedup.WINDOW:
            h = seed
            for k in range(line_dedup.WINDOW, 0, -1):
                h = xxhash.xxh64_intdigest(struct.pack("<q", hashes[i - k]), h & (1 << 64) - 1)
            if signed(h) % line_dedup.EVERY == 0:
                out.append(here)
                here = []
        if len(here) == line_dedup.LONGEST:
            out.append(here)
            here = []
        here.append(x)
    return [*out, here]


def test_line_dedup(spark, docs, rows, none):
    """Chunks alone, against chunks that are cut in plain Python."""
    got = [(r["doc_id"], r["text"], r["removed_lines"]) for r in line_dedup.line_dedup(docs, edges=False).collect()]
    assert len(got) == len(rows)
    firsts, want = {}, Counter()
    key = lambda r: (r[0] is None, r[0] or 0)
    cut = [(i, t, plain_chunks((t or "").split("\n"))) for i, t, *_ in sorted(rows, key=key)]
    many = lambda c: len(c) > 1 and "".join(c).strip()
    for i, t, chunks in cut:
        at = 0
        for c in chunks:
            if many(c):
                firsts.setdefault("\n".join(c), (i, t, at))
            at += len(c)
    for i, t, chunks in cut:
        at, left = 0, []
        for c in chunks:
            if not many(c) or firsts["\n".join(c)] == (i, t, at):
                left += c
            at += len(c)
        want[(i, None if t is None else "\n".join(left), at - len(left))] += 1
    # among rows without an id the order is by a hash, so which of them keeps a chunk is left open
    known = lambda c: Counter({k: v for k, v in c.items() if k[0] is not None})
    assert known(Counter(got)) == known(want)
    assert sum(x[2] for x in got) > 50
    assert line_dedup.line_dedup(none).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, done = share * sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(done.values())
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not full:
            return done | {s: level * w[s] for s in open_}
        done |= {s: cap * sizes[s] for s in full}
        open_ -= full
    return done


@pytest.mark.parametrize("bins", [4096, 3])
def test_mixing(docs, rows, none, bins):
    mix = mixing.Mix(bins=bins)
    got = mixing.shares(docs, mix).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for i, t, _, s, _ in rows:
        sizes[s] += count(t)
    targets = brute_targets(sizes)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, count(t)) for i, t, _, s, _ in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6 * (1 + targets[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s]
    again = mixing.shares(docs.repartition(5), mix).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    copies = Counter(r["doc_id"] for r in mixing.mixed(docs, mix).collect())
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert copies == +want
    assert mixing.shares(none, mix).count() == 0 and mixing.mixed(none, mix).count() == 0


def test_mixing_prefers_long_documents(spark):
    rows = [(i, "w " * (5 if i % 2 else 50), "en", f"s{i % 40 // 20}", 0) for i in range(4000)]
    mix = mixing.Mix(weights=(5, 1), share=0.6, tilt=500)
    got = mixing.shares(spark.createDataFrame(rows, SCHEMA), mix).where("source = 's0'").groupBy("size").agg(F.avg("copies").alias("c")).collect()
    rate = {r["size"]: r["c"] for r in got}
    assert rate[50] > rate[5]


PAGES = [
    (1, "https://A.example.net/en/x?q=1#t", None), (2, "http://b.net/de/", ""), (3, "https://example.com/de/1", "<p>"), (4, "https://x.org/fr/a", ""), (5, "nothing", "x"), (6, None, None),
    (7, "https://free.site/a", '<link href="https://bad.net/q" rel=\'canonical\'>'), (8, "https://free.site/b", '<meta http-equiv="Refresh" content="0; url=/a">'),
    (9, "https://ok.org/fr/z", '<link rel="canonical" href="//free.site/a">'), (10, "https://other.site/", '<link rel="canonical" href="https://other.site/home">'), (11, "http://free.site/b#frag", ""),
    (12, "https://notnet/x", ""), (13, "https://sub.example.com/de/", ""), (13, "https://sub.example.com/de/", ""), (14, "https://EXAMPLE.NET/enough", ""), (15, "https://example.net/en/", ""), (16, "ftp://h.net?x/y", ""),
]


def test_url_filter(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("verdict", F.lit("clash")).withColumn("alias", F.lit("clash"))
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df).collect())
    want = [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "b.net", "/de/", "net/", "block"), (3, "example.com", "/de/1", "example.com/de/", "block"), (4, "x.org", "/fr/a", "org/fr/", "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "free.site", "/a", None, "block"), (8, "free.site", "/b", None, "block"), (9, "ok.org", "/fr/z", "org/fr/", "allow"), (10, "other.site", "/", None, "allow"),
        (11, "free.site", "/b", None, "block"), (12, "notnet", "/x", None, "allow"), (13, "sub.example.com", "/de/", "example.com/de/", "block"), (13, "sub.example.com", "/de/", "example.com/de/", "block"),
        (14, "example.net", "/enough", "net/", "block"), (15, "example.net", "/en/", "example.net/en/", "allow"), (16, "h.net", "", None, "allow"),
    ]
    assert got == Counter(want)
    assert url_filter.url_filter(df.limit(0)).count() == 0
    table = spark.createDataFrame([tuple(r) for r in url_filter.RULES], "verdict string, host string, path string")
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df, table).collect()) == Counter(want)
    more = spark.createDataFrame([("https://other.site/", "https://bad.net/")], "url string, target string")
    assert {r["page_id"] for r in url_filter.url_filter(df, edges=more).where("verdict = 'block'").collect()} >= {10}


def test_url_filter_resolves_links(spark):
    """Targets with character references, dot segments, queries, long urls; each leads to a page of a blocked host."""
    link = '<link rel="canonical" href="{}">'
    bad = "https://bad.net/"
    pages = [
        (1, "https://a.site/x", link.format("https://b.site/q?x=1&amp;y=2")), (2, "https://b.site/q?x=1&y=2", link.format(bad)),
        (3, "https://c.site/p/q/r", link.format("../s")), (4, "https://c.site/p/s", link.format(bad)), (5, "https://c.site/p/./x/../s", ""),
        (6, "https://d.site/list", link.format("?page=2")), (7, "https://d.site/list?page=2", link.format(bad)), (8, "https://d.site/?page=2", ""),
        (9, "https://e.site", link.format("&#x2F;&#47;f.site&#x2f;home")), (10, "https://f.site/home", link.format(bad)), (11, "https://e.site/", ""),
        (12, "https://g.site/a", link.format("mailto:x@bad.net")), (13, "https://h.site/a", link.format("/go?to=https://bad.net/")), (14, "https://i.site/" + "y" * 100_000, link.format(bad)),
        (15, "https://i.site/" + "y" * 100_000 + "z", "<p>" * 100_000), (16, "https://j.site/a/b", link.format("../../../s#x")), (17, "https://j.site/s", link.format(bad)),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"] for r in url_filter.url_filter(df).where("verdict = 'block'").collect()}
    assert got == {1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 14, 16, 17}


TEXTS = [
    ("Released under the MIT License.", "MIT"), ("Intro here.\nLicensed under the Apache License, Version 2.0.\nMore", "Apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("// SPDX-License-Identifier: BSD-3-Clause\ncode", "bsd-3-clause"), ("All rights reserved.", "NONE"), ("nothing at all", "NONE"), (None, "NONE"), ("", "NONE"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files. The above copyright notice and this permission notice shall be included in all copies. The software is provided \"as is\", without warranty of any kind.", "MIT"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted: Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice. Neither the name of X nor the names of its contributors may be used.", "BSD-3-Clause"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted. Licensed under CC0.", "BSD-2-Clause AND CC0-1.0"), ("You may obtain a copy of the License at x. ", "NONE"),
    ("word " * 200_000 + ". Released under the MIT License.", "MIT"),
]


def test_license_scan(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string").withColumn("sentence_ids", F.lit("clash")).withColumn("matched", F.lit(1))
    got = {r["doc_id"]: r["licenses"] for r in license_scan.license_scan(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(TEXTS)}
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_media_forms(docs, rows):
    """Stored form, keyframe ranges and feature against the file's layout worked out by hand: every 16 entries of 64 bytes from the end of the header."""
    for r in media.digests(media.encode_texts(docs)).collect():
        payload, media_bytes = r["payload_bytes"], r["media_bytes"]
        first, entries = media_bytes - payload, payload // 64
        starts = range(0, entries, 16)
        assert [(k["begin"], k["end"]) for k in r["keyframe_ranges"]] == [(first + 64 * e, first + 64 * e + 64) for e in starts]
        last = first + 64 * starts[-1] + 64
        assert r["feature"] == f"soun/raw {payload / 8000:.6f}s {entries} samples {len(starts)} keyframes {first}-{last}"
    texts = {t or "" for _, t, *_ in rows}
    stored = {hashlib.sha256(media.build(media.padded(t.encode()))).hexdigest() for t in texts}
    assert {r["media_sha256"] for r in media.digests(media.encode_texts(docs)).collect()} == stored


def test_media_round_trip(docs, rows, none):
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.digests(media.encode_texts(docs)).collect())
    want = Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want[(i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert got == want
    assert media.digests(media.encode_texts(none)).count() == 0


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_media_columns(spark):
    whole = media.build(bytes(range(64)) * 40)
    # two tracks' tables by hand: sizes one by one, chunks of two, 64-bit offsets, a sync sample list, a box to the end of the file
    stbl = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1) + box(b"avc1", bytes(8))) + box(b"stts", struct.pack(">IIII", 0, 1, 5, 100)) + box(b"stsz", struct.pack(">III5I", 0, 0, 5, 10, 20, 30, 40, 50))
               + box(b"stsc", struct.pack(">II6I", 0, 2, 1, 2, 1, 3, 1, 1)) + box(b"co64", struct.pack(">II3Q", 0, 3, 1000, 2000, 3000)) + box(b"stss", struct.pack(">II2I", 0, 2, 1, 4)))
    mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, 100, 400, 0, 0)) + box(b"hdlr", bytes(8) + b"vide") + box(b"minf", stbl))
    video = box(b"ftyp", b"mp42" + bytes(4)) + box(b"moov", box(b"trak", mdia)) + struct.pack(">I4s", 0, b"mdat") + bytes(10)
    rows = [(1, whole), (2, video), (3, None), (4, b""), (5, b"not media at all"), (6, whole[:200]), (7, struct.pack(">I4s", 4, b"moov"))]
    sound = box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1) + box(b"raw ", bytes(8)))))))
    rows += [(8, box(b"moov", sound + box(b"trak", mdia))), (9, box(b"moov", box(b"trak", mdia)) + box(b"moof", box(b"traf", box(b"trun", bytes(8)))))]
    df = spark.createDataFrame(rows, "doc_id long, content binary").withColumn("media", F.lit("clash"))
    media_ = {r["doc_id"]: r["media"] for r in media.media_columns(df).collect()}
    got = {i: (m["tracks"] or [None])[0] for i, m in media_.items()}
    assert (got[1]["codec"], got[1]["samples"], media_[1]["error"]) == ("raw ", 40, None) and abs(got[1]["duration"] - 2560 / 8000) < 1e-9
    assert (got[2]["codec"], got[2]["handler"], got[2]["duration"]) == ("avc1", "vide", 5.0)
    assert [(k["begin"], k["end"]) for k in got[2]["keyframes"]] == [(1000, 1010), (2030, 2070)]
    assert [t["codec"] for t in media_[8]["tracks"]] == ["raw ", "avc1"] and "fragments" in media_[9]["error"]
    assert all(media_[i]["error"] for i in (3, 4, 5, 7)) and (got[6] is None or got[6]["codec"] is None)


def test_quality(spark, none):
    r = random.Random(3)
    words = "the of and to in a is that for it as was with be by on not he his but at are this have from".split() + ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 9))) for _ in range(400)]
    prose = lambda: " ".join(" ".join(r.choice(words) for _ in range(r.randint(6, 14))).capitalize() + "." for _ in range(r.randint(4, 25)))
    junk = [lambda: " | ".join(r.choice(words) for _ in range(80)), lambda: " ".join(r.choice(words).upper() + "!!" for _ in range(80)), lambda: " ".join(r.choice(words) + r.choice(["$$$", "%%%", "###"]) for _ in range(80)),
            lambda: " ".join([r.choice(words)] * 60 + [r.choice(words)] * 60)]
    rows = [(i, junk[i % 4]() if i % 6 == 0 else prose(), "en", "s", 0, int(i % 6 != 0)) for i in range(1500)]
    rows += [(2000, None, "en", "s", 0, 1), (2001, "", "en", "s", 0, 1), (2002, "Short one.", "en", "s", 0, 1), (2003, (prose() + "\n") * 500, "en", "s", 0, 1), (1, rows[1][1], "en", "s", 0, 1), (None, rows[1][1], "en", "s", 0, 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", truth int").withColumn("votes", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("keep", F.lit("clash"))
    got = quality.classify(df).select("truth", "keep", "score", "text").collect()
    assert len(got) == len(rows)
    good, bad = [g["keep"] for g in got if g["truth"]], [g["keep"] for g in got if not g["truth"]]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert len({g["score"] for g in got if g["text"] == rows[1][1]}) == 1
    assert quality.classify(none).count() == 0


def test_quality_votes_by_hand():
    texts = pa.array(["", None, "Und " * 40, "a | b | c | d | e | f | g | h | i | j", "HELLO!! WORLD!! NOW!! HERE!! THERE!! YES!! NO!! GO!!", "ab ab cd", "same sameé sameé x"])
    votes = {n: quality.votes(texts)[:, i].tolist() for i, n in enumerate(quality.LABELLERS)}
    assert votes["repetition"] == [0, 0, -1, 0, 0, 0, 0] and votes["tables"][3] == -1 and votes["shouting"][4] == -1 and votes["capitals"][4] == -1
    raw, at = quality._bytes(texts)
    words, (same, _) = quality._repeats(raw, at)
    assert words.tolist() == [0, 0, 40, 19, 8, 3, 4] and same.tolist() == [0, 0, 39, 0, 0, 1, 1]


def test_quality_estimate_recovers_accuracies():
    r = np.random.default_rng(4)
    truth, accuracy = r.random(20000) < 0.8, np.array([0.95, 0.85, 0.7, 0.9])
    votes = np.where(r.random((20000, 4)) < accuracy, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None]) * (r.random((20000, 4)) < 0.8)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, found, prior = quality.estimate(patterns, counts.astype(float))
    assert np.abs(found - accuracy).max() < 0.03 and abs(prior - 0.8) < 0.03
    assert ((good[inverse.ravel()] > 0.5) == truth).mean() > 0.9


def test_files_that_claim_more_than_they_hold():
    """Counts and offsets of a broken file can't make more samples than it has bytes."""
    whole = media.build(media.padded(b"x" * 5000))
    short = media.inspect(whole[:-600])
    assert "beyond" in short["error"] and short["tracks"][0]["samples"] == media.inspect(whole)["tracks"][0]["samples"]
    assert media.inspect(whole)["error"] is None and media.read_back(whole) == media.padded(b"x" * 5000)
    at = whole.index(b"stsz")
    claims = whole[: at + 12] + struct.pack(">I", 0xFFFFFFFF) + whole[at + 16 :]
    got = media.inspect(claims)
    assert got["error"] == "more samples than bytes" and got["tracks"][0]["samples"] <= len(claims)
