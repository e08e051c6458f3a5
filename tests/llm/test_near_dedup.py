"""Near dedup by shingles against brute-force Jaccard, and the pipeline's stage on near copies."""

import random

import corpus_pipeline
import numpy as np
from leadloom.llm import near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(texts, least=0.8):
    sets = {i: shingles(t) for i, t in texts}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and jaccard(sets[i], sets[j]) >= least:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in sets}


def near_copies():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for base in range(25):
        words = [r.choice(vocabulary) for _ in range(r.choice((60, 200, 500)))]
        texts.append(" ".join(words))
        for copy in range(5):  # each copy changes more places: similarities on both sides of 0.8
            for _ in range(max(1, len(words) // 100 + (copy == 4) * len(words) // 20)):
                words[r.randrange(len(words))] = f"n{base}"
            texts.append(" ".join(words))
    texts += [None, "", " \n", "a b", "A  b", "a b c"]
    # a swarm around one text, more than its pairs should cost
    swarm = [r.choice(vocabulary) for _ in range(150)]
    for i in range(90):
        words = list(swarm)
        words[i], words[149 - i // 2] = f"s{i}", f"t{i}"
        texts.append(" ".join(words))
    return list(enumerate(texts))


def test_groups_are_those_of_brute_force(spark):
    texts = near_copies()
    want = components(texts)
    sets = {i: shingles(t) for i, t in texts}
    between = sum(0.8 <= jaccard(sets[i], sets[i + 1]) < 0.95 for i in range(149))
    assert between > 20 and len(set(want.values())) > 40
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(df).collect()} == want
    assert near_dedup.near_groups(df.limit(0)).count() == 0


def test_stage_keeps_one_of_near_copies(spark):
    texts = near_copies()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect())
    assert got == sorted(set(components(texts).values()))


def test_simhash_comes_first(spark):
    texts = near_copies()
    rows = near_dedup._arrow(spark.createDataFrame(texts, "doc_id long, text string"), "text", "doc_id", 5, True).collect()
    by = {r["class"]: r["fp"] for r in rows}
    assert len({r["class"] for r in rows}) == len(by) and {r["fp"] for r in rows if r["n"] == 0} == {0}
    got = {tuple(x) for x in near_dedup.simhash_pairs(spark.createDataFrame(rows)).collect()}
    assert got and all(a < b and ((by[a] ^ by[b]) & (1 << 64) - 1).bit_count() <= 2 for a, b in got)
    # each two fingerprints within two bits are joined, and so is each class with another one of its fingerprint
    heads = {fp: min(c for c in by if by[c] == fp) for fp in by.values()}
    want = {(heads[fp], c) for c, fp in by.items()} | {tuple(sorted((heads[f], heads[g]))) for f in heads for g in heads if f < g and ((f ^ g) & (1 << 64) - 1).bit_count() <= 2}
    assert got == {(a, b) for a, b in want if a != b}


def test_a_swarm_just_under_the_threshold_costs_few_pairs(spark, monkeypatch):
    r = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(300):
        words = list(base)
        for at in r.sample(range(150), 2 + (i % 3 > 0)):
            words[at] = f"x{r.randrange(10**9)}"
        texts.append((i, " ".join(words)))
    want = components(texts)
    sets = {i: shingles(t) for i, t in texts}
    under = sum(0.6 <= jaccard(sets[i], sets[j]) < 0.8 for i in sets for j in sets if i < j)
    assert under > 40_000 and 10 < len(set(want.values())) < 290
    made, write = [], near_dedup.scratch
    monkeypatch.setattr(near_dedup, "scratch", lambda df, name: (out := write(df, name), made.append(out.count()) if name == "pairs" else None)[0])
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {g["doc_id"]: g["component_id"] for g in near_dedup.near_groups(df).collect()} == want
    assert sum(made) < 20 * len(texts)


def test_parities_bound_the_difference():
    r = random.Random(8)
    for n in (0, 1, 30, 700, 5000):
        a = {r.getrandbits(64) for _ in range(n)}
        b = set(r.sample(sorted(a), n * 3 // 4)) | {r.getrandbits(64) for _ in range(n // 8 + 1)}
        x, y = (near_dedup.parities(np.array(sorted(s), np.uint64)) for s in (a, b))
        apart = sum((int(p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y, strict=True))
        assert len(x) * 64 == near_dedup.PARITIES and apart <= len(a ^ b)
        assert n != 700 or apart > 0.8 * len(a ^ b)
