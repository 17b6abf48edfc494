"""SimHash linking, components and near duplicates against brute force."""

import random

import numpy as np
import pandas as pd
import xxhash
from corpusmith.llm import resemblance, simhash
from corpusmith.llm.components import components

from .conftest import DOCS, make_docs


def plain_fingerprint(text, width=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()]
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    votes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def groups(n, linked):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in linked:
        up[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_fingerprint_matches_its_definition():
    for _, text, *_ in make_docs(30):
        if text is not None and len(text) < 10_000:
            assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(" \t\x0b\x0c") == 0
    assert simhash.fingerprint("One") == xxhash.xxh64_intdigest(b"one", 42)


def test_spark_hash_is_the_same_function(spark):
    got = spark.sql("SELECT xxhash64('a b c') AS h").first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_bucket_links_keep_every_link_and_no_other():
    r = random.Random(5)
    for trial in range(40):
        fps = {r.getrandbits(64) for _ in range(3)}
        base = list(fps)
        for _ in range(90):
            x = r.choice(list(fps) if trial % 2 else base)
            for b in r.sample(list(r.choice([range(64), range(32), range(32, 64), range(5)])), r.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
        fps = sorted(fps)
        rows = sorted((key, x) for x in fps for bit in [0, *simhash.ONE] for key in ((x & simhash._LOW) ^ bit, ((x >> 32) ^ bit) | 1 << 32))
        keys, values = np.array([k for k, _ in rows]), np.array([x for _, x in rows], np.uint64).view(np.int64)
        third = len(keys) // 3
        frames = [pd.DataFrame({"key": keys[a:b], "fp": values[a:b]}) for a, b in ((0, third), (third, third), (third, len(keys)))]
        edges = pd.concat(simhash._linker(iter(frames)))
        place = {int(np.array([x], np.uint64).view(np.int64)[0]): i for i, x in enumerate(fps)}
        found = [(place[u], place[v]) for u, v in zip(edges.u, edges.v, strict=True)]
        want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
        assert all((fps[i] ^ fps[j]).bit_count() <= 3 for i, j in found)
        a, b = groups(len(fps), found), groups(len(fps), want)
        assert len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_a_bucket_over_many_frames():
    """Frames of any size give the links of one frame."""
    r = np.random.default_rng(2)
    low = np.sort(r.integers(0, 3, 400)).astype(np.int64)
    fps = (r.integers(0, 64, 400).astype(np.int64) << 32) | low
    whole = pd.DataFrame({"key": low, "fp": fps})
    links = lambda frames: sorted((min(a), max(a)) for f in simhash._linker(iter(frames)) for a in f.itertuples(index=False))
    want = links([whole])
    for size in (1, 7, 150):
        assert links([whole[i : i + size] for i in range(0, 400, size)]) == want and want


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_copies(seed=3):
    r = random.Random(seed)
    rows = make_docs(30, seed)
    base = [w for _, t, *_ in rows[:8] for w in t.split()][:300]
    for i in range(40):
        words = list(base)
        words[r.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words), "en", "src0", None))
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = [r for r in near_copies() if r[0] is not None]
    got = sorted((r.doc_id, r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    fps = [simhash.fingerprint(t or "") for _, t, *_ in rows]
    group = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for g, row in zip(group, rows, strict=True):
        least[g] = min(least.get(g, row[0]), row[0])
    assert got == sorted((row[0], fp, least[g]) for row, fp, g in zip(rows, fps, group, strict=True))


def test_keep_one(spark, docs, no_docs, wide_docs):
    found = simhash.near_duplicates(docs).collect()
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({r.component for r in found if r.component is not None and r.doc_id is not None})
    assert sum(r.doc_id is None for r in kept) == 1
    assert simhash.keep_one(no_docs).count() == 0
    assert simhash.keep_one(wide_docs).columns == wide_docs.columns


def jaccard(a, b, width=5):
    a, b = ({" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if (w := t.lower().split()) else set() for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_pipeline_links_copies_of_similarity_080_to_095(spark):
    import corpus_pipeline

    r = random.Random(12)
    rows, vocabulary = [], [f"w{i}" for i in range(4000)]
    for i in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 400))]
        rows.append((1000 + i, " ".join(base), "en", "s", 1))
        copy = list(base)
        for at in r.sample(range(len(base)), max(1, len(base) // r.choice([40, 60, 90]))):
            copy[at] = "changed"
        rows.append((i, " ".join(copy), "en", "s", 1))
    base = [r.choice(vocabulary) for _ in range(120)]
    for i in range(40):  # a chain: neighbours alike, ends not
        base[3 * i] = f"c{i}"
        rows.append((2000 + i, " ".join(base), "en", "s", 1))
    rows += [(3000, None, None, "s", 0), (3001, " ", None, "s", 1), (3002, "Two Words", "en", "s", 9), (3003, "two words", "en", "s", 9), (None, "two words", "en", "s", 9)]
    texts = [(d, t or "") for d, t, *_ in rows if d is not None]
    scores = {(i, j): jaccard(texts[i][1], texts[j][1]) for i in range(len(texts)) for j in range(i)}
    links = [pair for pair, s in scores.items() if s >= 0.8]
    assert sum(0.8 <= scores[p] <= 0.95 and (simhash.fingerprint(texts[p[0]][1], 5) ^ simhash.fingerprint(texts[p[1]][1], 5)).bit_count() > 3 for p in links) > 20
    assert any(0.7 < s < 0.8 for s in scores.values())
    group, least = groups(len(texts), links), {}
    for g, (d, _) in zip(group, texts, strict=True):
        least[g] = min(least.get(g, d), d)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted((r.doc_id, r.component) for r in resemblance.near_duplicates(df.filter("doc_id IS NOT NULL")).collect()) == sorted((d, least[g]) for g, (d, _) in zip(group, texts, strict=True))
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(d for d in kept if d is not None) == sorted(least.values()) and kept.count(None) == 1
