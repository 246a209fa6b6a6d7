"""Exact, SimHash, vector and phrase deduplication against brute force over small tables."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from exposight.llm import components, embedding_dedup, exact_dedup, phrase_dedup, simhash


def groups(n, linked):
    """Smallest reachable index of each of ``n`` nodes."""
    least = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


# --- exact ---------------------------------------------------------------------


@pytest.mark.parametrize("digest", [exact_dedup.content_hash, lambda t: F.substring(F.md5(t), 1, 1)])
def test_exact_classes(documents, clashing, texts, digest):
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, None), (None, "alone"), (903, "é"), (904, "é")]
    rows += [(905, "twice"), (905, "twice")]
    found = exact_dedup.classes(clashing(documents(rows)), keep="largest", digest=digest).collect()
    assert len(found) == len(rows)
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", []).append(i)
    want = sorted(
        str((i, max((x for x in by_text[t or ""] if x is not None), default=None), len(by_text[t or ""]),
             i == max((x for x in by_text[t or ""] if x is not None), default=None), hashlib.sha256((t or "").encode()).hexdigest()))
        for i, t in rows
    )
    assert sorted(str(tuple(r)) for r in found) == want


def test_exact_survivors(documents, clashing):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "a"), (None, "c")]
    for keep, ids in (("largest", [2, 4, 5, None]), ("smallest", [1, 3, 5, None])):
        df = clashing(documents(rows))
        found = exact_dedup.survivors(df, keep=keep)
        assert found.columns == df.columns
        kept = found.collect()
        assert sorted((r["doc_id"] for r in kept), key=str) == sorted(ids, key=str)
        assert {r["doc_id"]: r["text"] for r in kept}[4 if keep == "largest" else 3] == ("" if keep == "largest" else None)


def test_exact_empty(documents):
    assert exact_dedup.classes(documents([])).count() == 0
    assert exact_dedup.survivors(documents([])).count() == 0


# --- components ----------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 120
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(90)] + [(i, i + 1) for i in range(40, 75)] + [(0, 0)]
    links += [(5, i) for i in range(100, 120)]
    rng.shuffle(links)
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = groups(n, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: want[x] for x in touched}


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([(1, 1), (None, 2)], "a bigint, b bigint")).count() == 0


# --- SimHash -------------------------------------------------------------------


def slow_fingerprint(text, shingle=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    runs = [words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(documents, clashing, texts):
    rows = [(10 * i, t) for i, t in enumerate(texts)] + [(7, None), (8, " \n"), (9, "One two"), (6, "one TWO"), (6, "one TWO")]
    rows += [(2000 + i, texts[40] + " tail" * i) for i in range(6)]
    for tree_rows in (20_000, 4):
        found = simhash.near_duplicates(clashing(documents(rows)), shingle=3, radius=3, tree_rows=tree_rows).collect()
        fps = [slow_fingerprint(t) for _, t in rows]
        links = [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3]
        least = groups(len(rows), links)
        members = {}
        for i, g in enumerate(least):
            members.setdefault(g, []).append(rows[i][0])
        want = sorted((rows[i][0], fps[i], min(members[g])) for i, g in enumerate(least))
        assert sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == want
        assert len(set(least)) < len(rows)


@pytest.mark.parametrize(("radius", "blocks"), [(3, 5), (3, 4), (0, 1), (6, 8)])
def test_links_within_a_distance(spark, radius, blocks):
    rng = random.Random(radius)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for _ in range(4):
            x = v
            for b in rng.sample(range(64), rng.randint(0, 8)):
                x ^= 1 << b
            values.append(x)
    values = sorted(set(values) | {0, (1 << 64) - 1})
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    for tree_rows in (20_000, 3):
        forest = simhash.link_forest(fps, radius, blocks, tree_rows).collect()
        place = {v: i for i, v in enumerate(values)}
        got = groups(len(values), [(place[r["a"] % (1 << 64)], place[r["b"] % (1 << 64)]) for r in forest])
        links = [(a, b) for a in range(len(values)) for b in range(a) if bin(values[a] ^ values[b]).count("1") <= radius]
        assert got == groups(len(values), links)


def test_tree_follows_edges_within_the_radius():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 16, 500, dtype=np.uint64)
    shard = np.sort(rng.integers(0, 5, 500))
    tree = simhash.Trees(shard, values)
    queries = np.flatnonzero(shard == 2)
    seen = set()
    for asked, node in tree.search(values[queries], np.full(len(queries), tree.roots[2]), 3):
        seen |= {(int(queries[a]), int(n)) for a, n in zip(asked, node)}
    want = {(a, b) for a in queries for b in queries if bin(int(values[a] ^ values[b])).count("1") <= 3}
    assert seen == want


def test_simhash_representatives(documents, clashing, texts):
    df = clashing(documents([(5, texts[30]), (3, texts[30]), (4, texts[31]), (None, texts[30]), (8, None), (9, "")]))
    found = simhash.representatives(df)
    assert found.columns == df.columns
    assert sorted((r["doc_id"] for r in found.collect()), key=str) == [3, 4, 8, None]
    assert simhash.representatives(documents([])).count() == 0


# --- vectors -------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, component_id string"


def vectors(seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(90):
        if i % 3 or i < 9:
            v = [rng.gauss(0, 1) for _ in range(16)]
        else:
            v = [x + rng.gauss(0, 0.25) for x in rows[i - 3 if i % 6 else 2][1]]
        rows.append((i, v, i % 2 if i % 10 else 0))
    rows += [(200, rows[5][1], rows[5][2]), (201, rows[5][1], rows[5][2]), (202, [2 * x for x in rows[5][1]], rows[5][2])]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [1.0, None] * 8, 1), (303, [float("nan")] * 16, 1), (304, [float("inf")] * 16, 1)]
    rows += [(305, [], 1), (306, rows[4][1], None), (307, [1.0, 2.0], 1), (308, [1.0, 2.1], 1), (200, rows[5][1], rows[5][2])]
    return [(*r, "x") for r in rows]


@pytest.mark.parametrize("tile", [1024, 7])
def test_vectors_against_all_pairs(spark, tile):
    rows = vectors()
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), 0.93, tile=tile).collect()

    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [np.float32(v).astype(float) if usable(v, lab) else None for _, v, lab, _ in rows]

    def linked(a, b):
        if unit[a] is None or unit[b] is None or rows[a][2] != rows[b][2] or len(unit[a]) != len(unit[b]):
            return False
        return unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= 0.93

    n = len(rows)
    links = [(a, b) for a in range(n) for b in range(a) if linked(a, b)]
    least = groups(n, links)
    members = {}
    for i, g in enumerate(least):
        members.setdefault(g, []).append(rows[i][0])
    count = [0] * n
    for a, b in links:
        count[a] += 1
        count[b] += 1
    want = sorted((rows[i][0], count[i], min(members[g]), rows[i][0] == min(members[g])) for i, g in enumerate(least))
    assert sorted(map(tuple, found)) == want
    assert max(count) > 3


def test_quantisation_bound_holds():
    rng = np.random.default_rng(2)
    for dims in (3, 64, 1500):
        x = rng.normal(size=(40, dims)) * rng.exponential(size=(40, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q, s, e = embedding_dedup.quantised(x)
        about = embedding_dedup.int8_products(q, q) * s[:, None] * s
        assert (embedding_dedup.int8_products(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()
        assert (np.abs(about - x @ x.T) <= e[:, None] + (1 + e[:, None]) * e + embedding_dedup.SLACK).all()


def test_vectors_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


# --- phrases -------------------------------------------------------------------


def slow_repeats(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    found = []
    for i, w in words:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        found.append((i, len(w), keep.count(False), b" ".join(x for x, y in zip(w, keep) if y).decode()))
    return sorted(found, key=str)


@pytest.mark.parametrize("part_rows", [1000, 2])
@pytest.mark.parametrize("window", [50, 12])
def test_phrases_against_all_windows(documents, clashing, texts, window, part_rows):
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(500, None), (501, "  "), (None, texts[5]), (502, texts[7].replace(" ", "\n\t"))]
    rows += [(503, texts[5] + " " + texts[5]), (504, " ".join(["same"] * 130)), (505, " ".join(["same"] * 90)), (505, " ".join(["same"] * 90))]
    found = phrase_dedup.remove_repeats(clashing(documents(rows)), window=window, gram=4, part_rows=part_rows).collect()
    assert sorted(map(tuple, found), key=str) == slow_repeats(rows, window)
    assert sum(r["n_removed"] > 0 for r in found) > 10


def test_least_places():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 50, 300).astype(np.uint64)
    for length in (1, 2, 3, 8, 43):
        want = [i + int(np.argmin(values[i : i + length])) for i in range(len(values) - length + 1)]
        assert phrase_dedup.least_places(values, length).tolist() == want


def test_phrases_empty(documents):
    assert phrase_dedup.remove_repeats(documents([])).count() == 0
    assert phrase_dedup.remove_repeats(documents([(1, "too short"), (2, "too short")])).where("n_removed > 0").count() == 0
