import random
import re
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from dripline.llm import jaccard_join
from dripline.llm.components import components
from dripline.llm.jaccard_join import keep_one, least_shared, link_components, most_shared
from dripline.llm.support import store
from dripline.session import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(own) < size:
        return frozenset([tuple(own)]) if own else frozenset()
    return frozenset(tuple(own[i : i + size]) for i in range(len(own) - size + 1))


def brute(texts, percent=75):
    """(sizes, smallest index reachable) of each text, all pairs compared."""
    sets = [shingles(x) for x in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [len(x) for x in sets], [root(i) for i in range(len(texts))]


def edited(generator, own, edits):
    own = list(own)
    for _ in range(edits):
        kind, at = generator.random(), generator.randrange(len(own))
        if kind < 0.5:
            own[at] = f"e{generator.randrange(10**6)}"
        elif kind < 0.75:
            del own[at]
        else:
            own.insert(at, f"i{generator.randrange(10**6)}")
    return own


def corpus(seed, n=150):
    """Chains of near copies around the threshold, shared passages, short and equal texts."""
    generator = random.Random(seed)
    fresh = lambda k: [f"w{generator.randrange(10**6)}" for _ in range(k)]
    passages = [fresh(generator.randint(8, 30)) for _ in range(4)]
    texts = [fresh(generator.randint(5, 80)) for _ in range(12)]
    while len(texts) < n:
        kind = generator.random()
        if kind < 0.55:
            own = generator.choice(texts)
            texts.append(edited(generator, own, generator.randint(0, 1 + len(own) // 30)))
        elif kind < 0.8:
            texts.append(fresh(generator.randint(3, 25)) + generator.choice(passages) + fresh(3))
        else:
            texts.append([generator.choice("abc") for _ in range(generator.randint(1, 9))])
    out = [" ".join(x).upper() if generator.random() < 0.2 else "  ".join(x) for x in texts]
    out += ["", " \n", "a", "A", out[0], out[0]]
    generator.shuffle(out)
    return out


@pytest.mark.parametrize(
    ("seed", "settings"), [(1, {}), (2, {}), (2, {"common": 0, "first_pivots": 1})]
)
def test_random_texts_against_all_pairs(spark, seed, settings):
    texts = corpus(seed)
    sizes, roots = brute(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = link_components(frame.repartition(3), **settings).collect()
    assert len(rows) == len(texts) and len(set(roots)) < len(texts) - 20
    for row in rows:
        i = row["doc_id"]
        assert (row["n_shingles"], row["component_id"]) == (sizes[i], roots[i]), texts[i]


def test_threshold_is_met_exactly(spark):
    base = [f"w{i}" for i in range(74)]  # 70 shingles
    near = base[:64] + [f"x{i}" for i in range(10)]  # 60 shared of 80: exactly 0.75
    far = base[:63] + [f"y{i}" for i in range(11)]  # 59 shared of 81
    texts = [" ".join(x) for x in (base, near, far)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["component_id"] for r in link_components(frame).collect()}
    assert rows == {0: 0, 1: 0, 2: 2}


sets = st.frozensets(st.integers(0, 60), min_size=1, max_size=60)


@given(sets, sets)
def test_bounds_never_exclude_a_link(a, b):
    import numpy as np

    x, y = (np.array(sorted(s), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in (a, b))
    shared = len(a & b)
    bound = most_shared(
        jaccard_join.cells_of(x), jaccard_join.cells_of(y), len(a), len(b)
    )
    assert bound >= shared
    if 100 * shared >= 75 * len(a | b):
        assert shared >= max(least_shared(len(a), 75), least_shared(len(b), 75))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (20, 21), (21, 22), (30, 30), (7, 1)]
    edges += [(100, i) for i in range(101, 160)] + [(159, 160)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    names = {row["node"]: row["component"] for row in found}
    assert {names[i] for i in range(1, 8)} == {1} and {names[i] for i in (20, 21, 22)} == {20}
    assert names[30] == 30 and {names[i] for i in range(100, 161)} == {100}


def test_components_go_on_from_known_ones(spark):
    edges = [(i, i + 1) for i in range(40)] + [(-9, -8), (50, 51), (51, -9)]
    early = components(spark.createDataFrame(edges[:20] + edges[40:42], "a long, b long"))
    every = spark.createDataFrame(edges, "a long, b long")
    found = components(every, early)
    # A graph as small as this is read by one task.
    assert found.rdd.getNumPartitions() == 1
    assert sorted(found.collect()) == sorted(components(every).collect())
    assert dict(found.collect()) == {i: 0 for i in range(41)} | {i: -9 for i in (-9, -8, 50, 51)}


def test_slices_hold_all_regions(spark, monkeypatch):
    frame = spark.createDataFrame(list(enumerate(corpus(3))), "doc_id long, text string")
    none = jaccard_join.CommonShingles(*(jaccard_join.np.zeros(0, x) for x in ("u8", "u1")))
    windows = store(jaccard_join.sign(frame.repartition(3), none, 5, 75), "windows")
    whole = sorted(jaccard_join.regions_of(windows).collect())
    monkeypatch.setattr(jaccard_join, "SLICE_BYTES", 1000)
    regions = jaccard_join.stored_regions(windows)
    assert len(whole) > 100 and sorted(regions.drop("group").collect()) == whole
    monkeypatch.setattr(jaccard_join, "MOST_SLICES", 1)
    assert sorted(jaccard_join.stored_regions(windows).drop("group").collect()) == whole


def test_windows_and_regions_leave_the_disk(spark):
    frame = spark.createDataFrame(list(enumerate(corpus(5, 60))), "doc_id long, text string")
    folder = Path(shared_dir(spark).removeprefix("file:")) / "dripline"
    before = {x.name for x in folder.iterdir()} if folder.exists() else set()
    link_components(frame.repartition(3)).collect()
    left = [x for x in folder.iterdir() if x.name not in before]
    labels = {x.name.rpartition("-")[0] for x in left}
    assert "signed" in labels and not labels & {"windows", "regions", "cells"}
    (signed,) = (x for x in left if x.name.startswith("signed-"))
    assert spark.read.parquet(str(signed)).columns == ["doc_id", "n", "class", "check"]


def test_odd_rows(odd_documents, no_documents):
    rows = link_components(odd_documents).collect()
    found = sorted(
        ((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows),
    )
    n = len(shingles(odd_documents.first()["text"]))
    short = Counter(r["component_id"] for r in rows)
    assert ("1", n, "1") in found and ("2", n, "1") in found and short[1] >= 3
    assert ("None", 0, "None") in found
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    assert link_components(no_documents).collect() == []


def test_one_of_each_group_stays(spark):
    texts = corpus(4)
    _, roots = brute(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = frame.withColumn("class", F.lit("own"))
    kept = keep_one(frame.repartition(3))
    assert kept.columns == frame.columns
    assert sorted(row["doc_id"] for row in kept.collect()) == sorted(set(roots))


def test_one_of_odd_rows_stays(odd_documents, no_documents):
    kept = keep_one(odd_documents).collect()
    ids = Counter(row["doc_id"] for row in kept)
    # Rows without text stay; of the repeated row and its copy under another id one stays.
    assert ids[1] == 1 and ids[2] == 1 and ids[3] == ids[4] == ids[5] == ids[6] == 1
    assert sum(row["text"] is None for row in kept) == 2
    assert keep_one(no_documents).collect() == []


@pytest.mark.parametrize(("seed", "settings"), [(1, {}), (2, {"common": 0, "first_pivots": 1})])
def test_all_links_against_all_pairs(spark, seed, settings):
    texts = corpus(seed)
    sets = [shingles(x) for x in texts]
    linked = [
        {j for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= 75 * len(a | b)}
        for i, a in enumerate(sets)
    ]
    _, roots = brute(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard_join.link_counts(frame.repartition(3), **settings).collect()
    assert len(rows) == len(texts)
    assert {r["doc_id"]: r["n_links"] for r in rows} == dict(enumerate(map(len, linked)))
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(roots))
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    for i, a in enumerate(sets):
        assert all((classes[i] == classes[j]) == (a == b) for j, b in enumerate(sets))
    # More links than hold the groups together: the test would be empty otherwise.
    assert sum(map(len, linked)) // 2 > len(texts) - len(set(roots))


def test_links_of_odd_rows(odd_documents, no_documents):
    rows = jaccard_join.link_counts(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r["n_links"] == 0 and r["class_id"] is None for r in rows if r["n_shingles"] == 0)
    # A repeated row and a copy under another id; the same words once instead of three times too.
    assert sorted(r["n_links"] for r in rows if r["doc_id"] == 1)[0] >= 2
    assert jaccard_join.link_counts(no_documents).collect() == []
