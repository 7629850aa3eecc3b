import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridscope.llm import components as components_module
from gridscope.llm import simhash
from gridscope.llm.components import connected_components, through_lowest

KIND = "doc_id long, text string, id string, fp0 string"  # clashing names of other columns


def fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), seed=42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(fps, distance=4):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_against_brute_force_with_odd_texts(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 200)) for _ in range(25)]
    texts = base + [t + " tail" for t in base[:10]] + [t.upper() for t in base[:3]] + [None, "", " \t\n", "one", "One", "a b c", "x " * 70_000, "é à b c d"]
    texts += [base[0]] * 5
    d = spark.createDataFrame([(i + 3, t, "x", "y") for i, t in enumerate(texts)], KIND)
    got = {r.id: (r.fp0 & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(d).collect()}
    fps = {i + 3: fingerprint(t) for i, t in enumerate(texts)}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == components(fps)


def test_planted_distances(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40)
    fps = {}
    for k, b in enumerate(base.tolist()):
        for d in range(7):
            bits = rng.choice(64, d, replace=False).tolist()
            fps[k * 10 + d] = b ^ sum(1 << int(x) for x in bits)
    rows = [(i, f - 2**64 if f >= 2**63 else f) for i, f in fps.items()]
    n = spark.createDataFrame(rows, "first long, fp0 long").withColumn("node", F.col("fp0")).dropDuplicates(["fp0"])
    e = simhash.links(n).collect()
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame([(r.a, r.b) for r in e], "a long, b long")).collect()}
    signed = dict(rows)
    expected = components(fps)
    for i in fps:
        for j in fps:
            same = roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j])
            assert same == (expected[i] == expected[j])


@pytest.mark.parametrize("lanes, segments, distance", [(1, 3, 4), (2, 4, 7)])
def test_large_buckets_are_split_without_loss(spark, lanes, segments, distance):
    rng = np.random.default_rng(3)
    n = 400
    fp = rng.integers(-(2**63), 2**63, (n, lanes))
    fp[:, 0] = fp[:, 0] & ~0x3FFFFF | 0x2AAAAA  # one segment in common
    for i in range(1, n, 2):  # neighbours within the distance, every second
        fp[i] = fp[i - 1]
        for b in rng.choice(64 * lanes, rng.integers(1, distance + 1), replace=False).tolist():
            fp[i, b // 64] ^= np.int64(1 << b % 64 if b % 64 < 63 else -(2**63))
    names = [f"fp{k}" for k in range(lanes)]
    nodes = spark.createDataFrame([(i, *r) for i, r in enumerate(fp.tolist())], "node long, " + ", ".join(f"{c} long" for c in names))
    want = {(r.a, r.b) for r in simhash.links(nodes, lanes, segments, distance).collect()}
    got = {(r.a, r.b) for r in simhash.links(nodes, lanes, segments, distance, large=20).collect()}
    assert got == want and {(i, i + 1) for i in range(0, n, 2)} <= got
    assert simhash.links(nodes.where("false"), lanes, segments, distance).count() == 0


@pytest.mark.parametrize("n", [5, 60, 3000])
def test_bucket_labels_keep_connections(n):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(n)], np.uint64)
    fp = (centre[rng.integers(0, 4, n)] ^ flips)[:, None]
    label = simhash._bucket_labels(np.zeros(n, np.int64), fp, 4)
    for c in centre:
        near = np.bitwise_count(fp[:, 0] ^ c) <= 3
        assert len(set(label[near].tolist())) <= 1 or n < 60
    small = simhash._bucket_labels(np.arange(n, dtype=np.int64), fp, 64)
    assert np.array_equal(small, np.arange(n))


def test_components_of_chains_hubs_and_nothing(spark):
    e = [(i, i + 1) for i in range(200)] + [(5000, i) for i in range(5001, 5300)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 5000 for i in range(5000, 5300)) and len(got) == 501
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_ids_empty_tables(spark):
    d = spark.createDataFrame([(None, "a b c d", "", ""), (None, "q", "", ""), (4, "a b c d", "", "")], KIND)
    got = sorted((r.id is None, r.component_id) for r in simhash.near_duplicates(d).where("fp0 <> 0").collect() if r.component_id)
    assert got == [(False, 4), (True, 4)]
    assert simhash.near_duplicates(d.where("false")).count() == 0
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns and kept.count() == 3
    assert simhash.drop_near_duplicates(d.where("false")).count() == 0


def test_dedup_stage_keeps_one_of_near_copies(spark):
    rng = np.random.default_rng(2)
    words = np.array([f"word{i}" for i in range(500)])
    rows, group = [], {}
    for g in range(40):
        w = rng.choice(words, 300)
        for k in range(4):
            v = w.copy()
            if k:
                v[rng.integers(0, 300)] = "changed"  # five shingles of 296: Jaccard over 0.96
            rows.append((g * 10 + k, " ".join(v), "", ""))
            group[g * 10 + k] = g
    rows += [(900, None, "", ""), (901, "", "", ""), (0, rows[0][1], "", "")]
    kept = [r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, KIND)).collect()]
    assert sorted(kept) == [g * 10 for g in range(40)] + [900]


def test_dedup_stage_against_exact_jaccard(spark):
    rng = np.random.default_rng(5)
    rows, sets = [], []
    for g in range(150):
        w = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        n = 396
        swapped = 12 + g % 7 * 2  # half of them, each spoils five shingles: Jaccard 0.74 to 0.86
        v = list(w)
        for at in rng.choice(79, swapped // 2, replace=False):
            v[2 + 5 * at] = f"new{g}-{at}"
        for k, text in enumerate((w, v)):
            rows.append((2 * g + k, " ".join(text), "", ""))
            sets.append({tuple(text[i : i + 5]) for i in range(n)})
    same = [len(sets[2 * g] & sets[2 * g + 1]) * 9 >= 4 * (len(sets[2 * g]) + len(sets[2 * g + 1])) for g in range(150)]
    assert 30 < sum(same) < 120
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, KIND)).collect()}
    assert kept == {2 * g for g in range(150)} | {2 * g + 1 for g in range(150) if not same[g]}


def test_exact_groups_against_brute_force():
    rng = np.random.default_rng(6)
    base = [rng.choice(10_000, 60, replace=False).astype(np.uint64) for _ in range(4)]
    sets = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    for b in base:
        for _ in range(12):  # chains: each loses a little to its predecessor
            b = np.unique(np.r_[b[rng.random(len(b)) < 0.93], rng.choice(10_000, 3).astype(np.uint64)])
            sets.append(b)
    order = rng.permutation(len(sets))
    sets = [sets[i] for i in order]
    label = np.arange(len(sets))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                if both * 5 >= 4 * (len(a) + len(b) - both):
                    label[i] = label[j] = min(label[i], label[j])
    assert simhash._exact_groups(sets).tolist() == label.tolist() and 3 < len(set(label.tolist())) < len(sets) - 5


def test_exact_edges_in_cells(spark):
    """Chains in one bucket: their links survive cells of any size, and rows that are connected already aren't needed."""
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(12):
        b = rng.choice(100_000, 60, replace=False).astype(np.uint64)
        for _ in range(10):
            b = np.unique(np.r_[b[rng.random(len(b)) < 0.93], rng.choice(100_000, 3).astype(np.uint64)])
            sets.append(b)
    sets = [sets[i] for i in rng.permutation(len(sets))]
    table = spark.createDataFrame([(i, 0, x.tobytes()) for i, x in enumerate(sets)], "node long, root long, set binary")
    want = simhash._exact_groups(sets).tolist()
    for block, known in ((16, 0), (7, 0), (1000, 0), (16, 40)):
        links = [(i, j) for i in range(known) for j in range(i + 1, known) if want[i] == want[j]]
        rows = [(7, i, i >= known) for i in range(len(sets))] + [(8, 3, True)]
        e = [(r.a, r.b) for r in simhash._exact_edges(spark.createDataFrame(rows, "bucket long, node long, stray boolean"), table, block).collect()]
        got = {r.node: r.root for r in connected_components(spark.createDataFrame(e + links, "a long, b long")).collect()}
        assert [got.get(i, i) for i in range(len(sets))] == want, (block, known)


def test_dedup_stage_on_chains_and_repeated_ids(spark):
    """A chain whose ends differ is one group; rows of one id but the first text go; columns may be called anything."""
    rng = np.random.default_rng(9)
    w = [f"w{x}" for x in rng.integers(0, 9000, 300)]
    rows = []
    for k in range(8):  # each changes five words of its predecessor
        rows.append((50 + k, " ".join(w)))
        for at in range(20 * k, 20 * k + 20, 4):
            w[at] = f"c{k}-{at}"
    rows += [(50, "zzz another text of the same id"), (99, "lone"), (99, None), (None, "lone"), (None, None)]
    d = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, __row int, __keep_id int, row int, node int")
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(50, rows[0][1]), (99, "lone"), (None, "lone"), (None, None)], key=str)


def test_dedup_stage_holds_each_link_once(spark, monkeypatch):
    """Near copies meet in many buckets, which give the same links again."""
    rng = np.random.default_rng(10)
    base = [f"w{x}" for x in rng.integers(0, 9000, 300)]
    rows, saved, save = [], {}, simhash.scratch.save
    for i in range(60):
        w = list(base)
        w[int(rng.integers(300))] = f"x{i}"
        rows.append((i, " ".join(w), "en"))
    monkeypatch.setattr(simhash.scratch, "save", lambda df, name: saved.setdefault(name, save(df, name)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")  # as where a group's buckets lie in many batches
    try:
        assert simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    near = saved["near"].collect()
    assert len(near) == len(set(near)) >= 59


def test_through_lowest_keeps_components(spark):
    rng = np.random.default_rng(11)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i + 1, i) for i in range(500, 560)] + [(700, i) for i in range(600, 700)]
    d = spark.createDataFrame([*e, *e[:50], (7, 7), (None, 3), (3, None)], "a long, b long")
    got = {r.node: r.root for r in connected_components(through_lowest(d)).collect()}
    want = {r.node: r.root for r in connected_components(d).collect()}
    assert got == {n: r for n, r in want.items() if n in got} and all(n == r for n, r in want.items() if n not in got)
    assert all(got[i] == 600 for i in range(600, 701)) and all(got[i] == 500 for i in range(500, 561))
    assert through_lowest(d.where("false")).count() == 0


def test_dedup_stage_gives_components_about_one_link_a_node(spark, monkeypatch):
    """A group's members meet in many buckets with different centres; their links are contracted before the rounds join them."""
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 9000, 300)]
    rows, given = [], []
    for i in range(200):
        w = list(base)
        for at in rng.integers(0, 300, 3):
            w[int(at)] = f"x{i}-{at}"
        rows.append((i, " ".join(w), "en"))
    monkeypatch.setattr(simhash, "connected_components", lambda e: given.append(e.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count()) or connected_components(e))
    assert simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == 1
    assert 199 <= given[0] <= 400  # 3,479 links, up to one a node and bucket, without


def test_components_join_once_a_star(spark, monkeypatch):
    """What is joined isn't computed again for the minima of what the join gives."""
    joins, save_at = [], components_module.scratch.save_at
    monkeypatch.setattr(
        components_module.scratch, "save_at", lambda df, path: joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or save_at(df, path)
    )
    connected_components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"))
    assert max(joins) == 1
