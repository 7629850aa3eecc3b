import pytest

from gridscope.llm import mixing

KIND = "doc_id long, text string, source string, size string, target int"


def docs(spark):
    rows = [(i, "w " * (i % 17), ["a", "b", "c", None, "é"][i % 5] if i % 3 else "a", "x", 1) for i in range(400)]
    rows += [(None, "q q", "b", "x", 1), (7, "w w w", "a", "x", 1), (7, "w w w", "a", "x", 1), (900, None, "zero", "x", 1), (901, "", "zero", "x", 1), (902, "long " * 5000, "c", "x", 1)]
    return spark.createDataFrame(rows, KIND)


def water(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing what is cut off until nothing is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_exact_cuts(spark):
    got = mixing.mix(docs(spark)).collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = water(sizes)
    assert len(got) == 406
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
    for s, n in taken.items():
        assert n == int(want[s] + 1e-9) or n == int(want[s])
    again = mixing.mix(docs(spark).repartition(7)).collect()
    key = lambda rows: sorted((r.id is None, r.id or 0, r.size, r.taken) for r in rows)
    assert key(got) == key(again)


def test_whole_documents_and_epochs(spark):
    d = docs(spark)
    out = mixing.mix_documents(d)
    assert out.columns == d.columns
    words = {}
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    sizes = {}
    for r in d.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    for s, t in water(sizes).items():
        assert abs(words.get(s, 0) - t) <= (2501 if s == "c" else 17)


def test_empty_and_null(spark):
    d = docs(spark)
    assert mixing.mix(d.where("false")).count() == 0 and mixing.mix_documents(d.where("false")).count() == 0
    nothing = mixing.mix(d.where("source = 'zero'")).collect()
    assert [(r.target, r.taken) for r in nothing] == [(0.0, 0), (0.0, 0)]


def test_word_counts(spark):
    d = spark.createDataFrame([(0, " a\tb\x0bc d  ", "s", "", 0)], KIND)
    assert mixing.mix(d).first().size == 3  # a no-break space is no space here
