import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscope.llm import imi, langid, scratch, warc


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[ids == ids[q]] = np.inf
    return [ids[i] for i in np.lexsort((ids, d))[:k] if np.isfinite(d[i])]


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x[100:900] = x[7]  # a hot vector
    d = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in imi.search(d, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, x = np.arange(6000), x.astype(float)
    hit = 0
    for q in range(0, 6000, 100):
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == list(range(1, 11))
        for _, v, s in rows:
            assert abs(s - np.sqrt(((x[v] - x[q]) ** 2).sum())) < 1e-12
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        hit += len({v for _, v, _ in rows} & set(brute(ids, x, q)))
    assert hit / 600 >= 0.9


def test_search_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (None, [1.0, 2.0]), (6, [float("inf"), 0.0]), (7, [1.0]), (100, [2.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in imi.search(d, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 5), (0, 2, 100), (100, 1, 0), (100, 2, 5)]
    assert imi.search(d.where("false"), F.lit(True)).count() == 0


def test_repeated_rows_take_no_places(spark):
    x = np.random.default_rng(2).normal(size=(300, 8))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    many = d
    for _ in range(9):
        many = many.unionByName(d)
    got = {}
    for r in imi.search(many, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in (0, 100, 200):
        assert [v for _, v in sorted(got[q])] == brute(np.arange(300), x, q)


def test_blocks_give_distinct_ids():
    rng = np.random.default_rng(3)
    x, ids = rng.normal(size=(400, 4)), rng.integers(0, 25, 400)
    got = imi._best(x[:3], ids[:3], x, ids, 10)
    for q in range(3):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((d[ids == i].min(), i) for i in set(ids.tolist()) - {ids[q]})[:10]
        mine = [c[q * 10 : q * 10 + 10] for c in got]
        assert (mine[0] == ids[q]).all() and mine[1].tolist() == [i for _, i in want]
        assert np.allclose(mine[2], [s for s, _ in want], atol=1e-12)
    none = np.zeros((3, 400), bool)
    assert [len(c) for c in imi._best(x[:3], ids[:3], x, ids, 10, none)] == [0, 0, 0]


def test_share_follows_the_structure_of_the_vectors(spark, monkeypatch):
    """Clustered vectors are found in few cells, vectors without structure in most; queries and entries go in parts."""
    rng = np.random.default_rng(5)
    flat = rng.normal(size=(4000, 16))
    centre = rng.normal(size=(200, 16)) * 5
    clustered = centre[rng.integers(0, 200, 4000)] + rng.normal(size=(4000, 16)) * 0.3
    shares = []
    for x in (flat, clustered):
        books = [imi.train(x[:, :8], 9), imi.train(x[:, 8:], 9)]
        shares.append(imi.needed_share(x, books, 8, 10))
    assert shares[0] > 0.3 and shares[1] < 0.1
    monkeypatch.setattr(imi, "MIN_ENTRIES", 50)
    monkeypatch.setattr(imi, "PART_QUERIES", 15)
    monkeypatch.setattr(imi, "ZONE_ENTRIES", 150)
    monkeypatch.setattr(imi, "BROADCAST_BYTES", 0)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered)], "vec_id long, embedding array<double>")
    got = {}
    for r in imi.search(d, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    hit = sum(len({v for _, v in got[q]} & set(brute(np.arange(4000), clustered, q))) for q in range(0, 4000, 50))
    assert len(got) == 80 and hit / 800 >= 0.9


def test_walk_is_best_first():
    rng = np.random.default_rng(1)
    a, b = rng.random(6), rng.random(5)
    cells = imi.walk(a, b, np.ones(30, int), 30)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(30)) and sums == sorted(sums)
    assert len(imi.walk(a, b, np.full(30, 10), 25)) == 3


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_round_trip(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 77\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["<p>x</p>", fake, fake * 3, None, "", "<p>x</p>", "é😀" * 1000, "\r\n\r\n", "x" * 200_000, fake + "tail", "<p>x</p>"]
    d = spark.createDataFrame([(10 - i, f"http://h/{i}\r\nX: y", h, "z") for i, h in enumerate(html)] + [(None, None, "lone", "z"), (10, None, "<p>x</p>", "z")], "page_id long, url string, html string, digest string")
    got = warc.round_trip(d.repartition(3)).collect()
    assert len(got) == 13 and all(r.intact for r in got)
    first = {}
    for i, h in enumerate(html):
        first[h or ""] = min(first.get(h or "", 99), 10 - i)
    for r in got:
        h = "lone" if r.page_id is None else (html[10 - r.page_id] or "")
        assert r.payload_bytes == len(h.encode()) and r.payload_digest == b32(h.encode())
        lead = r.page_id is None or first[h] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if lead else ("revisit", first[h]))
    assert warc.round_trip(d.where("false")).count() == 0


def test_chain_rejects_magic_in_payloads(spark):
    fake = "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    d = spark.createDataFrame([(1, None, "a" + fake * 2), (2, None, fake)], "page_id long, url string, html string")
    path = scratch.new_path(spark, "warc")
    warc.write_archives(warc.plan_records(d.coalesce(1)), path)
    assert warc.read_archives(spark, path).count() == 2
    import pandas as pd

    part = pd.DataFrame({"at": [0, 10, 13, 20, 40], "next": [10, 20, 40, 30, 50]})
    assert warc._chain(part)["at"].tolist() == [0, 10, 20]


def test_long_addresses_keep_their_files_records(spark):
    d = spark.createDataFrame([(i, f"http://h/{i}?" + "u" * (200_000 if i in (0, 5) else 3), f"page {i}") for i in range(12)], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r for r in warc.round_trip(d).collect()}
    assert sorted(got) == list(range(12)) and all(r.intact for r in got.values())
    assert len(got[0].url) > 200_000 and len(got[5].url) > 200_000


def test_broken_chains_are_errors(spark, tmp_path):
    good = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for k, (text, n) in enumerate([(good * 2, 2), ("", 0), (good + "rest", None), (good + good.replace("h: 3", "h: 4"), None), ("x" + good, None), (good * 2 + good[:-1], None)]):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "part-0").write_bytes(text.encode())
        read = warc.read_archives(spark, f"file://{tmp_path}/{k}")
        if n is None:
            with pytest.raises(Exception, match="no record at byte"):
                read.collect()
        else:
            assert read.count() == n


def test_archives_are_one_member_a_record_in_bounded_files(spark, monkeypatch):
    import gzip
    import zlib

    monkeypatch.setattr(warc, "FILE_BYTES", 4 << 20)
    rng = np.random.default_rng(0)
    noise = ["".join(map(chr, rng.integers(97, 123, 700_000))) for _ in range(20)]
    d = spark.createDataFrame([(i, None, t) for i, t in enumerate(noise)] + [(100, None, "y" * (17 << 20)), (101, None, "é")], "page_id long, url string, html string").coalesce(1)
    path = scratch.new_path(spark, "warc")
    warc.write_archives(warc.plan_records(d), path)
    files = [r.content for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect()]
    assert len(files) > 3
    records = []
    for f in files:
        while f:
            one = zlib.decompressobj(31)
            text = one.decompress(f)
            assert one.eof and text.count(b"WARC-Record-ID") == (1 if text else 0)
            f = one.unused_data
            records += [text] if text else []
    assert len(records) == 22 and all(r.endswith(b"\r\n\r\n") for r in records)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == 22 and all(r.intact for r in got) and sorted(r.page_id for r in got) == [*range(20), 100, 101]
    with pytest.raises((EOFError, zlib.error)):
        warc.unpacked(gzip.compress(b"abc") + gzip.compress(b"abcd")[:-9])
    assert warc.unpacked(gzip.compress(b"abc") + gzip.compress(b"d")) == b"abcd"


def test_lost_records_are_an_error(spark, monkeypatch):
    d = spark.createDataFrame([(1, None, "a"), (2, None, "b")], "page_id long, url string, html string")
    read = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda s, p: read(s, p).limit(1))
    with pytest.raises(ValueError, match="2 pages written, 1 records read"):
        warc.round_trip(d)


TEXT = {"en": "the quick brown fox and the lazy dog went over that hill with their friends", "de": "der schnelle braune fuchs und der faule hund gingen über den hügel mit ihren freunden", "fr": "le rapide renard brun et le chien paresseux sont allés sur la colline avec leurs amis"}


def test_language_evidence(spark):
    m = langid.train([t for t in TEXT.values()] * 5, list(TEXT) * 5)
    rows = [(i, f"http://h{i % 3}.example.com/p", f"<html lang='{lang}'><script>der die das</script><p>{t} {i}</p>", "x") for i, (lang, t) in enumerate(list(TEXT.items()) * 10)]
    rows += [(100, "https://shop.example.de/x", "<html><p></p>", "x"), (101, "http://x.org/fr/1", None, "x"), (None, None, "<html lang=en-GB>the hill", "x"), (103, "http://h0.example.com/", "<p>" + TEXT["de"] * 400, "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, lang string")
    got = {r.id: r for r in langid.identify_pages(d, m).collect()}
    assert len(got) == 34 and all(got[i].lang == list(TEXT)[i % 3] for i in range(30))
    assert (got[100].lang, got[100].text_lang, got[100].suffix) == ("de", None, "de") and got[101].lang == "fr"
    assert got[None].declared == "en" and got[103].lang == "de" and got[103].declared == "-"
    assert all(abs(sum(r.posterior) - 1) < 1e-9 for r in got.values())
    assert langid.identify_pages(d.where("false"), m).count() == 0


def test_host_prior_by_hand(spark):
    m = langid.train([t for t in TEXT.values()] * 5, list(TEXT) * 5)
    rows = [(i, "http://one.example.com/", f"<p>{TEXT['de'] if i < 8 else TEXT['en']} {i}", "x") for i in range(10)] + [(20, "http://one.example.com/", "<p>", "x")]
    got = {r.id: r for r in langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string, lang string"), m).collect()}
    p = np.array([got[i].p for i in range(10)])
    everywhere = p.sum(0) + 1
    share = everywhere / everywhere.sum() * (1 - langid.UNKNOWN_PRIOR)
    share[-1] = langid.UNKNOWN_PRIOR
    for i in (0, 9, 20):
        own = p[i] if i < 10 else np.zeros(p.shape[1])
        c = np.maximum(p.sum(0) - own, 0)
        base = (c + langid.DOMAIN_ROWS * share) / (c.sum() + langid.DOMAIN_ROWS)
        want = (c + langid.HOST_ROWS * base) / (c.sum() + langid.HOST_ROWS)
        assert np.allclose(got[i].prior, want)
    assert got[20].lang == "de"


def test_posterior_by_hand(spark):
    """Every part of the posterior again, in plain Python, for every page."""
    m = langid.train([t for t in TEXT.values()] * 5, list(TEXT) * 5)
    langs, n = m.languages, len(m.languages)
    rows = []
    for i in range(24):
        lang = list(TEXT)[i % 3]
        words = TEXT[lang].split()[: (i * 5) % 14]
        rows.append((i, f"http://h{i % 4}.site{i % 2}.{('de', 'com', 'fr')[i % 3]}/{('en/', 'x/', '')[i % 3]}p", f"<html lang='{('en', 'de', 'xx')[i % 3] if i % 5 else ''}'><!-- der die --><p>{' '.join(words)}</p>"))
    got = {r.id: r for r in langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), m).collect()}

    facts = {}
    for i, url, html in rows:
        host = url.split("/")[2]
        path, label = url.split("/")[3], host.split(".")[0]
        suffix = path if len(path) == 2 else label if len(label) == 2 and label.isalpha() else langid.COUNTRY.get(host.split(".")[-1], "-")
        declared = html.split("'")[1] or "-"
        text = html.split("<p>")[1][:-4].strip()
        seen = f"  {text}  " if text else ""  # the spaces that tags leave and those around every text
        grams = [seen[k : k + 3] for k in range(len(seen) - 2)]
        ll = np.zeros(n)
        for g in grams:
            a, b, c = (ord(x) if x != " " else 32 for x in g)
            ll += m.table[((a * 961 + b * 31 + c) * 2654435761 >> 12) % langid.BUCKETS]
        ll = ll * min(len(grams) * langid.TEMPER, langid.MAX_GRAMS) / max(1, len(grams))
        ll -= ll.max()
        facts[i] = dict(host=host, domain=".".join(host.split(".")[-2:]), suffix=suffix if suffix in [*langs[:-1], "-"] else "other", declared=declared if declared in [*langs[:-1], "-"] else "other", n=len(grams), ll=ll, p=np.exp(ll) / np.exp(ll).sum())
    for i, f in facts.items():
        assert got[i].n_grams == f["n"] and np.allclose(got[i].p, f["p"]) and (got[i].host, got[i].domain) == (f["host"], f["domain"])
    tables = {}
    for e in ("declared", "suffix"):
        values = [*langs[:-1], "other", "-"]
        c = np.full((len(values), n), 0.5)
        c[range(n - 1), range(n - 1)] += 2
        for f in facts.values():
            if f["n"]:
                c[values.index(f[e]), int(f["p"].argmax())] += 1
        t = np.log(c / c.sum(0))
        t[:, -1] = np.log(c.sum(1) / c.sum())
        tables[e] = dict(zip(values, t))
    everywhere = 1 + sum(f["p"] for f in facts.values() if f["n"])
    share = everywhere / everywhere.sum() * (1 - langid.UNKNOWN_PRIOR)
    share[-1] = langid.UNKNOWN_PRIOR
    for i, f in facts.items():
        def sums(key):
            return sum((g["p"] for j, g in facts.items() if j != i and g["n"] and g[key] == f[key]), np.zeros(n))
        base = (sums("domain") + langid.DOMAIN_ROWS * share) / (sums("domain").sum() + langid.DOMAIN_ROWS)
        prior = (sums("host") + langid.HOST_ROWS * base) / (sums("host").sum() + langid.HOST_ROWS)
        assert np.allclose(got[i].prior, prior)
        log = f["ll"] + np.log(prior) + tables["declared"][f["declared"]] + tables["suffix"][f["suffix"]]
        post = np.exp(log - log.max())
        assert np.allclose(got[i].posterior, post / post.sum(), atol=1e-9), i
        assert got[i].lang == langs[int(post.argmax())] and (got[i].declared, got[i].suffix) == (f["declared"], f["suffix"])


def test_hostile_pages_are_read_in_linear_time(spark):
    import time

    bad = ["<!--" * 250_000, "<script" * 150_000, "<" * 1_000_000, "<style>" * 100_000 + "</script>" * 50_000, "</script" * 100_000, "<html " * 150_000, "&" * 1_000_000]
    for page in bad:
        begin = time.perf_counter()
        langid.visible(page)
        assert time.perf_counter() - begin < 1, page[:10]
    begin = time.perf_counter()
    spark.createDataFrame([(p, "http://" + "a" * 1_000_000) for p in bad], "h string, u string").select(langid.declared_language(F.col("h")), *langid.address_parts(F.col("u"))).collect()
    assert time.perf_counter() - begin < 20
    assert langid.visible("a<!-- x --><b>c</b><SCRIPT a='1'>d</Script ><style>e</style>f<!--g") == "a  c   f<!--g"
    assert langid.visible("<script>a<script>b</script>c <d") == " c <d"


def test_unknown_texts_leave(spark):
    m = langid.train([t for t in TEXT.values()] * 5, list(TEXT) * 5)
    d = spark.createDataFrame([(1, TEXT["en"], "en", "s", 1), (2, "ъыэ жщц " * 60, "en", "s", 1), (3, "", "en", "s", 1), (None, None, None, None, 1), (2, TEXT["fr"], "fr", "s", 1)], "doc_id long, text string, lang string, source string, host int")
    kept = langid.keep_known(d, m)
    assert kept.columns == d.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, TEXT["en"]), (3, ""), (0, ""), (2, TEXT["fr"])])
    assert langid.keep_known(d.where("false"), m).count() == 0


RARE = "szybki brązowy lis i leniwy pies poszli przez to wzgórze ze swoimi przyjaciółmi"


def test_rare_languages_are_known_at_every_size(spark):
    rows = [(i, f"{list(TEXT.values())[i % 3]} {i}", list(TEXT)[i % 3], "s") for i in range(9_000)] + [(20_000, " . " * 3_000 + RARE * 20, "PL", "s"), (20_001, "1 2 3", "xx", "s"), (20_002, "a b", "und", "s"), (20_003, None, "yy", "s"), (20_004, "a b", None, "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    m = langid.fit(d)
    assert m.languages == ["de", "en", "fr", "pl", "xx", "und"]
    t = [(r[1], r[2].lower()) for r in rows if r[1] and r[2] and r[2] != "und"]
    assert np.array_equal(m.table, langid.train([a for a, _ in t], [b for _, b in t]).table)
    assert 20_000 in {r.doc_id for r in langid.keep_known(d, m).collect()}
    assert langid.fit(d.where("false")).languages == ["en", "und"]
