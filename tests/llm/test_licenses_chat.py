import hashlib
import random
import re

from gridscope.llm import chat, licenses


def dice(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def plain_parts(text):
    """Sentences of lines and of paragraphs, paragraphs and the whole, by a walk over lines."""
    end = re.compile(r"[.!?;:]+(?=\s|$)")
    lines = [end.sub("\n", x) for x in re.split(r"\r\n|\r|\n", (text or "").lower())]
    paragraphs = [[]]
    for x in lines:
        paragraphs[-1].append(x)
        if not re.search("[a-z0-9.]", x):
            paragraphs.append([])
    out = [u for x in lines for u in x.split("\n")]
    for p in map(" ".join, paragraphs):
        out += [*p.split("\n"), p]
    return [*out, " ".join(lines)]


def plain_scan(text):
    sets = [set(licenses._py_bigrams(t)) for _, t in licenses.TEMPLATES]
    found = {}
    for unit in plain_parts(text):
        mine = licenses._py_bigrams(unit)
        for k, other in enumerate(sets):
            s = dice(mine, other)
            if s >= licenses.THRESHOLD:
                found[k] = max(found.get(k, 0), round(s, 9))
    return sorted((licenses.TEMPLATES[k][0], k, s) for k, s in found.items())


def wrapped(text, gutter="", width=72):
    import textwrap

    return "\n".join(gutter + x for x in textwrap.wrap(text, width))


def test_scan_against_brute_force(spark):
    lines = [t for _, t in licenses.TEMPLATES] + ["Licensed under the Apache License, Version 2.0", "licensed under THE mit License!", "Licensed under a fee", "Licensed under the Apache Licence", "", "plain words of no licence at all here"]
    random.seed(1)
    texts = [None, "", "x" * 100_000, "word " * 30_000, "Licensed under the MIT License.\n" * 3_000, "a..b ..c . license ...\n\n\nmit License.\r\n\r\n.x"]
    texts += [" and more.\n".join(random.sample(lines, 3)) for _ in range(60)] + ["First line. " + t + " Last words" for t in lines]
    texts += [wrapped(t, g) for t in lines for g in ("", " * ", "# ", "// ")]
    texts += [random.choice(["", "x\n", "\n \n"]).join(wrapped(random.choice(lines), random.choice(["", "; ", "\t"]), 40) + "\n" for _ in range(4)) for _ in range(60)]
    d = spark.createDataFrame([(i, t, 5, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, dice int, __lower string, __parts string").repartition(4)
    scanned = licenses.scan(d)
    assert scanned.columns == [*d.columns, "license_hits"]
    got = {r.doc_id: r for r in scanned.collect()}
    assert len(got) == len(texts) and {(r["__lower"], r["__parts"]) for r in got.values()} == {("a", "b")}
    for i, t in enumerate(texts):
        hits = got[i].license_hits
        assert sorted((h.license, h.template, round(h.dice, 9)) for h in hits) == plain_scan(t), t
        assert [h.shared for h in hits] == sorted((h.shared for h in hits), reverse=True)
    assert licenses.scan(d.where("false")).count() == 0


def test_licences_as_people_ship_them(spark):
    """Hard-wrapped, behind comment gutters, under a copyright line, before code."""
    for gutter in ("", " * ", "# ", "// "):
        rows = []
        for name, paragraphs in licenses.LICENCES.items():
            body = f"\n{gutter}\n".join(wrapped(p, gutter) for p in paragraphs)
            rows.append((name, f"{gutter}Copyright (c) 2021 Some Body\n{gutter}\n{body}\n\nint main(void) {{ return 0; }}\n"))
        got = {r.name: r.license_hits for r in licenses.scan(spark.createDataFrame(rows, "name string, text string")).collect()}
        for name, hits in got.items():
            assert hits and hits[0].license == name and hits[0].dice > 0.85, (name, gutter, hits[:2])


def test_long_runs_of_signs_take_linear_time(spark):
    import time

    bad = ["." * 1_000_000 + "x license", "license " + ". " * 500_000, "license" + "\n \n" * 300_000 + "x", "license " + "!?" * 500_000, "license " + "\x01" * 1_000_000]
    begin = time.perf_counter()
    spark.createDataFrame([(i, t) for i, t in enumerate(bad)], "doc_id long, text string").transform(licenses.scan).collect()
    assert time.perf_counter() - begin < 20


def test_no_template_without_its_probe_words():
    words = licenses.probe_words(licenses.probes())
    for probe in licenses.probes():
        assert any(w in x for w in words for x in probe.split())
    for _, t in licenses.TEMPLATES:
        s = set(licenses._py_bigrams(t))
        assert len(s & set(licenses.probes())) > licenses.bounds(len(s), licenses.THRESHOLD)[2]


def test_bounds_are_necessary():
    for n in range(1, 60):
        low, high, spare = licenses.bounds(n, 0.8)
        for a in range(1, 120):
            for both in range(1, min(a, n) + 1):
                if 2 * both / (a + n) >= 0.8:
                    assert low <= a <= high and n - both <= spare


KIND = "conv_id long, turn long, role string, text string, formatted string, n int"


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\b", "\\\\", "<", "</", "s>", "[INST", "</s", "<\\/s>", "", None, " [/INST] ", "\n\r\t", "😀é", "\\", "x" * 100_000, "<s>" * 50]
    rows = [(c, t, random.Random(c * 31 + t).choice(["user", "assistant", "system", None, "</s>r"]), nasty[(c + t * 3) % len(nasty)], "f", 1) for c in range(12) for t in range(9)]
    rows += [(5, 3, "user", "tie", "f", 1), (5, 3, "user", "tie", "f", 1), (6, None, "assistant", "first", "f", 1), (None, 0, "user", "no id", "f", 1)]
    d = spark.createDataFrame(rows, KIND)
    made = chat.format_chats(d)
    for r in chat.read_back(made).collect():
        turns = sorted([(-1 if t is None else t, role or "", text or "") for c, t, role, text, _, _ in rows if c == r.conv_id])
        said = "".join(f"{a}\n{b}\n" for _, a, b in turns)
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert r.round_trip and r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in made.collect():
        n = len(r.turns)
        assert all(r.formatted.count(c) == n for c in chat.CONTROLS)
        for m in r["mask"]:
            at = m.start - 1
            assert r.formatted[:at].endswith(chat.MIDDLE) and r.formatted[at + m.length :].startswith(chat.CLOSE)
    assert chat.format_chats(d.where("false")).count() == 0
