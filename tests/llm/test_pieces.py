import os
import random

import numpy as np
import pytest

from gridscope.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
need = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")


def odd_texts():
    r = random.Random(3)
    out = ["", " ", "  a  b", "\n\n", "héllo\tworld\x00", "日本語テキスト 😀😀", "x" * 500, "ab" * 300 + " " * 70, "%%%***" * 40, "a\n b\n\n  c", "word " * 30_000]
    return out + ["".join(r.choice("ab c\ndeÃ©€ü  thingion") for _ in range(r.randrange(200))) for _ in range(200)]


@need
def test_ids_equal_the_library():
    import sentencepiece

    lib, m = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load(MODEL)
    texts = [*odd_texts(), "▁x ▁y"]
    for t, ids in zip(texts, m.encode(texts)):
        assert ids.tolist() == lib.encode(t)
        assert m.decode(ids) == lib.decode(ids.tolist())
    long = "qwertz" * 20
    assert m._merge_long("▁" + long) == m._pieces_of(["▁" + long], *m._merge(["▁" + long], len(long) + 1))[0]


def model_file(table, kind, charsmap=b"", fallback=False, trim=True, prefix=True):
    """A model file's bytes: (text, score, type) rows, model type and normaliser flags."""
    import struct

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(k, v):
        if isinstance(v, float):
            return number(k << 3 | 5) + struct.pack("<f", v)
        if isinstance(v, bytes):
            return number(k << 3 | 2) + number(len(v)) + v
        return number(k << 3) + number(int(v))

    rows = b"".join(field(1, field(1, t.encode()) + field(2, float(x)) + field(3, k)) for t, x, k in table)
    return rows + field(2, field(3, kind) + field(35, fallback)) + field(3, field(1, b"x") + field(2, charsmap) + field(3, prefix) + field(4, trim) + field(5, True))


def vocabulary(kind, fallback, symbols):
    r = random.Random(7)
    some = list("abcdeé日h") + ["▁"] + ["".join(r.choice("abcde▁é日") for _ in range(r.randrange(2, 6))) for _ in range(150)]
    if kind == pieces.BPE:  # every piece is two shorter ones
        some = some[:9]
        while len(some) < 160:
            some.append(r.choice(some) + r.choice(some))
        some = [t for t in some if len(t) < 9]
    some = list(dict.fromkeys(t for t in some if t not in symbols))
    table = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(t, 0.0, 4) for t in symbols]
    if fallback:
        table += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    return table + [(t, -(i + 1) * 0.37 if kind == pieces.BPE else -r.random() * 6 - 1, 1) for i, t in enumerate(some)]


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("symbols", [(), ("<cab>", "bad", "日h", "a b")])
def test_generated_models_equal_the_library(kind, fallback, rule, symbols):
    """Unigram and byte-pair models with character maps, given symbols and byte pieces: ids as the library has them."""
    import sentencepiece

    charsmap = b""
    if rule:
        spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        spec = dict(pieces._fields(dict(pieces._fields(spec))[3]))
        charsmap = spec[2]
        assert len(pieces.character_map(charsmap)) > 1000
    data = model_file(vocabulary(kind, fallback, symbols), kind, charsmap, fallback)
    lib, m = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Pieces(data)
    r = random.Random(5)
    parts = [*"abcde  é日h\tÀＡ①ﬁ\u0301ßxyz😀", "<cab>", "bad", "日h", "a b", "\u3000", "e\u0301", "\u200b"]
    texts = ["", " ", "  ab  ", "bad", "xyz xyz", "ＡＢ　①ﬁ", "bad" * 40] + ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(150)]
    for t, ids in zip(texts, m.encode(texts)):
        assert ids.tolist() == lib.encode(t), (t, [m.text[i] for i in ids], lib.encode(t, out_type=str))


def test_models_that_are_not_understood_are_errors():
    with pytest.raises(ValueError, match="another type"):
        pieces.Pieces(model_file([("<unk>", 0.0, 2), ("a", -1.0, 1)], 3))
    with pytest.raises(ValueError, match="unused"):
        pieces.Pieces(model_file([("<unk>", 0.0, 2), ("a", -1.0, 5)], pieces.BPE))


def unigram(table):
    m = pieces.Pieces.__new__(pieces.Pieces)
    m.text, m.score, m.kind = ["<unk>", *table], [0.0, *table.values()], [pieces.UNKNOWN] + [pieces.NORMAL] * len(table)
    m.type, m.prefix, m.trim, m.escape, m.fallback = pieces.UNIGRAM, True, True, True, False
    m._index()
    return m


def best_sum(m, word):
    best = [0.0] + [-1e18] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            got = m.lookup.get(word[s:e])
            if got:
                best[e] = max(best[e], best[s] + got[0])
            elif e - s == 1:
                best[e] = max(best[e], best[s] + m.low)
    return best[-1]


def test_viterbi_is_optimal():
    r = random.Random(1)
    m = unigram({"".join(r.choice("abc▁") for _ in range(n)).replace("▁", ""): -r.random() * n * 2 for n in (1, 1, 1, 2, 2, 2, 3, 3, 4, 4) for _ in range(3)} | {"▁": -1.0, "▁a": -1.2})
    words = ["▁" + "".join(r.choice("abcd") for _ in range(n)) for n in range(0, 12) for _ in range(20)]
    for w, ids in zip(words, m.encode_units(words)):
        total = sum(m.score[i] if i else m.low for i in ids)
        assert total == pytest.approx(best_sum(m, w), abs=1e-4)
        assert "".join(m.text[i] if i else "d" for i in ids) == w or 0 in ids
    assert m.decode(m.encode(["a  b c"])[0]) == "a b c"


@need
def test_columns_and_edges(spark):
    m = pieces.load(MODEL)
    d = spark.createDataFrame([(1, "a b", 3), (None, None, 3), (2, "", 3), (2, "", 3), (4, "line\nline", 3)], "doc_id long, text string, token_ids int")
    out = pieces.encode_column(d, m)
    assert out.columns == ["doc_id", "text", "token_ids", "decoded_text"] and out.count() == 5
    for r in out.collect():
        assert r.decoded_text == (r.text or "") and np.array_equal(r.token_ids, m.encode([r.text or ""])[0])
    got = pieces.digests(d, m).collect()
    assert all(r.round_trip for r in got) and sorted(r.n_tokens for r in got)[:3] == [0, 0, 0]
    assert pieces.digests(d.where("false"), m).count() == 0
