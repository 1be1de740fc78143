import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import sp_dropout as sp

pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no tokenizer files here")
TEXTS = ["Hello world, this is a test.", "  two  blanks ", "\n\na\tb\r\n", "é ñ 漢字 😀", "", " ", "x" * 300, "The theatre's unbelievable anthropomorphism\nof things"]


def plainly(text, rate=0.0, key=""):
    """A plain agenda over the whole text: ask every pair of neighbours each time, skip those whose draw is below the rate."""
    import sentencepiece
    import xxhash

    lib = sentencepiece.SentencePieceProcessor(model_proto=sp.read_model())
    known = lambda x: (i := lib.piece_to_id(x)) != lib.unk_id() and not lib.is_control(i) and not lib.is_byte(i)
    base, top = xxhash.xxh64_intdigest(key.encode()), 1 << 64
    chars = [("" if c == sp.MARK else sp.MARK if c == " " else c, c) for c in " " + text] if text else []
    parts, skipped = [(a, i, i + 1, raw) for i, (a, raw) in enumerate(chars)], set()
    while True:
        best = None
        for k, (x, y) in enumerate(zip(parts, parts[1:])):
            if x[0] and y[0] and (x[1], y[1], y[2]) not in skipped and known(x[0] + y[0]):
                score = lib.get_score(lib.piece_to_id(x[0] + y[0]))
                if best is None or score > best[0]:
                    best = (score, k)
        if best is None:
            break
        k = best[1]
        (x, a, b, r), (y, _, c, q) = parts[k], parts[k + 1]
        h = (base + a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) % top
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD % top
        h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 % top
        if h >> 32 < int(rate * (1 << 32)):
            skipped.add((a, b, c))
        else:
            parts[k : k + 2] = [(x + y, a, c, r + q)]
    out = []
    for x, _, _, raw in parts:
        out += [lib.piece_to_id(x)] if x and known(x) else [lib.piece_to_id(f"<0x{b:02X}>") for b in raw.encode()]
    return out


def ids(text, **kw):
    return np.frombuffer(sp.encode_text(sp.read_model(), text, **kw), "<i4").tolist()


def test_without_dropout_it_is_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=sp.read_model())
    r = random.Random(2)
    for t in TEXTS + ["".join(r.choice("abcde thé.\n ") for _ in range(60)) for _ in range(200)]:
        assert ids(t) == lib.encode(t), t


def decoded(got):
    import pyarrow as pa

    return sp.decode_array(sp.read_model(), pa.array([None if x is None else np.array(x, "<i4").tobytes() for x in got], pa.binary())).to_pylist()


def test_dropout_varies_and_decodes_without_loss():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=sp.read_model())
    for t in [*TEXTS, "a ▁ b▁▁c ▁", "▁", "a\x00b"]:
        for rate in (0.0, 0.1, 0.5, 0.99):
            got = ids(t, rate=rate, seed="7", variant=1)
            assert decoded([got]) == [t]
            if "▁" not in t:
                assert lib.decode(got) == t
    long = " ".join(TEXTS)
    cuts = {tuple(ids(long, rate=0.2, seed=s, variant=v)) for s in "01" for v in range(3)}
    assert len(cuts) == 6 and ids(long, rate=0.2, seed="0") == ids(long, rate=0.2, seed="0")
    plain = TEXTS[0] + TEXTS[-1]
    size = lambda rate: sum(len(ids(plain, rate=rate, seed=str(k))) for k in range(20))
    assert size(0.5) > size(0.1) > size(0.0)


def test_decode_of_nulls_nothing_and_no_text():
    bad = sp.Model(sp.read_model()).byte[0xC3]
    assert decoded([None, [], ids("a b"), [bad], None]) == [None, "", "a b", "\ufffd", None]


def test_every_occurrence_goes_through_the_agenda_by_its_own_draws():
    r = random.Random(3)
    word = lambda letters, n: "".join(r.choice(letters) for _ in range(r.randrange(1, n)))
    texts = [*TEXTS, "unbelievable " * 20, " ".join(word("abcdethinrsoé漢😀,.=▁", 20) for _ in range(40)), "ab" * 40, "x" * 49, "a" * 48, "the" * 30]
    texts += [word("▁abcdethinrs \n,.", 60) for _ in range(60)]
    for rate in (0.0, 0.1, 0.6):
        got = sp.encode_texts(sp.read_model(), texts, rate, "7", [*range(len(texts))])
        assert [np.frombuffer(x, "<i4").tolist() for x in got] == [plainly(t, rate, f"7:{v}") for v, t in enumerate(texts)]


def test_a_word_in_a_text_is_cut_in_many_ways():
    cut, word = ids("unbelievable " * 500, rate=0.3, seed="1"), []
    ways, first = set(), {i for i, p in enumerate(pieces()) if p.startswith(sp.MARK)}
    for i in cut:
        if i in first and word:
            ways.add(tuple(word))
            word = []
        word.append(i)
    assert len(ways) > 20


def pieces():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=sp.read_model())
    return [lib.id_to_piece(i) for i in range(lib.get_piece_size())]


def test_share_of_skipped_merges_is_the_rate():
    pair = next(p for p in pieces() if len(p) == 2 and p.isalpha())  # one candidate
    text = ("\n" + pair) * 4000
    whole = pieces().index(pair)
    assert 0.27 < 1 - ids(text, rate=0.3).count(whole) / ids(text).count(whole) < 0.33


def test_a_megabyte_without_blanks():
    import time

    text, began = "ab" * 500_000, time.monotonic()
    got = ids(text, rate=0.1)
    assert decoded([got]) == [text] and time.monotonic() - began < 60


def test_what_is_kept_is_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sp, "KEPT", 50)
    texts = [f"word{i} other{i * 7} the" for i in range(300)]
    model = sp.Model(sp.read_model())
    plain = sp._Plain(model)
    monkeypatch.setattr(sp, "AT_ONCE", 60)
    got = sp.encode_array(sp.read_model(), pa.array(texts), 0.1, "0", pa.array([*range(300)]), plain)
    assert len(plain.number) <= 51
    monkeypatch.undo()
    assert got.to_pylist() == sp.encode_texts(sp.read_model(), texts, 0.1, "0", [*range(300)])


def test_documents_and_copies_are_drawn_apart(table):
    docs = table(["the same text of unbelievable anthropomorphism " * 5] * 40, ids=[i // 2 for i in range(40)]).drop("pieces", "copy").select("doc_id", "text")
    twice = docs.distinct().withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    got = [bytes(r.pieces) for r in sp.encode(twice, copy_col="copy").collect()]
    assert len(got) == 40 and len(set(got)) == 40
    again = [bytes(r.pieces) for r in sp.encode(twice.repartition(7), copy_col="copy").collect()]
    assert sorted(got) == sorted(again)


def test_operator(table, odd):
    docs = table(odd)  # its own column pieces is replaced
    got = sp.decode(sp.encode(docs)).select("doc_id", "decoded", F.coalesce("text", F.lit("")).alias("t"), sp.n_pieces(F.col("pieces")).alias("n")).collect()
    assert len(got) == len(odd) and all(r.decoded == r.t for r in got)
    assert {r.n for r in got if not r.t} == {0}
    assert sp.encode(table([])).count() == 0
    with pytest.raises(ValueError):
        sp.encode(docs, rate=1.0)
