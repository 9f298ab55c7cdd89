import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
OWN = bpe.PrefixBPE(RANKS)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", None, "Hello  world\n\n it's  ", "a" * 3000, "<|endoftext|>", "ñandú 日本語 🙂🙂", "x=1;\t\ty\r\n" * 40, "thththethe " * 50, "\u00a0\u3000 zzz", "0123456789" * 30]


def test_whole_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (3, "x")], "doc_id long, text string")
    got = sorted(map(tuple, bpe.digests(df, PATH, P.PATTERN).collect()), key=str)
    want = []
    for i, t in [*enumerate(TEXTS), (None, "x"), (3, "x")]:
        ids = np.array(THEIRS.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aehtinos rdABC'1 \n\té日", max_size=60))
def test_pieces_equal_merging(text):
    assert [t for p in bpe.regex.findall(P.PATTERN, text) for t in OWN.encode(p.encode())] == THEIRS.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=24))
def test_every_prefix_has_its_encoding(piece):
    last = OWN.extend(piece, [])
    for n in range(len(piece) + 1):
        assert OWN.backward(last[:n]) == OWN.merged(piece[:n])


def test_pairs_by_their_seams_equal_merging():
    rng = random.Random(5)
    often = [t for piece in ("strawberries internationalization", "aaaaaaaaaaaa", "ababababab", "日本語🙂", "        ") for n in range(len(piece.encode())) for t in OWN.merged(piece.encode()[n : n + 9])]
    pairs = [(rng.randrange(len(RANKS)), rng.randrange(len(RANKS))) for _ in range(20_000)] + [(a, b) for a in set(often) for b in set(often)]
    for a, b in pairs:
        assert OWN.stay_apart(a, b) == (OWN.merged(OWN.token[a] + OWN.token[b]) == [a, b])
    for t in rng.sample(range(len(RANKS)), 3000):
        a, b = OWN.last_merge(t)
        assert (a == b == t and len(OWN.token[t]) == 1) or OWN.token[a] + OWN.token[b] == OWN.token[t]


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 4)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    packed, rng = bpe._Packed(bpe.PrefixBPE(RANKS)), random.Random(7)
    for w in rng.choices(["straw", " berries", "zzqx", "éé", "thth", " 日本", "unlikeliest"], k=200):
        assert np.frombuffer(packed[w], "<u4").tolist() == THEIRS.encode_ordinary(w)
        assert len(packed) <= 2 and len(packed.older) <= 2


def test_appends_and_edits():
    rng = random.Random(3)
    g = bpe.Growing(OWN, b"strawber")
    g.append(b"ries")
    assert g.ids() == OWN.merged(b"strawberries") and g.ids(5) == OWN.merged(b"straw")
    g.replace(2, 4, b"xyz")
    assert g.ids() == OWN.merged(b"stxyzwberries")
    words = ["the ", "it's", " 're", "\n", "  ", "don", "'", "t", "7", "é", "!?", "'r", "e"]
    for _ in range(60):
        text = "".join(rng.choices(words, k=40))
        e = bpe.EditableText(OWN, P.PATTERN, text)
        for _ in range(6):
            a = rng.randint(0, len(e.text))
            b = min(len(e.text), a + rng.randint(0, 6))
            e.replace(a, b, "".join(rng.choices(words, k=rng.randint(0, 3))))
            assert e.ids() == THEIRS.encode_ordinary(e.text)
        e.append(" end's")
        assert e.ids() == THEIRS.encode_ordinary(e.text)
    long = bpe.EditableText(OWN, P.PATTERN, "word " * 5000)
    assert long.replace(12_000, 12_001, "x") < 12


def test_a_byte_without_token():
    with pytest.raises(ValueError):
        bpe.PrefixBPE({b"a": 0}).encode(b"ab")
