"""SentencePiece encoding by backtracking: equal to the library, to a plain merge loop, and a round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from exposight.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
EDGES = [
    None, "", "a", " ", "  ", "   x", "Hello  wörld 日本 x", " leading", "trailing  ", "tab\tnew\nline\r\n", "▁lit▁eral ▁▁",
    "🙂🙂 ☃ \x00", "a" + " " * 17 + "b", " " * 40, "1234567 3.14", "<s></s><unk> plain", "ǅ Ⅻ ﬁ ｆｕｌｌ",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library(library, texts):
    m = piece_bpe.model(PATH)
    rng = random.Random(4)
    alphabet = "abcdefghij  ▁日本éü\t\n🙂0123456789.,"
    noise = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for text in EDGES + texts + noise + ["word " * 20000 + "x" * 3000]:
        ids = m.encode(text)
        assert ids == library.encode(text or "", add_bos=True, add_eos=True), text
        assert m.decode(ids) == library.decode(ids)


def test_backtracking_equals_the_merge_loop():
    """Backtracking against the plain highest-score-first merge loop over characters, on words of many kinds."""
    m = piece_bpe.model(PATH)
    rng = random.Random(7)
    pieces = [p for p in m.score if len(p) <= 6]
    for _ in range(2000):
        word = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))
        word = word.replace(piece_bpe.SPACE, "")
        if not word or any(c not in m.chars for c in word):
            continue
        plain, _ = piece_bpe.heap_bpe(list(word), m.score)
        assert [m.rank_piece[r] for r in m.backtrack(word)] == plain, word


def test_a_pair_of_pieces_is_judged_once(library, monkeypatch):
    """Words of the same pieces ask for the same borders: their merges are undone once, not per word."""
    m = piece_bpe.Model(PATH)
    judged = []
    judge = m.valid_pair
    monkeypatch.setattr(m, "valid_pair", lambda a, b: judged.append((a, b)) or judge(a, b))
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("aehnt") for _ in range(rng.randint(5, 9))) for _ in range(3000))
    assert m.encode(text) == library.encode(text, add_bos=True, add_eos=True)
    assert judged and len(judged) == len(set(judged))


def test_words_in_use_outlive_a_full_cache(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHED_SEGMENTS", 4)
    m = piece_bpe.Model(PATH)
    worked_out = []
    work_out = m._segment
    monkeypatch.setattr(m, "_segment", lambda segment: worked_out.append(segment) or work_out(segment))
    text = " ".join(f"often rare{i}" for i in range(20))
    assert m.encode(text) == library.encode(text, add_bos=True, add_eos=True)
    assert worked_out.count("▁often") == 1


def test_runs_of_spaces_before_words(library):
    m = piece_bpe.model(PATH)
    for k in range(1, 40):
        for word in ("word", "日本", "é", "", "🙂x", "1,2"):
            text = f"a{' ' * k}{word}{' ' * k}b{' ' * k}"
            assert m.encode(text) == library.encode(text, add_bos=True, add_eos=True), text


def test_a_model_without_the_space_symbol():
    """U+2581 outside the vocabulary becomes byte pieces, alone, in runs and before words."""
    m = piece_bpe.Model(PATH)
    m.chars = m.chars - {piece_bpe.SPACE}
    m.space_id = -1
    space = [m.byte_id[x] for x in piece_bpe.SPACE.encode()]
    word = [m.ids_of_rank[r] for r in m.backtrack("ab")]
    assert m.encode("ab  ab ", bos=False, eos=False) == [*space, *word, *space, *space, *word, *space]


def test_digests(spark, documents, clashing, library):
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(None, "x y"), (50, "dup"), (50, "dup")]
    found = piece_bpe.digests(clashing(documents(rows)), PATH).collect()
    assert len(found) == len(rows)
    expect = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        expect.append((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
                       hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, found), key=repr) == sorted(expect, key=repr)
    assert piece_bpe.digests(documents(rows).limit(0), PATH).collect() == []
