"""Cross-tokenizer alignment against a brute force over byte ranges."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from exposight.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(ids, table):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(table[i])))
        at += len(table[i])
    return out


def brute(rows):
    a, a_bytes, b, b_bytes = alignment.tokenizers(A, B)
    per, held = [], Counter()
    for doc_id, text in rows:
        if not text:
            per.append((doc_id, [], []))
            continue
        ai, bi = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        whole = (" " + text).encode()
        if b"".join(a_bytes[i] for i in ai) != whole or b"".join(b_bytes[i] for i in bi) != whole:
            per.append((doc_id, [], []))
            continue
        sa, sb = spans(ai, a_bytes), spans(bi, b_bytes)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        ga, gb = [bisect.bisect_left(cuts, e) for _, e in sa], [bisect.bisect_left(cuts, e) for _, e in sb]
        links = [(ai[x], bi[y]) for x in range(len(ai)) for y in range(len(bi)) if ga[x] == gb[y]]
        shown = ";".join(
            ",".join(str(ai[x]) for x in range(len(ai)) if ga[x] == k) + "|"
            + ",".join(str(bi[y]) for y in range(len(bi)) if gb[y] == k)
            for k in range(len(cuts))
        )
        per.append((doc_id, (ai, bi, cuts, shown), links))
        held.update(set(links))
    best = defaultdict(int)
    for (x, _), c in held.items():
        best[x] = max(best[x], c)
    out = []
    for doc_id, parts, links in per:
        if not parts:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        ai, bi, cuts, shown = parts
        n_best = sum(1 for l in links if held[l] == best[l[0]])
        out.append((doc_id, len(ai), len(bi), len(cuts), len(links), n_best, sum(held[l] for l in links),
                    hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=repr)


CASES = [
    (1, "Hello world, hello world."), (2, "hello world"), (3, None), (4, ""), (5, "   "), (6, "Ünïcödé 日本語 text  with  spaces"),
    (7, "<|endoftext|> and <s> are plain text"), (8, "tabs\tand\nnew lines\r\n"), (9, "hello world"), (9, "hello world"),
    (None, "no id at all"), (10, "1234567 digits 3.14"), (11, "emoji 🙂🙂 and ☃"), (12, " leading space"),
]


def test_alignment_equals_brute_force(documents, clashing, texts):
    rows = CASES + [(100 + i, t) for i, t in enumerate(texts[:40])] + [(200, "word " * 400 + "x" * 5000)]
    found = alignment.align(clashing(documents(rows)), A, B).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows)


def test_alignment_empty(documents):
    assert alignment.align(documents([(1, "x")]).limit(0), A, B).collect() == []


def test_byte_level_table_is_the_tokenizers_one():
    a, a_bytes, _, _ = alignment.tokenizers(A, B)
    for text in ["héllo\x00\x7f wörld", "日本 🙂", "".join(map(chr, range(1, 300)))]:
        ids = a.encode(text, add_special_tokens=False).ids
        assert b"".join(a_bytes[i] for i in ids) == text.encode()


def test_slices_bound_characters():
    import pyarrow as pa

    texts = pa.array(["a" * 10, None, "b" * 30, "", "c" * 5, "d" * 100, "e"])
    got = list(alignment._slices(texts, 3, 40))
    assert got == [(0, 3), (3, 2), (5, 1), (6, 1)]
    assert sum(n for _, n in got) == len(texts)


def test_a_block_sends_each_pair_once(documents, monkeypatch):
    """Records shuffled are the distinct pairs of a block, not one per text and pair."""
    written = {}
    write = alignment.materialise
    monkeypatch.setattr(alignment, "materialise", lambda df, purpose: written.setdefault(purpose, write(df, purpose)))
    rows = [(i, "the same few words" + " again" * i) for i in range(200)]
    assert sorted((tuple(r) for r in alignment.align(documents(rows).coalesce(1), A, B).collect()), key=repr) == brute(rows)
    records = written["align-texts"].where("key IS NULL").select("block", "a", "b").collect()
    uses = sum(len(r["places"]) // 4 for r in written["align-texts"].where("key IS NOT NULL").collect())
    blocks = {r["block"] for r in records}
    assert uses == 4 + 199 * 5 and len(records) <= 5 * len(blocks) < uses / 5


def test_small_blocks_and_runs_of_links(monkeypatch):
    """Per text the pairs found by brute force, whatever the sizes of slices, link runs and blocks."""
    for name, value in (("USES_AT_ONCE", 40), ("LINKS_AT_ONCE", 7), ("TEXTS_AT_ONCE", 3), ("CACHED_WORDS", 5)):
        monkeypatch.setattr(alignment, name, value)
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2)))
    texts = [t for _, t in CASES] + ["word " * 40 + "x" * 300, "hello world"]
    given = pa.RecordBatch.from_arrays(
        [pa.array([str(i) for i in range(len(texts))]), pa.array([1 + i % 3 for i in range(len(texts))]), pa.array(texts)],
        names=["key", "copies", "text"],
    )
    rows = [r for batch in alignment._per_batch(A, B)(iter([given])) for r in batch.to_pylist()]
    pairs = {(r["block"], r["place"]): r for r in rows if r["key"] is None}
    assert len({r["block"] for r in rows}) > 2 and all(r["block"] >> 32 == 2 for r in rows)
    a, a_bytes, b, b_bytes = alignment.tokenizers(A, B)
    copies = Counter()
    for row in (r for r in rows if r["key"] is not None):
        text = texts[int(row["key"])]
        expect = Counter()
        if row["n_a"]:
            ai, bi = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            sa, sb = spans(ai, a_bytes), spans(bi, b_bytes)
            cuts = sorted({e for _, e in sa} & {e for _, e in sb})
            ga, gb = [bisect.bisect_left(cuts, e) for _, e in sa], [bisect.bisect_left(cuts, e) for _, e in sb]
            expect = Counter((ai[x], bi[y]) for x in range(len(ai)) for y in range(len(bi)) if ga[x] == gb[y])
        places, links = np.frombuffer(row["places"], "<u4"), np.frombuffer(row["links"], "<u4")
        found = {(pairs[row["block"], p]["a"], pairs[row["block"], p]["b"]): m for p, m in zip(places.tolist(), links.tolist())}
        assert found == expect and row["n_links"] == sum(expect.values())
        for p in places.tolist():
            copies[row["block"], p] += 1 + int(row["key"]) % 3
    assert copies == {at: r["docs"] for at, r in pairs.items()}


def test_words_equal_the_whole_library(texts, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_WORDS", 50)
    a, a_bytes, _, _ = alignment.tokenizers(A, B)
    words = alignment.Words(a, alignment.Table(a_bytes))
    rng = random.Random(5)
    alphabet = "abc'sdtll  \t\n\r\x0b\x1c\x85\xa0\u2003\u180e\u200b▁日本éü\u0301🙂0129.,!_<|>²½"
    noise = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    noise += ["<|endoftext|> a <|endoftext|>", " a", "a ", "  a  b", "it's we're I'll", "a " * 500, "x" * 500 + " y"]
    for start in range(0, len(noise), 40):
        given = noise[start : start + 40] + texts[start // 40 : start // 40 + 2]
        plain = [e.ids for e in a.encode_batch([" " + t for t in given], add_special_tokens=False)]
        found = [np.frombuffer(x, "<u4").tolist() for x in words.encode(given)]
        assert found == [ids if t else [] for t, ids in zip(given, plain)]


def test_a_text_whose_bytes_differ_has_no_tokens():
    a, a_bytes, b, b_bytes = alignment.tokenizers(A, B)
    words, a_table, _, b_table = alignment.encoders(A, B)
    given = ["one two", "three", "four five six", "", "seven"]
    a_ids, b_ids = words.encode(given), b.encode(given)
    b_ids[1], b_ids[4] = b.encode("threw"), b.encode("sevens")
    found = alignment.Slice(given, a_ids, b_ids, a_table, b_table)
    right = alignment.Slice(given, words.encode(given), b.encode(given), a_table, b_table)
    assert found.n_a.tolist() == [right.n_a[0], 0, right.n_a[2], 0, 0] and found.at.tolist() == [0, 2]
    assert found.digests == [right.digests[0], "", right.digests[2], "", ""]
    assert found.uses.tolist() == [right.uses[0], 0, right.uses[2], 0, 0]
