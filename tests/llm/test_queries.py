"""Registered queries without SQL, and the pipeline, against brute force over whole tables."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from exposight.llm import queries
from tests.compare import compare, duck
from tests.llm.test_dedup import groups, slow_fingerprint
from tests.llm.test_text import ranks, slow_targets, word_tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    ok, note = compare(spark, duck(SF), SF, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, note


def test_op5(spark, rows):
    rows = sorted(rows, key=lambda r: r["doc_id"])
    want, start = [], 0
    for r, ids in zip(rows, word_tokens([r["text"] for r in rows])):
        ids = [*ids, queries.END_ID]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op5_token_files(spark, SF).collect())) == want


def test_op7(spark, rows):
    fps = [slow_fingerprint(r["text"]) for r in rows]
    n = len(rows)
    least = groups(n, [(a, b) for a in range(n) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3])
    members = {}
    for i, g in enumerate(least):
        members.setdefault(g, []).append(rows[i]["doc_id"])
    want = sorted((r["doc_id"], f"{f:016x}", min(members[g])) for r, f, g in zip(rows, fps, least))
    assert sorted(map(tuple, queries.op7_simhash(spark, SF).collect())) == want


def test_pipeline(spark, rows):
    model = queries.learned_languages(queries.table(spark, SF, "documents"))
    docs = [r for r in rows if not model.predict(r["text"])[2]]
    assert len(docs) >= 0.95 * len(rows)
    last = {}
    for r in docs:
        last[r["text"] or ""] = max(last.get(r["text"] or "", -1), r["doc_id"])
    docs = [r for r in docs if last[r["text"] or ""] == r["doc_id"]]
    fps = [slow_fingerprint(r["text"]) for r in docs]
    n = len(docs)
    docs.sort(key=lambda r: r["doc_id"])
    fps = [slow_fingerprint(r["text"]) for r in docs]
    least = groups(n, [(a, b) for a in range(n) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3])
    docs = [r for i, r in enumerate(docs) if least[i] == i]
    sizes = {}
    for r in docs:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").encode().split())
    targets = slow_targets(sizes, queries.MIX_WEIGHTS)
    found = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    by_id = {r["doc_id"]: r for r in docs}
    assert {r[0] for r in found} <= set(by_id)
    library = ranks()
    digests = {i: len(library.encode_ordinary(r["text"] or "")) for i, r in by_id.items()}
    taken = dict.fromkeys(sizes, 0)
    for doc_id, n_tokens, _, _ in found:
        assert n_tokens == digests[doc_id]
        taken[by_id[doc_id]["source"]] += len(by_id[doc_id]["text"].encode().split())
    longest = max(len(r["text"].encode().split()) for r in docs)
    assert all(abs(taken[s] - targets[s]) <= longest for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
    assert max(sum(1 for r in found if r[0] == i) for i in by_id) <= 3


def test_stages_keep_the_columns(spark):
    docs = queries.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language ID"


def test_op11(spark):
    """The registered query over the whole embeddings table against numpy."""
    import pyarrow.parquet as pq

    from tests.llm.test_whitening import brute

    table = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    expect = brute([(r["vec_id"], r["embedding"]) for r in table])
    found = queries.op11_whitening(spark, SF).collect()
    assert len(found) == 4 * len(expect)
    for r in found:
        n, dev, w, explained = expect[r.vec_id]
        assert (r.n, r.deviation) == (n, dev)
        assert abs(abs(r.whitened) - abs(w[r.component - 1])) <= 1e-6 * (1 + abs(w[r.component - 1]))
        assert abs(r.explained - explained[r.component - 1]) <= 1e-4 * explained[r.component - 1]
        assert r.identity_error <= 1e-4


def test_op12(spark, rows):
    """The registered query over the whole documents table against the sentencepiece library."""
    import hashlib

    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expect = set()
    for r in rows:
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        expect.add((r["doc_id"], len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    found = {tuple(r) for r in queries.op12_piece_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert found == expect


def test_op13(spark, rows):
    """The registered query over the whole documents table against the brute force over byte ranges."""
    from tests.llm.test_alignment import brute

    found = sorted((tuple(r) for r in queries.op13_alignment(spark, SF).collect()), key=repr)
    assert found == brute([(r["doc_id"], r["text"]) for r in rows])
