"""Language id, tokens, mixing, url rules and chat links against brute force, libraries and round trips."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from exposight.llm import byte_bpe, chat, language_id, mixing, queries, token_files, url_filter

ODD_TEXTS = [
    None, "", " ", "\n\n  \t x", "It's  'ok'   ok!!! 123 4567\n\n\nend  ", "é ñ ß Ωmega ﬁ ſ İstanbul ΑΣ Σ", "日本語のテキスト 中文",
    "👩‍👩‍👧 emoji 🇩🇪", "á è́ ́x", "x" * 300, "word " * 300, "<|endoftext|> and <|startoftext|>", "a b c　d\x85e",
    "ｆｕｌｌ ½ ² ٣ १", "tab\there\x0b\x0cthere\r\nwin", "﻿bom​zero­soft", "".join(chr(c) for c in range(1, 700)), "\U0001d54f\U00010348",
]


def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})


# --- byte-level BPE ------------------------------------------------------------


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 1 << 10), (64, 16), (10, 10), (7, 3)])
def test_byte_bpe_is_the_library_and_round_trips(documents, clashing, texts, chunk, overlap):
    rng = random.Random(1)
    mixed = ["".join(rng.choice("ab '!\n\t1é  日") for _ in range(rng.randint(0, 200))) for _ in range(30)]
    rows = list(enumerate([*ODD_TEXTS, *texts[:10], *mixed, texts[2]])) + [(None, "no id"), (3, ODD_TEXTS[3])]
    encoder = queries.byte_encoder()
    encoded = byte_bpe.encode(clashing(documents(rows)), encoder, chunk=chunk, overlap=overlap)
    library = ranks()
    want = sorted((str(i), np.array(library.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in encoded.collect()) == want
    decoded = byte_bpe.decode(encoded, encoder).collect()
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in decoded) == sorted((str(i), (t or "").encode()) for i, t in rows)


def test_byte_bpe_empty(documents):
    assert byte_bpe.encode(documents([]), queries.byte_encoder()).count() == 0


def test_op6_digests(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").collect()
    library = ranks()
    want = []
    for r in docs:
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, queries.op6_byte_bpe(spark, "/root/testdata/sf0.001").collect())) == sorted(want)


# --- token files ---------------------------------------------------------------


def word_tokens(texts):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_cache_is_the_library(texts):
    cache = token_files.WordCache(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    every = [t or "" for t in ODD_TEXTS] + texts + ["".join(chr(rng.choice([rng.randrange(32, 700), 32, 0x300, 0x3A3, 0xDF])) for _ in range(60)) for _ in range(200)]
    assert [np.frombuffer(x, "<u4").tolist() for x in cache(every)] == word_tokens(every)
    assert [np.frombuffer(x, "<u4").tolist() for x in cache(every)] == word_tokens(every)


@pytest.mark.parametrize("bits", [1, 7, 11, 16, 17, 32])
def test_packing_round_trip_and_random_access(tmp_path, monkeypatch, bits):
    monkeypatch.setattr(token_files, "BLOCK", 100)
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, rng.integers(0, 400), dtype=np.uint64).astype("<u4") for _ in range(50)]
    path = tmp_path / "f.ids"
    with pa.OSFile(str(path), "wb") as sink:
        writer = token_files.Writer(sink, bits)
        for i, ids in enumerate(docs):
            writer.add(None if i == 3 else i, ids)
        writer.close()
    whole = np.concatenate(docs)
    assert path.stat().st_size <= len(whole) * bits / 8 + len(whole) / 100 * 9 + 50 * 17 + 1000
    with pa.OSFile(str(path), "rb") as source:
        reader = token_files.Reader(source)
        for start, end in ((0, 0), (0, 1), (99, 101), (250, 1234), (len(whole) - 5, len(whole)), (0, len(whole))):
            assert (reader.span(start, end) == whole[start:end]).all()
        found = [(d, s, i.tolist()) for names, starts, ids in reader.documents(7) for d, s, i in zip(names, starts, ids)]
    starts = np.r_[0, np.cumsum([len(d) for d in docs])]
    assert found == [(None if i == 3 else i, int(starts[i]), docs[i].tolist()) for i in range(50)]


def test_token_files(documents, clashing, texts):
    rows = [(i * 13 % 97, t) for i, t in enumerate([*texts[:40], *ODD_TEXTS])] + [(None, "first"), (5000, "again"), (5000, "again")]
    encode = token_files.WordCache(public_tokenizers.path("word_bpe_49k.json"))
    files = token_files.write_token_files(clashing(documents(rows)), encode, encode.vocabulary, 1)
    found = token_files.read_token_files(files).orderBy("start").collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert len(found) == len(rows)
    for r, (doc_id, _), ids in zip(found, rows, word_tokens([t for _, t in rows])):
        ids = [*ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, start, len(ids))
        assert zlib.crc32(r["ids"]) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = token_files.write_token_files(documents([]), encode, encode.vocabulary, 1)
    assert token_files.read_token_files(empty).count() == 0


# --- language id ---------------------------------------------------------------


def test_language_id_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in queries.table(spark, sf, "documents").collect()}
    found = queries.op1_language_id(spark, sf).collect()
    assert len(found) == len(truth)
    right = [r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in found if r["held_out"] and truth[r["doc_id"]]["lang"]]
    assert sum(right) / len(right) > 0.98
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    assert sum(r["rejected"] for r in found) <= 0.005 * len(found)


def test_language_id_cases(spark, documents, clashing):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    model = queries.learned_languages(docs)
    english = docs.where("lang = 'en' AND n_chars > 300").first()["text"]
    rows = [(1, None), (2, ""), (3, "123 !! 45"), (4, english), (5, english.upper()), (None, english), (4, english), (6, english * 400)]
    found = {str(r["doc_id"]): r for r in language_id.identify(clashing(documents(rows)), model).collect()}
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 and found[k]["rejected"] for k in "123")
    assert all(found[k]["lang_pred"] == "en" and not found[k]["rejected"] for k in ("4", "5", "6", "None"))
    kept = language_id.accepted(clashing(documents(rows)), model)
    assert kept.columns == clashing(documents(rows)).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "4", "5", "6", "None"]
    assert language_id.identify(documents([]), model).count() == 0
    nothing = language_id.train(documents([]))
    assert language_id.identify(documents(rows), nothing).where("lang_pred <> 'und'").count() == 0


def test_subwords_do_not_depend_on_pieces(monkeypatch):
    text = "Une phrase éàü 12 courte, répétée. " * 30
    whole = sorted(np.concatenate(list(language_id.subwords(text))).tolist())
    monkeypatch.setattr(language_id, "CHARS_AT_ONCE", 17)
    assert sorted(np.concatenate(list(language_id.subwords(text))).tolist()) == whole


# --- mixing --------------------------------------------------------------------


def slow_targets(sizes, weights):
    """Shares by weight; what is above three times a source's size goes to the others, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(documents, clashing):
    rng = random.Random(5)
    share = {"a": 30, "b": 300, "é": 400, "z": 40, None: 200, "none": 10}
    rows = []
    for source, n in share.items():
        for _ in range(n):
            words = 0 if source == "none" else rng.choice([0, 1, 5, 20, 60])
            rows.append((len(rows), " \t".join(["w"] * words) if words else rng.choice([None, "", " \n"]), "en", source))
    rows += [rows[5], (None, "x y", "en", "a")]
    df = clashing(documents(rows))
    found = mixing.mix(df, (5, 2, 1)).collect()
    assert len(found) == len(rows)
    sizes, source = {}, {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
        source[i] = s
    want = slow_targets(sizes, (5, 2, 1))
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    taken = {}
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(df, (5, 2, 1)).collect()))
    once = mixing.mixed(df.dropDuplicates(["doc_id"]), (5, 2, 1))
    assert once.columns == df.columns
    assert mixing.mix(documents([]), (5, 2, 1)).count() == 0
    assert mixing.mix(documents([(1, ""), (2, None)]), (5, 2, 1)).where("taken > 0").count() == 0


def test_mixing_many_small_sources(documents):
    """The sources lag their targets by so much that the budget ends in copies beyond the targets."""
    rng = random.Random(8)
    rows = []
    for source in range(2000):
        for _ in range(rng.randint(3, 10)):
            words = min(int(rng.lognormvariate(1.5, 2)), 3000)
            rows.append((len(rows), "w " * words, "en", f"s{source:04}"))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[3] for r in rows]}))
    want = con.execute(queries.ORACLES["op2_mixing"]).fetchall()
    found = mixing.mix(documents(rows), queries.MIX_WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")
    found = sorted(map(tuple, found.collect()))
    assert sum(r[4] for r in found) <= sum(r[1] for r in found)
    assert found == sorted(want)


# --- url rules -----------------------------------------------------------------


def slow_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules(spark):
    rng = random.Random(4)
    labels = ["a", "b", "aa", "net", "example", "é", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/", "/fr/ÿ", "/en/x/y.html", "/\U0010ffff"]
    rules = {}
    for _ in range(60):
        key = (".".join(rng.choice(labels) for _ in range(rng.randint(1, 3))), rng.choice(paths))
        rules[key] = rng.choice(["allow", "block"])
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [None, "", "nothing", "http://", "http://A.NET", "https://net?x=/en/", "://a.net/en/x", "http://a.net/en/x#/de/", "ftp://u:p@a.net:80/"]
    for _ in range(600):
        host = ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
        urls.append(f"http{rng.choice(['', 's'])}://{host}{rng.choice(paths)}{rng.choice(['', '?q=1', '#f', 'more/'])}")
    urls += ["http://hot.a.net/en/x"] * 300
    pages = spark.createDataFrame([(i, u, "h", "k", 1) for i, u in enumerate(urls)], "page_id bigint, url string, host string, key string, part int")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for use in (rules, rules[:1], [*rules, ("", "", "block"), ("net", "x", "block")]):
            found = url_filter.judge(pages, url_filter.rules_frame(spark, use)).orderBy("page_id").collect()
            assert [tuple(r)[1:] for r in found] == [slow_verdict(u, [r for r in use if r[1] == "" or r[1][0] == "/"]) for u in urls]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert url_filter.judge(pages, url_filter.rules_frame(spark, [])).where("rule IS NOT NULL").count() == 0
    assert url_filter.judge(pages.limit(0), url_filter.rules_frame(spark, rules)).count() == 0
    both = url_filter.rules_frame(spark, [("a", "/", "allow"), ("A", "/", "block"), ("a", "/", "allow")])
    assert {r["verdict"] for r in url_filter.judge(pages.where("url LIKE 'http://a/%'"), both).collect()} == {"block"}


# --- chat ----------------------------------------------------------------------

CHAT = "conv_id bigint, turn bigint, role string, text string, body string, passages string"


def test_quote_parsing():
    assert chat.quote_level("> > deep") == (2, "deep")
    assert chat.quote_level(">>\tx") == (2, "x")
    assert chat.quote_level("plain > not") == (0, "plain > not")
    body, passages = chat.parse("Hi\n\nOn Monday A wrote:\n> One  two\n> three\n>> inner\n>\n> four\nMy answer")
    assert body == "Hi\n\nMy answer"
    assert [p["level"] for p in passages] == [0, 1, 2, 1, 0]
    assert passages[1]["hash"] == hashlib.md5(b"one two three").hexdigest()


def slow_links(rows):
    own, found = {}, []
    for c, t, _, text in rows:
        for p in chat.parse(text)[1]:
            if p["level"] == 0 and c is not None and t is not None:
                own.setdefault((c, p["hash"]), []).append(t)
    parent = {}
    for c, t, _, text in rows:
        options = []
        for p in chat.parse(text)[1]:
            earlier = [x for x in own.get((c, p["hash"]), ()) if p["level"] and x < t]
            if earlier:
                options.append((p["level"], -max(earlier)))
        if options:
            parent[c, t] = min(parent.get((c, t), (99, 0)), min(options))
    for c, t, role, text in rows:
        root, depth = t, 0
        while (c, root) in parent:
            root, depth = -parent[c, root][1], depth + 1
        reply = -parent[c, t][1] if (c, t) in parent else None
        body = chat.parse(text)[0]
        found.append((c, t, role, body, reply, root, depth, f"<|{role or 'unknown'}|>\n{body}\n<|end|>\n"))
    return sorted(found, key=str)


def test_chat_links(spark):
    rng = random.Random(6)
    rows = []
    for c in range(6):
        said = []
        for t in range(40 if c else 700):
            text = f"statement {c} {t}" if rng.random() < 0.8 else "thanks"
            if said and rng.random() < 0.7:
                quote = rng.choice(said[-3:])
                text = "\n".join("> " + line for line in quote.split("\n")) + "\n\n" + text
            said.append(text)
            rows.append((c, t, rng.choice(["user", "assistant", None]), text))
    rows += [(None, 1, "user", "> thanks"), (9, None, "user", "> thanks"), (9, 1, "user", None), (9, 2, "user", ""), (9, 3, "user", "> nobody said"), (9, 3, "user", "> nobody said")]
    df = spark.createDataFrame([(*r, "b", "p") for r in rows], CHAT)
    found = chat.link(df).collect()
    assert sorted(map(tuple, found), key=str) == slow_links(rows)
    assert max(r["depth"] for r in found) > 8
    assert chat.link(df.limit(0)).count() == 0
    ordered = chat.in_reply_order(chat.link(df.where("conv_id = 1"))).collect()
    place = {r["turn"]: i for i, r in enumerate(ordered)}
    assert all(r["reply_to"] is None or place[r["reply_to"]] < place[r["turn"]] for r in ordered)


def test_chat_partial_quotes(spark):
    first = "The cat sat.  It purred\nloudly. Then it\nslept.\nGood night"
    rows = [
        (1, 0, first),
        (1, 1, "other words. It purred"),
        (1, 2, "> It purred loudly.\n\na sentence over two lines"),
        (1, 3, "> loudly. Then it\n> SLEPT.\n\nsome lines"),
        (1, 4, "A wrote:\n> The cat sat.  It purred\n> loudly. Then it\nanswered inside\n> slept.\n> Good night\nend"),
        (1, 5, "B wrote:\n> from outside\n\nkept"),
        (1, 6, "> Good night\n> never written\n\nhalf"),
        (1, 7, ">>> print(1)\n> answered inside\n\ncode"),
        (1, 8, "a one\nb two\nc three\nd four\ne five"),
        (1, 9, "b two\nc three"),
        (1, 10, "> x\n> b two\n> c three\n> d four\n\nlongest run, not the latest"),
        (1, 11, "> longest run, not the latest\n\nthrough"),
        (2, 1, "> It purred loudly.\n\nanother conversation"),
        (None, 1, "> The cat sat.\n\nno conversation"),
    ]
    df = spark.createDataFrame([(c, t, "user", text, "b", "p") for c, t, text in rows], CHAT)
    found = {(r["conv_id"], r["turn"]): r for r in chat.link(df, keep_unlinked=True).collect()}
    assert len(found) == len(rows)
    replies = {2: 0, 3: 0, 4: 0, 6: 0, 7: 4, 10: 8, 11: 10}
    assert {t: r["reply_to"] for (c, t), r in found.items() if c == 1} == {t: replies.get(t) for t in range(12)}
    assert (found[1, 7]["root"], found[1, 7]["depth"], found[1, 11]["root"], found[1, 11]["depth"]) == (0, 2, 8, 2)
    assert found[2, 1]["reply_to"] is None and found[None, 1]["reply_to"] is None
    body = {k: r["body"] for k, r in found.items()}
    assert body[1, 2] == "a sentence over two lines" and body[1, 3] == "some lines" and body[1, 4] == "answered inside\nend"
    assert body[1, 5] == rows[5][2] and body[1, 6] == rows[6][2] and body[1, 10] == rows[10][2]
    assert body[1, 7] == ">>> print(1)\n\ncode"
    assert body[2, 1] == rows[12][2] and body[None, 1] == rows[13][2]
    assert all(r["message"] == f"<|user|>\n{r['body']}\n<|end|>\n" for r in found.values())


def test_op8_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op8_chat_formatting(spark, sf).collect()), key=str) == slow_links(rows)
