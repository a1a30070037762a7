"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; and operators against plain versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from . import brute

LONG = "the quick brown fox jumps over a lazy dog and runs \n" * 4000
TEXTS = [None, "", " ", "\n\t", "a", "a  b", " a b ", "don't  stop\u00a0now", "é" * 50, "😀 x", "\x1c \x85", LONG, "same text here", "same text here", "<|endoftext|> a", "x" * 30000, "a <|endoftext|> b", "\u0378 don't \u180e's"]
NAMES = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, ids string, host string, quality int, mix int, key string, c0 string, media string"


def table(spark, texts=TEXTS):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src1", 0, 9, 9, "x", "y", 1, 1, "k", "c", "m") for i, t in enumerate(texts)]
    if texts:
        rows += [rows[-1], (None, "no id", *rows[0][2:])]
    return spark.createDataFrame(rows, NAMES)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def path(spark):
    from tidemark.llm.common import new_path

    return new_path(spark, "test")


def test_token_ids(spark, docs, empty):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    from tidemark.llm import token_ids as ti

    tok = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id if r.doc_id is not None else -1, [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect())
    got = ti.roundtrip(docs, p.path("byte_bpe_50k.json"), path(spark), 2).collect()
    assert sorted((r.id if r.id is not None else -1, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert ti.roundtrip(empty, p.path("byte_bpe_50k.json"), path(spark), 2).count() == 0


def test_a_worker_asks_the_library_once_for_a_piece(monkeypatch):
    """250,000 words in two rounds of small texts: the second finds all of them known, and its ids are the same."""
    import public_tokenizers as p
    import pyarrow as pa

    from tidemark.llm import token_ids as ti

    monkeypatch.setattr(ti, "_CACHES", {})
    cache, _ = ti._tokenizer_cache(p.path("byte_bpe_50k.json"), False)
    asked, encode = [], cache.encode
    cache.encode = lambda new: asked.append(len(new)) or encode(new)
    signs = np.array(list("abcdefghij"))
    texts = ["".join(" q" + "".join(signs[[i // 10**k % 10 for k in range(6)]]) for i in range(a, a + 5000)) for a in range(0, 250_000, 5000)]
    once = [cache.ids(pa.array([t]))[0].tobytes() for t in texts]
    assert sum(asked) == 250_000
    assert [cache.ids(pa.array([t]))[0].tobytes() for t in texts] == once and sum(asked) == 250_000


@pytest.mark.parametrize("special_as_text", [False, True])
def test_cut_pieces_are_the_librarys(monkeypatch, special_as_text):
    """Every code point of the basic plane and of pictures, alone, doubled, after a space and between letters, and odd pieces among them: the library's ids, by calls for many pieces."""
    import public_tokenizers as p
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidemark.llm import token_ids as ti
    from tidemark.llm.pieces import one_class

    tok = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = special_as_text
    monkeypatch.setattr(ti, "_CACHES", {})
    cache, added = ti._tokenizer_cache(p.path("byte_bpe_50k.json"), special_as_text)
    assert added == ([] if special_as_text else ["<|endoftext|>"])
    signs = [chr(c) for c in (*range(0x10000), *range(0x1F000, 0x20000)) if not 0xD800 <= c < 0xE000]
    odd = ["don't", "''s", "'s's", "a" * 64, "b" * 65, "1" * 64, "é" * 64, "!?" * 40, "<|endoftext|>", " <|endoftext|>", "<|", "|>", "\n", "\r\n", " \n", "  ", "   x", "\x00\x01", "ab12", "12ab", "😀😀", "𝒜𝒜", "日本語"]
    new = [*odd, *signs, *(s + s for s in signs), *(" " + s for s in signs), *(f"a{s}b" for s in signs)]
    assert one_class(["a", " a", "12", " !?", "é日", "😀"]).all()
    assert not one_class(["", " ", "  ", "  a", "a b", "a1", "a!", "'s", "\n", " \n", "𝒜", "c" * 65]).any()
    want = [e.ids for e in tok.encode_batch_fast(new, add_special_tokens=False)]
    assert [np.frombuffer(b, cache.dtype).tolist() for b in cache.encode(new)] == want
    ids, counts = cache.ids(pa.array(new), np.array([any(t in s for t in added) for s in new]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_packed_codes_are_the_plain_bits():
    from tidemark.llm.token_ids import STEP, Code, code_lengths

    r = np.random.default_rng(3)
    for n, size in ((1, 1), (2, 64), (2, 128), (300, 5000), (60_000, 9001)):
        lengths = code_lengths(1 + (r.pareto(0.5, n) * 3).clip(0, 1e9).astype(np.int64))
        ids, code = r.integers(0, n, size), Code(lengths)
        order = np.lexsort((np.arange(n), lengths))
        plain, at, last = {}, 0, 0
        for i in order.tolist():  # codes of one length follow one another
            at <<= int(lengths[i]) - last
            last = int(lengths[i])
            plain[i] = f"{at:0{last}b}"
            at += 1
        words = [plain[i] for i in ids.tolist()]
        bits = "".join(words)
        data, offsets = code.pack(ids)
        assert data == int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8)
        ends = np.cumsum([len(w) for w in words])
        assert offsets.tolist() == [0, *ends[:-1].tolist()][::STEP]
        assert (code.unpack(data, offsets, size) == ids).all()


def test_bpe(spark, docs, empty):
    import public_tokenizers as p
    import tiktoken

    from tidemark.llm import bpe

    ranks = p.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.load_ranks(ranks), special_tokens={})
    e = bpe.encode(docs, ranks, p.PATTERN).cache()
    key = lambda r: (r.id is None, r.id)
    texts = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in sorted(e.collect(), key=key)] == [enc.encode_ordinary(r.text or "") for r in texts]
    assert [r.text for r in sorted(bpe.decode(e, ranks).collect(), key=key)] == [r.text or "" for r in texts]
    assert bpe.encode(empty, ranks, p.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_transducer_is_the_library(text):
    import public_tokenizers as p
    import tiktoken

    from tidemark.llm import bpe

    made = bpe.bpe(p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    global _ENC
    if "_ENC" not in globals():
        _ENC = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=made.machine.ranks, special_tokens={})
    ids = [i for m in made.matches(text) for i in made.machine.encode(m.encode())]
    assert ids == _ENC.encode_ordinary(text)
    streamed = [i for m in made.matches(text) for i in ([made.machine.ranks[m.encode()]] if m.encode() in made.machine.ranks else made.machine.stream(m.encode()))]
    assert streamed == ids
    assert "".join(made.decode(np.array(ids, np.uint32), portion=1)) == text


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=200), st.integers(8, 20))
def test_huffman_is_optimal_and_exact(counts, limit):
    import heapq

    from tidemark.llm.token_ids import Code, code_lengths

    n = np.array(counts)
    lengths = code_lengths(n, limit)
    assert lengths.max() <= limit and (len(n) == 1 or abs((0.5**lengths).sum() - 1) < 1e-9)
    if limit == 20 and len(n) > 1:
        heap, cost = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert cost <= int((n * lengths).sum()) <= cost * 1.02 + 1
    ids = np.random.default_rng(0).integers(0, len(n), 700)
    code = Code(lengths)
    data, at = code.pack(ids)
    assert (code.unpack(data, at, len(ids)) == ids).all()


def test_simhash_groups_with_hot_keys(spark):
    from tidemark.llm import simhash

    r = random.Random(2)
    centre = r.getrandbits(64)
    values = [centre]
    for _ in range(120):  # a dense cloud, chains, and far ones
        v = r.choice(values)
        for b in r.sample(range(64), r.randint(1, 6)):
            v ^= 1 << b
        values.append(v)
    values += [r.getrandbits(64) for _ in range(40)] + [0, 15, 31]
    want = brute.groups(list(range(len(values))), values)
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(signed, "id long, fp long")
    back = dict((f, i) for i, f in signed)
    for hot, blocks in ((3, None), (10**6, None), (10**6, 8)):
        roots = {x.node: x.root for x in simhash.components(simhash.links(df, hot, blocks)).collect()}
        parts = {}
        for f, i in back.items():
            parts.setdefault(roots.get(f, f), []).append(i)
        assert sorted(map(sorted, parts.values())) == sorted(sorted(i for i in set(back.values()) if want[i] == k) for k in {want[i] for i in set(back.values())})


def test_simhash_block_numbers():
    from tidemark.llm import simhash

    for rows in (0, 1, 10**6, 1 << 25, 1 << 30, 1 << 36, 1 << 45):
        spans = simhash._blocks(simhash.blocks_for(rows))
        assert [a + w for a, w in spans] == [a for a, _ in spans[1:]] + [64]
    assert [simhash.blocks_for(1 << n) for n in (10, 24, 25, 45)] == [7, 7, 8, 8]


def test_simhash_edges(spark, docs, empty):
    from tidemark.llm import simhash

    got = simhash.near_duplicates(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(TEXTS) + 2
    assert all((r.fp & (2**64 - 1)) == brute.simhash(text[r.doc_id]) for r in got)
    by = {r.doc_id: r.component_id for r in got}
    assert by[0] == by[1] == by[2] == by[3] == 0 and by[13] == 12
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(empty).count() == 0


def test_chat(spark):
    from tidemark.llm import chat

    r = random.Random(1)
    bits = ["###", "#", "\\", "</turn>", "<\\/turn>", "### assistant:", "\n", "a", "é", ":", "<", "</turn", ""]
    odd = lambda: "".join(r.choice(bits) for _ in range(r.randint(0, 8)))
    rows = [(r.randint(0, 6), r.randint(0, 3), r.choice(["user", "assistant", None, "a:b\n###"]), r.choice([None, odd(), odd()]), 1) for _ in range(120)] + [(None, None, None, None, 1), (7, 0, "assistant", LONG * 8, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    got = {x.conv_id: x for x in chat.digests(chat.format_chat(df)).collect()}
    order = lambda v: (v is not None, v if v is not None else 0)
    word = lambda v: (v is not None, (v or "").encode())
    for c in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (order(x[1]), word(x[2]), word(x[3])))
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), brute.sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), brute.sha(loss))
    assert chat.format_chat(df.limit(0)).count() == 0 and chat.digests(chat.format_chat(df.limit(0))).count() == 0


def test_media(spark, docs, empty):
    from tidemark.llm import media

    m = docs.select("doc_id", media.to_wav(media.padded(F.col("text"))).alias("w"))
    got = m.select("doc_id", "w", media.samples(F.col("w")).alias("s"), media.fingerprint(F.col("w")).alias("p")).collect()
    assert all(len(r.s) % 64 == 0 and len(r.s) >= 64 and media.wav_bytes(bytes(r.s)) == bytes(r.w) for r in got)
    assert all(len(r.p.times) == len(r.p.hashes) for r in got)
    tone = (128 + 100 * np.sin(np.arange(8000) * 2 * np.pi * 20 / media.SIZE) * (np.arange(8000) // 1000 % 2)).astype(np.uint8).tobytes()
    t, h, n, _ = media.peak_pairs(media.wav_bytes(tone))
    assert n > 0 and (h >> 16 == 20).any()
    # the last bytes of a payload lie inside a frame
    for size in (64, 256, 320, 384, 1 << 18):
        body = bytes(range(1, 65)) * (size // 64)
        assert media.peak_pairs(media.wav_bytes(body))[3] != media.peak_pairs(media.wav_bytes(body[:-1] + b"z"))[3]
        assert sum(len(e) for e in media._spectra(media.wav_bytes(body))) == max(0, (size + media.HOP - media.SIZE) // media.HOP + 1) + 1
        assert media.peak_pairs(media.wav_bytes(body))[3] != media.peak_pairs(media.wav_bytes(b"z" + body[1:]))[3]
    odd = spark.createDataFrame([(None,), (b"no wav",)], "w binary").select(media.fingerprint(F.col("w")).alias("p"), media.to_wav(F.lit(None).cast("binary")).alias("n")).collect()
    assert all(r.p is None or r.p.times is None for r in odd) and all(r.n is None for r in odd)


def test_quality(spark, docs, empty):
    from tidemark.llm import quality

    for r in quality.judge(docs, into="q").collect():
        assert (r.q.n_words, r.q.word_chars, r.q.n_symbols, r.q.n_dup_lines, r.q.n_repeat_words) == brute.base_quality(r.text)
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(empty).count() == 0


def test_language(spark, docs, empty):
    from tidemark.llm import langid

    none = langid.fit(empty)
    assert none.langs == ()
    assert {r.g.lang_pred for r in docs.select(langid.identify(F.col("text"), none).alias("g")).collect()} == {"und"}
    train = spark.createDataFrame([(f"the cat and the dog are in the house number {i} of that street", "en") for i in range(60)] + [(f"der hund und die katze sind in dem haus nummer {i} von dieser straße", "de") for i in range(60)] + [("x", None), (None, "fr")], "text string, lang string")
    model = langid.fit(train)
    assert model.langs == ("de", "en")
    test = spark.createDataFrame([("the dog and the cat in that street", "en"), ("die katze und der hund in dieser straße", "de"), ("123 !", "und"), (None, "und"), ("", "und")], "text string, want string")
    for r in test.select("want", langid.identify(F.col("text"), model).alias("g")).collect():
        assert r.g.lang_pred == r.want and 0 <= r.g.score <= 1
    assert langid.accepted(docs, model).columns == docs.columns


def test_mixing(spark, docs, empty):
    from tidemark.llm import mixing

    tokens = np.array([10.0, 30.0, 20.0, 40.0])
    f = mixing.rake(tokens, [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([0.5, 0.5]), np.array([0.3, 0.7])])
    w = tokens * f / (tokens * f).sum()
    assert abs(w[:2].sum() - 0.5) < 1e-6 and abs(w[[0, 2]].sum() - 0.3) < 1e-6
    out = mixing.mix(*mixing.documents(docs)).collect()
    assert len(out) == len(TEXTS) + 2 and all(0 <= r.mix.probability <= 1 for r in out)
    assert all(r.mix.tokens == len((r.text or "").encode().split()) for r in out)
    assert mixing.sample(*mixing.documents(empty)).count() == 0


def test_urls(spark):
    from tidemark.llm import urlfilter

    rows = [(i, f"http://A.net/blog/item{i}x/{i}", 1 if i % 10 else 0) for i in range(60)] + [(100 + i, f"https://a.net/spam/offer{i}y", 0) for i in range(60)] + [(200, None, None), (201, "no scheme", 1), (202, "x://", None), (203, "http://h", None), (204, "http://h/" + "d/" * 30, 1), (None, "http://h/", 1), (205, "HTTP://Sub.Example.ORG/es/1?q", None), (206, "http://example.com/fr/é#x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, label long").withColumn("verdict", F.lit("own"))
    labels = pages.where("label is not null").select(F.col("page_id").alias("doc_id"), F.col("label").alias("quality"))
    got = {r.page_id: r for r in urlfilter.judge(pages, labels, key=F.col("page_id")).collect()}
    assert len(got) == len({r[0] for r in rows})
    assert got[1].template == "blog/*/{n}" and got[1].verdict == "allow"
    assert got[101].template == "spam/*" and got[101].verdict == "block"
    assert (got[200].host, got[200].path, got[202].host) == ("", "", "") and got[204].template == "/".join(["d"] * 30)
    assert (got[205].rule, got[205].verdict) == ("example.org/es/", "block") and got[206].rule == "com/fr/"
    assert urlfilter.judge(pages.limit(0), labels.limit(0), key=F.col("page_id")).count() == 0


def test_url_tree_blocks_a_bad_branch_and_merges_alike_ones(spark):
    from tidemark.llm import urlfilter

    good = {"news": 10, "sport": 10, "arts": 9, "junk": 1, "rare": 2}
    rows = [(i, f"http://h.net/{b}/deep/{i}", int(i % 10 < good[b])) for k, b in enumerate(good) for i in range(1000 * k, 1000 * k + (2 if b == "rare" else 40))]
    rows += [(9000 + i, f"http://h.net/users/name{i}x/page", 1) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, label long")
    labels = pages.select(F.col("page_id").alias("doc_id"), F.col("label").alias("quality"))
    got = {r.url.split("/")[3]: (r.template, r.verdict) for r in urlfilter.judge(pages, labels, key=F.col("page_id")).collect()}
    assert got["junk"][1] == "block" and {got[b][1] for b in got if b != "junk"} == {"allow"}
    assert got["news"][0] == got["sport"][0] and got["news"][0].startswith("+") and got["junk"][0] == "junk/deep/{n}"
    assert got["users"][0].endswith("*/page") and got["rare"][0] == "rare/deep/{n}"


@given(st.text("#\\<>/turn: A\n", max_size=40))
@settings(max_examples=300, deadline=None)
def test_no_mark_is_left_in_an_escaped_text(text):
    import pyarrow as pa

    from tidemark.llm import chat

    out = chat.escape_array(pa.array([text])).to_pylist()[0]
    assert "###" not in out and "</turn>" not in out and chat.unescape(out) == text


def test_bpe_states_are_bounded_within_a_match():
    import random

    import public_tokenizers as p

    from tidemark.llm.bpe import Transducer, load_ranks

    ranks = load_ranks(p.path("byte_bpe_50k.tiktoken"))
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=6000)).encode()
    small, large = Transducer(ranks, max_states=300), Transducer(ranks)
    want = large.encode(text)
    assert len(large.states) > 1000 and small.encode(text) == want == large.merge(text) and len(small.states) <= 302
    assert list(small.stream(text)) == want and len(small.states) <= 302 and small.encode(b"hello") == large.encode(b"hello")


def test_bpe_that_shares_memory_keeps_little(spark):
    """A released worker holds few states and pieces and short portions of texts, with the same ids."""
    from zlib import crc32

    import public_tokenizers as p

    from tidemark.llm import bpe

    draw = random.Random(3)
    words = [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30000)) for _ in range(8)]
    texts = spark.createDataFrame(list(enumerate([*words, "\n".join(words[:5]), None])), "doc_id long, text string").coalesce(1)

    def held(made, ids):
        return str(len(made.machine.states)), str(len(made.cache.known) + len(made.cache.older)), str(crc32(ids.tobytes()))

    def run(release):
        rows = bpe.encode(texts, p.path("byte_bpe_50k.tiktoken"), p.PATTERN, columns="states string, pieces string, ids string", of=held, release=release).collect()
        return {r.id: (r.n_tokens, r.ids) for r in rows}, max(int(r.states) for r in rows), max(int(r.pieces) for r in rows)

    ids, states, pieces = run(True)
    assert states <= bpe.SMALL_STATES + 1 and pieces <= 2 * (bpe.SMALL_PIECES + bpe.SMALL_BYTES // 7 + 1)
    assert ids == run(False)[0] and ids[9][0] == 0


def test_url_siblings_from_bad_to_good_are_no_chain(spark):
    """20 siblings with 60 labels each whose good share rises from 0 to 95 %: poor ones are blocked, good ones stay."""
    from tidemark.llm import urlfilter

    rows = [(k * 60 + i, f"http://h.net/b{k:02}q/{i}", int(i < 3 * k)) for k in range(20) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, label long")
    got = {}
    for r in urlfilter.judge(pages, pages.select(F.col("page_id").alias("doc_id"), F.col("label").alias("quality")), key=F.col("page_id")).collect():
        got.setdefault((r.template, r.verdict), set()).add(int(r.path[2:4]))
    blocked = {k for (_, v), ks in got.items() for k in ks if v == "block"}
    assert blocked >= set(range(5)) and not blocked & set(range(9, 20)) and len(got) >= 5
    assert all(max(ks) - min(ks) <= 5 for ks in got.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_url_tree_against_a_plain_one(spark, seed):
    import random

    from tidemark.llm import urlfilter

    rng, rows = random.Random(seed), []
    for h in ("a.net", "b.net", "c.net"):
        rate = {}
        for _ in range(500):
            segments = [rng.choice("uvwxyz") + "q" for _ in range(rng.randint(0, 3))]
            if segments[:1] == ["uq"] or rng.random() < 0.1:
                segments.insert(min(1, len(segments)), f"slug{rng.randrange(90)}x")
            if rng.random() < 0.05:
                segments += ["deep"] * 14 + [rng.choice(["k", "l"])]
            p = rate.setdefault(tuple(segments[:2]), rng.choice([0.05, 0.3, 0.6, 0.95]))
            rows.append((h, tuple(segments), float(rng.random() < p) if rng.random() < 0.8 else None))
    df = spark.createDataFrame([(h, list(s), x) for h, s, x in rows], "host string, sig array<string>, label double")
    got = {(r.host, tuple(r.sig)): ("/".join(r.template), round(r.purity, 9), r.verdict) for r in urlfilter.templates(df).collect()}
    want = brute.url_tree(rows)
    assert got == want and {v for *_, v in want.values()} == {"allow", "block"} and any("*" in t for t, *_ in want.values())


def warc_nodes(spark, recs, plan):
    from tidemark.llm import warc

    where = path(spark)
    warc.write(recs, plan, where)
    return where, warc.nodes(spark, where).cache()


def test_merkle(spark):
    import glob
    import gzip
    import hashlib
    import re

    from tidemark.llm import warc

    rows = [(i, f"http://x/{i}", None if i % 50 == 0 else "p\r\n\r\n" * (i % 7)) for i in range(700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("own"))
    a = warc.records(pages, "page_id", "url", "html")
    plan = warc.layout(a, 20_000)
    where, first = warc_nodes(spark, a, plan)
    assert 5 < plan.n < 30 and plan.crowded.count() == 0 and first.select("file").distinct().count() == plan.n and warc.audit(first, first).count() == 0
    # the stored bytes, by themselves: places, starts, sizes and hashes of all records
    leaves = {(r.file, r.place): r for r in first.where("level = 0").collect()}
    found = 0
    for name in glob.glob(f"{where}/*/*.gz"):
        data, at, place = gzip.open(name).read(), 0, 0
        file = re.search("file=([^/]*)/", name)[1]
        while at < len(data):
            head = data.index(b"\r\n\r\n", at)
            size = head + 8 + int(re.search(rb"Content-Length: (\d+)", data[at:head])[1]) - at
            own = data[at : at + size]
            key = int(re.search(rb"X-Page-Key: (\d+)", own)[1])
            assert own.startswith(b"WARC/1.1\r\n") and own.endswith(b"\r\n\r\n") and (rows[key][2] or "").encode() == data[head + 4 : at + size - 4]
            leaf = leaves[file, place]
            assert (leaf.key, leaf.start, leaf.size) == (key, at, size)
            assert leaf.hash == hashlib.sha256(f"{at}:{size}:{hashlib.sha256(own).hexdigest()}".encode()).hexdigest()
            at, place, found = at + size, place + 1, found + 1
    assert found == len(leaves) == 700
    # same length, another byte: only that record; a lost record moves all after it in its file
    _, changed = warc_nodes(spark, warc.records(pages.withColumn("html", F.when(F.col("page_id") == 13, F.lit("q" * 30)).otherwise(F.col("html"))), "page_id", "url", "html"), plan)
    assert [(r.key, r.status) for r in warc.audit(first, changed).collect()] == [(13, "changed")]
    at = next(r for r in leaves.values() if r.key == 598)
    later = sorted(r.place for r in leaves.values() if r.file == at.file and r.place >= at.place)
    _, lost = warc_nodes(spark, a.where("key <> 598"), plan)
    got = warc.audit(first, lost).collect()
    assert sorted((r.place, r.status) for r in got) == [(p, "changed") for p in later[:-1]] + [(later[-1], "missing")] and {r.file for r in got} == {at.file}
    _, none = warc_nodes(spark, a.limit(0), plan)
    assert warc.audit(none, none).count() == 0 and warc.audit(none, first).where("status = 'extra'").count() == 700


def test_merkle_of_a_key_that_many_pages_have(spark):
    from tidemark.llm import warc

    rows = [(7, "http://x/7", "same")] * 120 + [(7, f"http://x/7?{i}", f"other {i}") for i in range(60)] + [(None, f"http://n/{i}", None) for i in range(3)] + [(None, None, "x")]
    a = warc.records(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html")
    plan = warc.layout(a, 3200)
    assert [r["files"] > 10 for r in plan.crowded.collect()] == [True]
    _, one = warc_nodes(spark, a, plan)
    _, two = warc_nodes(spark, a, plan)
    sizes = [r["count"] for r in one.where("level = 0").groupBy("file").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 40 and warc.audit(one, two).count() == 0
    _, less = warc_nodes(spark, a.where("uri is null or uri <> 'http://x/7?5'"), plan)
    assert warc.audit(one, less).where("status = 'missing'").count() == 1


@pytest.mark.parametrize("key", ["xxhash64(i)", "case when i % 3 = 0 then null else i end", "cast(null as long)", "7L"])
def test_files_of_any_keys_are_about_as_large(spark, key):
    from tidemark.llm import warc

    pages = spark.range(1000).withColumnRenamed("id", "i").selectExpr(f"{key} as page_id", "concat('http://x/', i) as url", "repeat('x', 700) as html")
    a = warc.records(pages, "page_id", "url", "html")
    _, nodes = warc_nodes(spark, a, warc.layout(a, 50_000))
    sizes = [r["count"] for r in nodes.where("level = 0").groupBy("file").count().collect()]
    assert sum(sizes) == 1000 and 15 < len(sizes) <= 21 and max(sizes) < 120


def test_bytes_that_are_no_record(spark):
    from tidemark.llm import warc

    good = b"WARC/1.1\r\nX: y\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert list(warc.walk(good * 2)) == [(None, 0, len(good)), (None, len(good), len(good))]
    assert list(warc.walk(good + b"rubbish")) == [(None, 0, len(good)), (None, len(good), 7)]
    assert list(warc.walk(good[:-5])) == [(None, 0, len(good) - 5)] and list(warc.walk(b"")) == []


def test_pipeline(spark):
    import duckdb

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        if name != "bpe_encoding":
            assert out.columns == docs.columns
        seen.append({r.doc_id for r in out.collect()})
        docs = out
    assert all(b <= a for a, b in zip(seen, seen[1:]))
    text = dict(duckdb.execute(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    good = [r[0] for r in duckdb.execute(f"select doc_id from '{sf}/labels.parquet' where quality = 1").fetchall()]
    fine = {d for d in good if (q := brute.base_quality(text[d]))[0] >= 20 and 100 * q[4] <= 30 * q[0]}
    assert fine <= seen[0]  # clean documents stay
    assert len(fine & seen[1]) >= 0.98 * len(fine & seen[0])
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert ids == seen[4] == seen[3]
    # an empty table goes through
    void = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        void = stage(spark, void, sf)
    assert void.count() == 0


def test_similar_groups_find_every_pair(spark):
    import duckdb

    from tidemark.llm import simhash

    rows = duckdb.execute("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    sets = {d: set(simhash.shingle_set(t).tolist()) for d, t in rows}
    r = random.Random(4)
    base = rows[3][1].split()
    for k in range(60):  # a crowd of near copies of one text
        w = list(base)
        for _ in range(3):
            w[r.randrange(len(w))] = f"w{k}{r.random()}"
        rows.append((100_000 + k, " ".join(w)))
        sets[100_000 + k] = set(simhash.shingle_set(rows[-1][1]).tolist())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    by = {}
    for d, s in sets.items():
        for h in s or {None}:
            by.setdefault(h, []).append(d)
    seen = {(a, b) for ds in by.values() for i, a in enumerate(ds) for b in ds[:i]}
    for a, b in seen:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: root(d) for d in sets}


def stars(count, seed=4, words=300, changed=6):
    """A text and copies of it: each is similar to the text (0.8 or more), but not to the other copies."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = [(0, " ".join(base))]
    for k in range(1, count + 1):
        w = list(base)
        for i in range(changed):
            w[3 + i * (words // changed) + r.randrange(words // changed - 4)] = f"w{k}x{i}"
        rows.append((k, " ".join(w)))
    return rows


def test_similar_groups_of_a_star(spark):
    from tidemark.llm import simhash

    rows = stars(1200)
    sets = [set(simhash.shingle_set(t).tolist()) for _, t in rows[:200]]
    assert min(len(sets[0] & s) / len(sets[0] | s) for s in sets) >= 0.8
    assert sorted(len(a & b) / len(a | b) for i, a in enumerate(sets[1:]) for b in sets[1 : i + 1])[5000] < 0.8
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1201 and {x.component_id for x in got} == {0}


def test_similar_groups_without_the_cheap_links(spark, monkeypatch):
    """The prefixes alone find every pair, in salted keys and with common shingles put last."""
    from tidemark.llm import simhash

    monkeypatch.setattr(simhash, "CROWD", 1)
    monkeypatch.setattr(simhash, "LEADERS", 1)
    monkeypatch.setattr(simhash, "sketch", lambda hashes: np.frombuffer(hashes.tobytes() + bytes(8), np.int64)[:1])
    rows = stars(70) + [(1000 + i, t) for i, t in stars(70, 9, 120, 2)] + [(2000, ""), (2001, None), (2002, "b1 b2 b3")]
    sets = {d: set(simhash.shingle_set(t).tolist()) for d, t in rows}
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = group[a], group[b]
                group = {d: min(x, y) if g in (x, y) else g for d, g in group.items()}
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == group


def test_parity_bitmaps_differ_no_more_than_their_sets():
    from tidemark.llm import simhash

    r = np.random.default_rng(8)
    for n in (0, 1, 7, 200, 3000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for changed in (0, 1, n // 9, n // 2, n):
            b = np.unique(np.concatenate([a[changed:], r.integers(0, 1 << 63, changed).astype(np.uint64)]))
            bits = sum((int(x) ^ int(y)).bit_count() for x, y in zip(simhash.parity(a).view(np.uint64), simhash.parity(b).view(np.uint64)))
            most = len(np.setxor1d(a, b))
            assert bits <= most and bits % 2 == most % 2
    assert len(simhash.parity(np.zeros(0, np.uint64))) == simhash.PARITY // 64


def test_some_part_of_similar_sets_is_as_similar():
    """Sets around the sizes where the number of parts changes meet in a key, with sizes, places and bitmaps that pass."""
    from tidemark.llm import simhash

    r = np.random.default_rng(5)
    common = np.zeros(0, np.uint64)
    for n in (1, 5, 400, 511, 513, 600, 1025, 1300, 5000):
        for share in (0.8, 0.83, 0.9, 1.0):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            b = a[: int(np.ceil(share * n))]
            assert len(b) / len(a) >= 0.8
            rows = []
            for x in (a, b):
                keys, slots, at, sizes, bits = simhash.parts(x, common, 0.8)
                assert sum(sizes) == len(x) * len(simhash.part_numbers(len(x), 0.8))
                rows.append({int(k): (int(sizes[s]), int(p), bits[s].view(np.uint64)) for k, s, p in zip(keys, slots, at)})
            good = 0
            for k in rows[0].keys() & rows[1].keys():
                (na, ia, ba), (nb, ib, bb) = rows[0][k], rows[1][k]
                differ = sum((int(u) ^ int(v)).bit_count() for u, v in zip(ba, bb))
                good += min(na, nb) >= 0.8 * max(na, nb) - 1e-6 and min(na - ia, nb - ib) * 1.8 >= 0.8 * (na + nb) - 1e-6 and differ * 1.8 <= 0.2 * (na + nb) + 1e-6
            assert good


def test_similar_groups_of_long_texts(spark, monkeypatch):
    """Sets of several parts, without the cheap links."""
    from tidemark.llm import simhash

    monkeypatch.setattr(simhash, "sketch", lambda hashes: np.frombuffer(hashes.tobytes() + bytes(8), np.int64)[:1])
    rows = stars(20, 3, 1100, 20) + [(1000 + i, t) for i, t in stars(20, 9, 2300, 44)] + [(2000 + k, " ".join(f"b{i}" for i in range(n))) for k, n in enumerate((850, 900, 1000, 1400))]
    sets = {d: set(simhash.shingle_set(t).tolist()) for d, t in rows}
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = {d: min(x, y) if g in (x, y) else g for d, g in group.items()}
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == group


def test_long_clean_texts_stay(spark):
    """The margin doesn't fall with the length, and no number of words is too many."""
    from tidemark.llm import langid, quality

    r = random.Random(5)
    words = {x: ["".join(r.choice(signs) for _ in range(r.randint(2, 9))) for _ in range(3000)] for x, signs in (("en", "aeiouthnsrdlw"), ("de", "aeiuchnsrdgbzk"))}
    weights = [1 / (i + 5) for i in range(3000)]
    text = lambda lang, n: " ".join(r.choices(words[lang], weights, k=n))
    model = langid.fit(spark.createDataFrame([(text(x, 250), x) for x in words for _ in range(60)], "text string, lang string"))
    made = langid._encoders(model)
    for x in words:
        short, long = made.predict(text(x, 300)), made.predict(text(x, 700_000))
        assert short[0] == long[0] == x and long[2] > 0.5 * short[2] > langid.MARGIN
    # over a million words, none of them a repeat of a passage
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000_100)), lambda i: F.when(i % 9 == 0, "the").otherwise(F.translate(i.cast("string"), "0123456789", "abcdefghij"))), " ").alias("text"))
    assert quality.keep_good(long).count() == 1


def test_quality_of_other_languages(spark):
    """Clean texts whose language has no list of stop words stay; a listed language is held to its own."""
    from tidemark.llm import quality

    russian = "Вчера вечером мы долго гуляли по старому городу и смотрели на реку, а потом зашли в маленькое кафе около площади, где пили чай."
    polish = "Wczoraj wieczorem długo spacerowaliśmy po starym mieście, patrzyliśmy na rzekę, potem wstąpiliśmy do małej kawiarni przy rynku, gdzie piliśmy herbatę przed snem."
    soup = "kfjd lkwe poqi mnzb xcvo weir alsk djfh gqpw oeir utyz mxnc bvla ksjd hfgp qowi eury tmzn xbcv alsk djfg hpqo wieu ryt"
    rows = [(1, russian, "ru"), (2, russian, None), (3, polish, "pl"), (4, soup, "en"), (5, soup, "xx"), (6, None, "en"), (7, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {1, 2, 3, 5}
    assert quality.keep_good(df.drop("lang")).columns == ["doc_id", "text"] and quality.keep_good(df.limit(0)).count() == 0


@pytest.mark.parametrize("odd", ["plain", "long"])
def test_pipeline_of_odd_rows(spark, odd):
    """All five stages over nulls, empty and very long texts, copies, repeated ids and extra columns."""
    import corpus_pipeline

    r = random.Random(8)
    words = {"en": "the of and to in is house water river stone".split(), "de": "der die das und ist haus wasser fluss stein nicht".split()}
    text = lambda lang, n: " ".join(r.choice(words[lang]) + (str(r.randrange(99)) if r.random() < 0.5 else "") for _ in range(n)) + "."
    rows = [(i, text(lang, 60), lang if i % 5 else None, f"src{i % 3}" if i % 7 else None) for i, lang in enumerate(["en", "de"] * 40)]
    rows += [(100, None, None, None), (101, "", "en", "src1"), (102, " \n", None, None), (None, text("en", 60), "en", None), rows[3], (103, rows[4][1], "en", "src2")]
    if odd == "long":
        rows += [(104, text("de", 60_000), "de", "src1")]
    docs = spark.createDataFrame([(*x, len(x[1] or ""), 1, "k") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, key long, quality string")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "").cache()
        assert name == "bpe_encoding" or out.columns == before.columns
        docs = out
        if name == "simhash_dedup":
            kept = [x.doc_id for x in out.collect()]
            # of each group of copies the smallest id, with all its rows; a row without an id stays where it is alone
            assert sorted(map(str, kept)) == sorted(map(str, [*set(kept), 3])) and {3, 4, None} <= set(kept) and not {100, 101, 102, 103} & set(kept) and (odd == "plain" or 104 in kept)
    assert {x.doc_id for x in docs.collect()} <= set(kept)


def test_mixing_keeps_languages_without_a_target(spark):
    from tidemark.llm import langid, mixing

    langs = ["en"] * 11 + ["de"] * 3 + ["fr"] * 3 + ["es"] * 3 + ["it", None]
    rows = [(i, "some plain words of a text", langs[i % 22], "src0" if i % 20 == 7 else "src9") for i in range(4400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marked, targets, values, tokens = mixing.documents(df)
    out = mixing.mix(marked, targets, values, tokens).collect()
    rest = [r for r in out if r.lang in (None, "it")]
    assert len(rest) == 400 and min(r.mix.probability for r in rest) > 0.3, min(r.mix.probability for r in rest)
    # src0 has 5 % of the words, less than its limit: nothing is taken from the other sources for it
    assert min(r.mix.probability for r in out) > 0.5 and sum(r.mix.kept for r in out) > 0.7 * len(out)
    hot = mixing.shares([0.15], np.array([0.4, 0.6]), True)
    assert np.allclose(hot, [0.15, 0.85]) and np.allclose(mixing.shares([0.5, 0.5], np.array([0.6, 0.2, 0.2]), False), [0.4, 0.4, 0.2])
    model = langid.fit(spark.createDataFrame([(f"the cat and the dog are in the house number {i} of that street", "en") for i in range(60)] + [(f"der hund und die katze sind in dem haus nummer {i} von dieser straße", "de") for i in range(60)], "text string, lang string"))
    filled = langid.accepted(spark.createDataFrame([(1, "the dog and the cat in that street", None), (2, "die katze und der hund in dieser straße", "nl")], "doc_id long, text string, lang string"), model, fill="lang").collect()
    assert sorted((r.doc_id, r.lang) for r in filled) == [(1, "en"), (2, "nl")]


def test_language_made_of_copies_is_learned(spark):
    from tidemark.llm import langid

    copies = spark.range(50_000).select(F.concat(F.lit("il gatto e il cane sono nella casa numero "), F.array(*(F.lit(f"x{chr(97 + i)}y") for i in range(3)))[(F.col("id") % 3).cast("int")]).alias("text"), F.lit("it").alias("lang"))
    other = spark.createDataFrame([(f"the cat and the dog are in the house number {i} of that street", "en") for i in range(60)], "text string, lang string")
    model = langid.fit(copies.unionByName(other))
    assert model.langs == ("en", "it") and model.contents[1].count(b"gatto") == 3


def test_topics_and_their_shares_are_of_all_texts(spark, monkeypatch):
    """Also where the sample to begin with is too small to know the shares."""
    import pyarrow as pa

    from tidemark.llm import topics

    monkeypatch.setattr(topics, "SAMPLE", 12)
    words = ["sea ship sail wave port", "court law judge claim appeal", "bread milk oven flour salt"]
    rows = [(" ".join(rng.split()[(i * 7 + j * j) % 5] for j in range(25 + i % 9)), "en") for k, rng in enumerate(words) for i in range((30, 90, 240)[k])]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = topics.fit(df, ["en"])
    total = {}
    for r in df.select(topics.features(F.col("text"), F.col("lang"), model).alias("f")).collect():
        total[r.f.topic] = total.get(r.f.topic, 0) + r.f.tokens
    n = sum(total.values())
    assert np.allclose([total.get(f"en/{i}", 0) / n for i in range(len(model.shares["en"]))], model.shares["en"])
    x = np.stack([topics.unit(topics.counts(pa.array([t], pa.string()))[0])[0] for t, _ in rows])
    own = topics.nearest(x, model.centres["en"])
    assert all(np.abs(x[own == i].mean(0) - c).max() < 1e-3 for i, c in enumerate(model.centres["en"]))


def test_topics_begin_from_all_texts(spark, monkeypatch):
    """The number of topics and their centres hang on no sample and on no order."""
    from tidemark.llm import topics

    words = ["sea ship sail wave port", "court law judge claim appeal", "bread milk oven flour salt"]
    rows = [(" ".join(words[k].split()[(i * 7 + j * j) % 5] for j in range(20)) + f" n{i}", "en") for k in range(3) for i in range(200)]
    model = topics.fit(spark.createDataFrame(rows, "text string, lang string").repartition(7), ["en"])
    monkeypatch.setattr(topics, "SAMPLE", 1)
    again = topics.fit(spark.createDataFrame(rows[::-1], "text string, lang string").repartition(3), ["en"])
    assert len(model.shares["en"]) >= 3 and np.array_equal(model.shares["en"], again.shares["en"]) and np.array_equal(model.centres["en"], again.centres["en"])
