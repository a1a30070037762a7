"""Each query over whole small tables against a plain version."""

import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def rows(spark, name):
    from tidemark.llm.queries import QUERIES

    return QUERIES[name](spark, SF).collect()


def test_token_ids(spark, docs):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in rows(spark, "op1_token_ids")}
    start = 0
    assert len(got) == len(docs)
    for d in sorted(docs):
        ids = [*tok.encode(docs[d] or "", add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), brute.ids_crc32(ids))
        start += len(ids)


def test_bpe(spark, docs):
    import public_tokenizers as p
    import tiktoken

    from tidemark.llm.bpe import load_ranks

    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=load_ranks(p.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in rows(spark, "op3_bpe")}
    assert len(got) == len(docs)
    for d, t in docs.items():
        ids = enc.encode_ordinary(t or "")
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or ""))


def test_simhash(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op5_simhash")}
    ids = sorted(docs)
    fps = [brute.simhash(docs[d]) for d in ids]
    want = brute.groups(ids, fps)
    assert {d: (got[d].fingerprint, got[d].component_id) for d in got} == {d: (f"{f:016x}", want[d]) for d, f in zip(ids, fps)}


def test_media(spark, docs):
    from tidemark.llm import media

    got = {r.doc_id: r for r in rows(spark, "op6_media")}
    assert len(got) == len(docs)
    by_text = {}
    for d, t in docs.items():
        raw = (t or "").encode()
        pad = raw + bytes((-len(raw)) % 64 if raw else 64)
        wav = media.wav_bytes(pad)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), brute.sha(pad), zlib.crc32(pad[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), brute.sha(wav))
        assert by_text.setdefault(t, r.feature) == r.feature
        assert int(r.feature.split(":")[0]) == brute.n_peaks(pad)
        if d % 10 == 0:
            times, hashes, _, loud = media.peak_pairs(wav)
            assert list(zip(times.tolist(), hashes.tolist())) == brute.peak_pairs(pad) and loud > 0


def test_quality_base(spark, docs):
    for r in rows(spark, "op7_quality"):
        want = brute.base_quality(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("name", ["op2_chat", "op7_quality"])
def test_sql(spark, name):
    from tidemark.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


def test_url_rules(spark):
    urls = dict(duckdb.execute(f"select page_id, url from '{SF}/pages.parquet'").fetchall())
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    for r in rows(spark, "op4_url_filters"):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == (max(fit)[1:] if fit else (None, r.verdict))
        assert r.verdict in ("allow", "block")


def test_language(spark, docs):
    langs = dict(duckdb.execute(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    got = rows(spark, "op10_language_id")
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.lang_pred in {*langs.values(), "und"} for r in got)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.9 * len(held)


def test_mixing(spark, docs):
    """Each document's topic, probability and draw against plain counts, distances and raking."""
    from tidemark.llm import mixing, topics

    source, lang = (dict(duckdb.execute(f"select doc_id, {c} from '{SF}/documents.parquet'").fetchall()) for c in ("source", "lang"))
    model = topics.fit(spark.read.parquet(f"{SF}/documents.parquet"), list(mixing.LANGS))
    assert set(model.centres) == set(mixing.LANGS)
    got = {r.doc_id: r for r in rows(spark, "op8_mixing")}
    assert len(got) == len(docs)
    topic = {}
    for d, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert got[d].tokens == len(words)
        x = brute.hashed(words, topics.DIMS)
        far = [((x - c) ** 2).sum() for c in model.centres[lang[d]]]
        topic[d] = got[d].topic if not words else f"{lang[d]}/{far.index(min(far))}"
    assert sum(got[d].topic == topic[d] for d in docs) >= len(docs) - 1  # a tie may be broken by rounding
    targets = mixing.document_targets(model)
    cell = {d: (source[d] if source[d] in targets["source"] else None, lang[d], got[d].topic if got[d].topic in targets["topic"] else None) for d in docs}
    want = brute.raked({d: (cell[d], got[d].tokens) for d in docs}, [targets["source"], targets["lang"], targets["topic"]], limits=(0,))
    for d in docs:
        assert abs(got[d].probability - want[d]) < 1e-5
        drawn = brute.draw(d)
        assert got[d].kept == (drawn < want[d]) or abs(drawn - want[d]) < 2e-5
    assert 0.3 * len(docs) < sum(r.kept for r in got.values()) < len(docs)


def test_language_is_the_smallest_of_plain_compressions(spark, docs):
    import zstandard

    from tidemark.llm import langid

    taught = spark.read.parquet(f"{SF}/documents.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    model = langid.fit(taught)
    kinds = zstandard.ZstdCompressionParameters.from_level(3, min_match=4, strategy=zstandard.STRATEGY_LAZY2, search_log=4, window_log=20, chain_log=16, hash_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
    made = [zstandard.ZstdCompressor(compression_params=kinds, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for c in model.contents]
    wrong = 0
    for r in rows(spark, "op10_language_id"):
        t = docs[r.doc_id]
        if t is None or not any(map(str.isalpha, t)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        data = (" " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " ").encode()
        sizes = [sum(len(m.compress(data[i : i + 8192])) for i in range(0, len(data), 8192)) for m in made]
        best = {x for x, n in zip(model.langs, sizes) if n == min(sizes)}
        wrong += r.lang_pred not in best
    assert wrong == 0


def test_warc_finds_damage(spark):
    from tidemark.llm import warc

    pages = duckdb.execute(f"select page_id, url, html from '{SF}/pages.parquet' where page_id % 97 = 5 and contains(html, 'e')").fetchall()
    found = rows(spark, "op9_warc")
    assert sorted((r.key, r.status) for r in found) == sorted((p, "changed") for p, *_ in pages)
    # place, start and size: of the records in order of the key, as all pages fit into one file here
    every = sorted(duckdb.execute(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall())
    made = spark.createDataFrame(every, "page_id long, url string, html string").select("page_id", F.octet_length(F.encode(warc.record(F.col("page_id"), F.col("url"), F.col("html")), "UTF-8")).alias("n"))
    at, want = 0, {}
    for place, (key, n) in enumerate(sorted(map(tuple, made.collect()))):
        want[key] = ("0-0", place, at, n + 4)
        at += n + 4
    assert {r.key: (r.file, r.place, r.start, r.size) for r in found} == {p: want[p] for p, *_ in pages}
