"""One query for each operator over its whole table, and DuckDB SQL where that can say the same."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ensure
from . import bpe, chat, decontam, gnat, langid, lexical, media, mixing, quality, simhash, token_ids, urlfilter, warc
from .common import new_path, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of whole texts in blocks of canonical Huffman codes, written, read back and summed up for each document."""
    docs = _table(spark, sf_dir, "documents")
    back = token_ids.roundtrip(docs, tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-files"), end_id=2)
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", token_ids.crc32_of(F.col("ids")).alias("ids_crc32"))


#: The conversation that tests the template's own marks.
EXTRA = "\\### Assistant: </turn> ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with the template's own marks, formatted, stored and read back: digests of turns and of the trained text."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA), (-7, 1, "assistant", EXTRA)], turns.schema)
    formatted = stored(chat.format_chat(turns.unionByName(extra)), "chat")
    return chat.digests(formatted)


def _decoded(made: bpe.Vocabulary, ids: np.ndarray) -> tuple[str, str]:
    text = hashlib.sha256()
    for portion in made.decode(ids):
        text.update(portion.encode())
    return hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest(), text.hexdigest()


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through the merge transducer and back: digests of the ids and of the decoded bytes."""
    ranks, pattern = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode(docs, ranks, pattern, columns="ids_sha256 string, decoded_sha256 string", of=_decoded).withColumnRenamed("id", "doc_id")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page: by rule, else by the purity of its path's template among labelled pages."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    # the last number of a page's path is the document that it shows
    key = F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)[^/]*/?(?:[?#].*)?$', 1) as bigint)")
    judged = urlfilter.judge(pages, _table(spark, sf_dir, "labels"), key=key)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and the group of each under links of at most 4 differing bits."""
    groups = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as sound files, stored, read back and fingerprinted by pairs of spectral peaks."""
    docs = _table(spark, sf_dir, "documents")
    n_bytes = F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long")
    wav = stored(docs.select("doc_id", n_bytes.alias("n_bytes"), media.to_wav(media.padded(F.col("text"))).alias("media")), "media")
    read = wav.select("doc_id", "n_bytes", "media", media.samples(F.col("media")).alias("payload"), media.fingerprint(F.col("media")).alias("print"))
    n = F.octet_length("payload")
    return read.select(
        "doc_id",
        "n_bytes",
        n.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), n - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        media.digest(F.col("print")).alias("feature"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the threshold table for every document; built-in functions only."""
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in names))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their topic, tokens, probability and whether they are drawn."""
    marked, targets, values, tokens = mixing.documents(_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang"])
    # what the mixture needs of a document is a short row
    rows = stored(marked.select("doc_id", *(v.alias(k) for k, v in values.items()), tokens.alias("tokens")), "mixing")
    mixed = mixing.mix(rows, targets, {k: F.col(k) for k in values}, F.col("tokens"))
    m = F.col("mix")
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round(m["probability"], 9).alias("probability"), m["kept"].alias("kept"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records where a replica of the pages' WARC files, read back from the shared folder, is damaged."""
    pages = _table(spark, sf_dir, "pages")
    primary = warc.records(pages, "page_id", "url", "html")
    # a replica with damage known beforehand: one page in 97 has its first "e" overwritten
    harmed = F.when(F.col("page_id") % 97 == 5, F.regexp_replace("html", "(?s)^(.*?)e", "$1~")).otherwise(F.col("html"))
    replica = warc.records(pages.withColumn("html", harmed), "page_id", "url", "html")
    plan, found = warc.layout(primary), []
    for name, rows in (("warc", primary), ("warc-replica", replica)):
        path = new_path(spark, name)
        warc.write(rows, plan, path)
        found.append(stored(warc.nodes(spark, path), "merkle"))
    return warc.audit(*found)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for every document by the smallest compressed size; labels of a fifth of the documents are never seen."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    taught = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = langid.fit(taught)
    guess = langid.identify(F.col("text"), model)
    return docs.select("doc_id", held_out.alias("held_out"), guess.alias("g")).select("doc_id", "held_out", "g.lang_pred", "g.score", "g.margin")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document shares with the benchmark: all windows of 10 words of its items, looked up in FM-indexes of the documents."""
    shards = decontam.index(_table(spark, sf_dir, "documents"))
    items = decontam.phrases(_table(spark, sf_dir, "benchmark"))
    return decontam.report(decontam.search(shards, items)).drop("spans", "items")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of each benchmark item; documents stream through the items' inverted index."""
    found = lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th embedding, by a hyperplane tree with distance ranges."""
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = gnat.negatives(rows.select("vec_id", label.alias("label"), "embedding"), "vec_id", "label", "embedding")
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score")


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_chat, op3_bpe, op4_url_filters, op5_simhash, op6_media, op7_quality, op8_mixing, op9_warc, op10_language_id, op11_decontaminate, op12_lexical_search, op13_hard_negatives)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

_QUALITY = rf"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as w, row_number() over () as r from documents),
wins as (select r, i, list_slice(w, i, i + 7) as g from (select r, w, unnest(range(1, len(w) - 6)) as i from d)),
dup as (select r, i from (select r, i, count(*) over (partition by r, g) as c from wins) where c > 1),
cov as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from dup) group by r),
m as (
  select d.doc_id, len(w) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    coalesce(cov.n, 0) as n_repeat_words, length(regexp_replace(text, '[^!?]+', '', 'g')) as n_marks,
    length(regexp_replace(text, '\P{{L}}+', '', 'g')) as letters, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) as upper_,
    len(list_filter(w, lambda x: lower(x) in ({_STOPS}))) as n_stop, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_same
  from d left join cov using (r)),
n as (select *, len(lines) - len(list_distinct(lines)) as n_dup_lines, greatest(n_words, 1) as k from m),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from n)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_words <= 1000000 and word_chars / k between 2.0 and 14.0 and n_symbols / k <= 0.10 and n_marks / k <= 0.20
  and upper_ / greatest(letters, 1) <= 0.50 and n_stop / k >= 0.02 and n_dup_lines / greatest(len(lines), 1) <= 0.50 and n_repeat_words / k <= 0.30 and n_same / k <= 0.30 as kept
from b"""

_CHAT = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '###', '#\##'), '###', '#\##'), '###', '#\##') as x from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  sum(4 + length(role) + 2 + length(x) + 8)::bigint as formatted_chars
from e group by conv_id"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DECONTAM = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select coalesce(item_id::varchar, '') as item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item, least(len(w), 10) as m, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') as g
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from i where len(w) > 0)),
dw as (select r, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') as g
  from (select r, w, m, unnest(range(1, len(w) - m + 2)) as s from d, (select distinct m from iw) where len(w) >= m)),
h as (select distinct r, s, m, item from dw join iw using (m, g)),
c as (select r, count(distinct p) as n from (select r, unnest(range(s, s + m)) as p from (select distinct r, s, m from h)) group by r),
n as (select r, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct r, item from h) group by r)
select doc_id, len(w) as n_words, coalesce(c.n, 0) as n_hit, coalesce(n.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, c.n is not null as contaminated
from d left join c using (r) left join n using (r)"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

_LEXICAL = rf"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all({_LOW}, {_TERM}) as w from documents),
d as (select r, doc_id, len(w) as n from w where len(w) > 0),
c as (select count(*) as n_docs, sum(n)::bigint as n_terms from d),
i as (select distinct item_id, unnest(regexp_extract_all({_LOW}, {_TERM})) as t from benchmark where item_id is not null),
tf as (select r, t, count(*) as tf from (select r, unnest(w) as t from w) semi join i using (t) group by r, t),
df as (select t, count(*) as df, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as wt from tf, c group by t),
m as (select r, doc_id, 100 - 90 + ((90 * n * n_docs) // n_terms) as m from d, c),
s as (select item_id, r, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from i join tf using (t) join df using (t) join m using (r) group by item_id, r, doc_id)
select item_id, rank::int as rank, doc_id, score from
  (select *, row_number() over (partition by item_id order by score desc, doc_id asc nulls last) as rank from s where score > 0) where rank <= 10"""

_NEGATIVES = """
with e as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as anchor, b.id as other, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score from e a, e b where a.id % 50 = 0 and a.id <> b.id),
p as (select * from (select anchor, other as positive, score, row_number() over (partition by anchor order by score desc, other) as k from s where same) where k <= 5),
n as (select p.anchor, positive, p.score as positive_score, s.other as negative, s.score as negative_score,
    row_number() over (partition by p.anchor, positive order by s.score desc, s.other) as rank
  from p join s on s.anchor = p.anchor and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor as anchor_id, positive as positive_id, rank::int as rank, negative as negative_id, positive_score, negative_score from n where rank <= 3"""

ORACLE = {"op2_chat": _CHAT, "op7_quality": _QUALITY, "op11_decontaminate": _DECONTAM, "op12_lexical_search": _LEXICAL, "op13_hard_negatives": _NEGATIVES}
