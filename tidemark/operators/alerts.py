"""Watch items against change sets and events; notifications."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import names as N
from ..sources.scratch import stored


#: Signs of a gram; shorter items are grams themselves.
GRAM = 3


#: Places of a table of marks, and signs that a task cuts at once.
SLOTS, _RUN = 1 << 20, 1 << 20


def _code(gram: str) -> int:
    return sum((ord(c) + 1) << 21 * i for i, c in enumerate(gram))


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def _cut(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of all runs of ``n`` signs; a code holds three signs of 21 bits."""
    signs = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    m = max(0, len(signs) - n + 1)
    code = sum((signs[i : i + m] << 21 * i for i in range(n)), np.zeros(m, np.int64))
    same = row[:m] == row[n - 1 : n - 1 + m]
    return row[:m][same], code[same]


def _marks(grams: DataFrame) -> bytes:
    """A table of ``SLOTS`` bits in which those of the hashes of ``gram`` are set; it is as large for any number of grams."""

    @F.pandas_udf("int")
    def slot(values: pd.Series) -> pd.Series:
        return pd.Series(_slot(np.array([_code(v) for v in values], np.int64)).astype(np.int32))

    bits = np.zeros(SLOTS, bool)
    bits[[r[0] for r in grams.select(slot("gram")).distinct().collect()]] = True
    return np.packbits(bits).tobytes()


def _grams(text: Column, sizes: list[int], marks: bytes | None = None) -> Column:
    """The distinct runs of so many signs in a text; with ``marks``, only those that are marked (and a few that share a mark)."""

    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(texts))]
        wanted = None if marks is None else np.unpackbits(np.frombuffer(marks, np.uint8)).astype(bool)
        texts = texts.fillna("").tolist()
        starts = np.cumsum([0, *map(len, texts)])[:-1] // _RUN
        cuts = np.unique(starts, return_index=True)[1].tolist()
        for a, b in zip(cuts, [*cuts[1:], len(texts)]):
            for n in sizes:
                row, code = _cut(texts[a:b], n)
                if wanted is not None:
                    kept = wanted[_slot(code)]
                    row, code = row[kept], code[kept]
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
                row, (each, at) = row[new], np.unique(code[new], return_inverse=True)
                names = ["".join(chr((c >> 21 * i & 0x1FFFFF) - 1) for i in range(n)) for c in each.tolist()]
                for r, i in zip(row.tolist(), at.tolist()):
                    out[a + r].append(names[i])
        return pd.Series(out, dtype=object)

    return of(text) if sizes else F.array().cast("array<string>")


def gram_keys(rows: DataFrame, text: Column, items: DataFrame, sizes: list[int]) -> DataFrame:
    """``items`` (with ``v``) with ``key``, the gram of theirs that the fewest texts have. An item with a gram that no text has is in no text and goes."""
    long = F.explode(F.when(F.length("v") < GRAM, F.array("v")).otherwise(_grams(F.col("v"), [GRAM])))
    own = stored(items.select("v").distinct().where("v <> ''").withColumn("gram", long), "item-grams")
    used = own.select("gram").distinct()
    # grams that no item uses end in the task that reads the text but for those that share a mark, which end at this join
    often = rows.select(text.alias("_low")).select(F.explode(_grams(F.col("_low"), sizes, _marks(used))).alias("gram")).join(used, "gram").groupBy("gram").agg(F.count("*").alias("often"))
    rarest = own.join(often, "gram", "left").groupBy("v").agg(F.min_by("gram", F.struct("often", "gram")).alias("key"), F.bool_and(F.col("often").isNotNull()).alias("all"))
    return items.join(rarest.where("all").select("v", "key"), "v")


def containing(rows: DataFrame, text: Column, items: DataFrame) -> DataFrame:
    """``rows`` joined with the items whose value ``v`` is anywhere in ``text``.

    Each item is looked up by its rarest gram only, by measured frequency, so a common beginning such as "the" brings no candidates; a candidate's whole value is then compared.
    The texts are read twice, once to count grams and once to find them; what leaves a task are the grams that some item uses.
    """
    sizes = [r[0] for r in items.select(F.least(F.length("v"), F.lit(GRAM)).alias("n")).where("n > 0").distinct().collect()]
    keyed = stored(gram_keys(rows, text, items, sizes), "gram-keys")
    marks = _marks(keyed.select(F.col("key").alias("gram")).distinct())
    found = rows.withColumn("_low", text).withColumn("key", F.explode(_grams(F.col("_low"), sizes, marks)))
    return found.join(keyed, "key").where(F.col("_low").contains(F.col("v"))).drop("_low", "key")


def match(items: DataFrame, changes: DataFrame, events: DataFrame, companies: DataFrame, exposed: DataFrame, per_item: int = 25) -> DataFrame:
    """(id, type, value, kind, doc, detail): notifications of all items, at most ``per_item`` each (JON-25, WIN-05).

    items (type, value); changes (doc, company, statement, category, first_statement, seq), one row for each change
    of material sets; events (doc, company, description, headline, seq), of which both texts are searched; companies (company, name, industry); exposed (country, company).
    """
    low = F.lower(F.trim("value"))
    i = items.withColumn("v", low)
    sets = changes.select("doc", "company", "seq", F.col("first_statement").alias("detail")).distinct()
    names = companies.select(F.lower("name").alias("v"), F.col("company").alias("named"))
    own = i.where("type = 'company'").join(names, "v", "left").withColumn("company", F.coalesce("named", "v")).join(sets, "company")
    land = i.where("type = 'country'").join(exposed.select(F.lower("country").alias("v"), "company").distinct(), "v").join(sets, "company")
    field = i.where("type = 'industry'").join(companies.select(F.lower("industry").alias("v"), "company"), "v").join(sets, "company")
    chain = changes.where((F.col("category") == "supply_chain") | F.lower("statement").contains("supply chain")).select("doc").distinct()
    # an item of this type takes the first sets of the same list, which its cap bounds
    first = sets.join(chain, "doc").orderBy("seq", "doc").limit(per_item).withColumn("one", F.lit(1))
    supply = i.where("type = 'supply_chain'").withColumn("one", F.lit(1)).join(F.broadcast(first), "one")
    words = i.where(~F.col("type").isin("company", "country", "industry", "supply_chain") & (F.col("v") != ""))
    said = containing(changes, F.lower("statement"), words)
    free = said.groupBy("type", "value", "doc").agg(F.min("company").alias("company"), F.min("seq").alias("seq"), F.min("first_statement").alias("detail"))
    # the sign between both texts is in no item, so nothing is found across them
    told = containing(events, F.lower(F.concat_ws("\x1f", "headline", "description")), words).select("type", "value", "doc", "company", "seq", F.col("description").alias("detail")).distinct()
    cols = ["type", "value", "doc", "seq", "detail"]
    one = lambda d, kind: d.select(*cols, F.lit(kind).alias("kind"))
    all_ = one(own, "change").unionByName(one(land, "change")).unionByName(one(field, "change")).unionByName(one(supply, "change")).unionByName(one(free, "change")).unionByName(one(told, "event"))
    all_ = all_.withColumn("id", N.hash_id(F.col("type"), F.col("value"), F.col("kind"), F.col("doc").cast("string"), F.col("detail"), sep="|")).dropDuplicates(["id"])
    k = F.row_number().over(W.partitionBy("type", "value").orderBy("kind", "seq", "id"))
    return all_.withColumn("k", k).where(F.col("k") <= per_item).select("id", "type", "value", "kind", "doc", "detail")


def add_new(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Only notifications whose id isn't there yet, unread (SNK-06)."""
    return new.join(existing.select("id"), "id", "left_anti").withColumn("read", F.lit(False))


def mark_read(rows: DataFrame, condition) -> DataFrame:
    """Unread rows that meet the condition become read; ``changed`` marks them (SNK-07)."""
    hit = condition & ~F.col("read")
    return rows.withColumn("changed", hit).withColumn("read", F.col("read") | hit)


def totals(rows: DataFrame) -> DataFrame:
    """All and unread notifications for each user (AGG-20)."""
    return rows.groupBy("user").agg(F.count("*").alias("total"), F.count_if(~F.col("read")).alias("unread"))
