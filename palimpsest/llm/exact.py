"""Duplicates hidden by formatting, by progressive partition refinement.

Two records are the same if their contents have the same words in the same order
once case, white space, punctuation and other signs are disregarded, or, where
the content is a set of named fields in any layout (a JSON object; ``name: value``
or ``name = value`` items on lines or between ``|``, ``;`` or ``,``), the same
fields with the same values in any order.

Level 0 groups by a histogram of letters that formatting cannot change, taken
from the bytes without any pattern or parsing.  Only members of classes with
several ids reach level 1, the canonical form, which parses fields and strips
texts.  Both levels are made as they are read, so no text is kept in between.

Null contents and contents without any letter or digit are left out.  Repeated
rows of an id count once.  A group's keeper is its smallest id.  A group may hold
any share of all rows: counting is pre-aggregated, and the members of the
``HOT_GROUPS`` largest groups (a bounded table, so it can be broadcast) are
matched without a shuffle; every other group is below 1/HOT_GROUPS of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import durable

HOT_GROUPS = 1000
# Letters that no JSON escape, no number and no other writing of a letter (ß, ligatures of case) adds or takes away.
HISTOGRAM_LETTERS = "olhmpgwyvz"


def stripped(text: Column) -> Column:
    """Letters and digits only, in lower case, sharp s written out as capitals write it."""
    return F.replace(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")), F.lit("ß"), F.lit("ss"))


def json_fields(content: Column) -> Column:
    """The content's fields if it is a flat JSON object, else null."""
    return F.when(content.rlike(r"^\s*\{"), F.from_json(content, "map<string,string>", {"mode": "PERMISSIVE"}))


def flat(content: Column) -> Column:
    """Text whose letters are those of the content's words: JSON is unescaped."""
    fields = json_fields(content)
    return F.when(F.size(F.map_keys(fields)) > 0, F.concat_ws(" ", F.map_keys(fields), F.map_values(fields))).otherwise(content)


_ITEM = r'^[\s\-*•>–—"]*([\p{L}\p{N}_][\p{L}\p{N}_ ]*?)"?\s*[:=]\s*(\S.*)$'


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def invariant(content: Column) -> Column:
    """Level 0: equal for contents that are the same in any formatting.

    Escapes and nulls of a JSON object have letters of their own, so such a content is read as its fields first.
    """
    escaped = F.contains(content, F.lit("{")) & (F.contains(content, F.lit("\\")) | F.contains(content, F.lit("null")))
    low = F.lower(F.when(escaped, flat(content)).otherwise(content))
    return F.transform(F.array(low), lambda t: F.xxhash64(*[F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit(""))) for c in HISTOGRAM_LETTERS]))[0]


def canonical(content: Column) -> Column:
    """struct(form, words): digests of the canonical form, sorted (name, value) pairs ('f' before it) or the words in order ('w'), and of the words."""
    fields = json_fields(content)
    entries = F.transform(F.map_entries(fields), lambda e: F.concat(stripped(e["key"]), F.lit("="), stripped(F.coalesce(e["value"], F.lit("")))))
    parts = F.filter(F.split(content, r"[|;,\n]"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    named = (F.size(parts) > 1) & F.forall(parts, lambda x: x.rlike(_ITEM))
    pairs = F.transform(parts, lambda x: F.concat(stripped(F.regexp_extract(x, _ITEM, 1)), F.lit("="), stripped(F.regexp_extract(x, _ITEM, 2))))
    joined = lambda items: F.concat(F.lit("f"), _digest(F.concat_ws("|", F.array_sort(items))))
    # The one-element array binds the stripped text to a name, so that it is made once.
    bare = F.array(stripped(content))
    return F.transform(
        bare,
        lambda t: F.struct(F.when(F.size(fields) > 0, joined(entries)).when(named, joined(pairs)).otherwise(F.concat(F.lit("w"), _digest(t))).alias("form"), F.when(t != "", _digest(t)).alias("words")),
    )[0]


def refine(records: DataFrame) -> DataFrame:
    """Members of classes of level 0 with several ids: id, form, words.  ``records`` has id, content."""
    level0 = records.where("id is not null and content is not null").select("id", "content", invariant(F.col("content")).alias("c0"))
    # Rows of an id count once, so a class is one of several only with several ids.
    classes = level0.groupBy("c0").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("c0")
    level1 = level0.join(classes, "c0", "left_semi").select("id", canonical(F.col("content")).alias("c1"))
    return level1.select("id", "c1.form", "c1.words").where("words is not null").distinct()


def collapse(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups: keep_id, n_copies; copies: keep_id, copy_id) of records that occur more than once."""
    members = durable(refine(records))
    forms = members.groupBy("words", "form").agg(F.min("id").alias("keep"), F.count("*").alias("n"))
    # Text with the words of a set of fields in the same order belongs to it: of the forms of the same words the least stands for all.
    least = forms.groupBy("words").agg(F.min("form").alias("key"), F.sum("n").alias("n"), F.min("keep").alias("keep"))
    groups = durable(least.groupBy("key").agg(F.min("keep").alias("keep_id"), F.sum("n").alias("n_copies")).where("n_copies > 1"))
    keyed = durable(least.select("words", "key", "n").join(groups.select("key", "keep_id"), "key").select("words", "keep_id", "n"))
    hot = keyed.orderBy(F.desc("n"), "words").limit(HOT_GROUPS)
    # At most HOT_GROUPS rows of fixed width.
    marked = members.select("id", "words").join(F.broadcast(hot.select("words", F.col("keep_id").alias("hot_keep"))), "words", "left")
    cold = marked.where("hot_keep is null").select("words", "id").join(keyed.select("words", "keep_id"), "words").select("keep_id", "id")
    copies = marked.where("hot_keep is not null").select(F.col("hot_keep").alias("keep_id"), "id").unionByName(cold)
    return groups.select("keep_id", "n_copies"), copies.where("id != keep_id").select("keep_id", F.col("id").alias("copy_id"))
