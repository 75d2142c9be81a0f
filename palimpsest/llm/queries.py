"""Queries p3, p4, p7, p8 and p9 over the test tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.exact import collapse
from palimpsest.llm.mixing import mix
from palimpsest.llm.packing import pack
from palimpsest.llm.pii import find_personal, masked
from palimpsest.llm.quality import classify
from palimpsest.llm.tokens import token_counts


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "working_memory").select("id", "content").unionByName(_table(spark, d, "memories").select("id", "content"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse(_notes(spark, d))[1]


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Each repeated record's keeper and number of copies (the keeper included)."""
    return collapse(_notes(spark, d))[0]


def _personal_records(spark: SparkSession, d: str) -> DataFrame:
    parts = [_table(spark, d, n).select(F.lit(n).alias("record_table"), F.col("id").alias("record_id"), "content") for n in ("working_memory", "episodic_memory")]
    both = parts[0].unionByName(parts[1]).where("record_id is not null and content is not null")
    return both.groupBy("record_table", "record_id").agg(F.min("content").alias("content"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    spans, _ = find_personal(_personal_records(spark, d))
    return spans.select("record_table", "record_id", F.explode("spans").alias("s")).select("record_table", "record_id", F.col("s.kind").alias("pii_kind"), F.col("s.item").alias("item_text")).distinct()


def p4_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every record's text with placeholders in place of its items."""
    records = _personal_records(spark, d)
    return masked(records, find_personal(records)[0])


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """A container number per document, or per piece of an oversized one, for each capacity."""
    items = token_counts(_table(spark, d, "documents"), "doc_id", "text")
    specs = [(r["spec_id"], r["capacity_tokens"]) for r in _table(spark, d, "pack_specs").where("capacity_tokens > 0").collect()]
    return pack(items, specs).withColumnRenamed("key", "doc_id")


def p7_properties(spark: SparkSession, d: str) -> DataFrame:
    """What every packing must hold, per capacity: all documents with tokens, no container over its capacity, no piece twice, none split without need, no container number left out, little space left over."""
    placed = p7_containers(spark, d).join(F.broadcast(_table(spark, d, "pack_specs").select("spec_id", "capacity_tokens")), "spec_id")
    by_doc = placed.groupBy("spec_id", "capacity_tokens", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.count_distinct("piece").alias("k"))
    docs = by_doc.groupBy("spec_id").agg(F.count("*").alias("n_documents"), F.count_if(F.expr("n != k")).alias("n_repeated"), F.count_if(F.expr("n > (t + capacity_tokens - 1) div capacity_tokens")).alias("n_split_needlessly"))
    held = placed.groupBy("spec_id", "capacity_tokens", "container").agg(F.sum("tokens").alias("t"))
    fill = held.groupBy("spec_id").agg(F.count_if(F.expr("t > capacity_tokens")).alias("n_overfull"), (F.max("container") + 1 - F.count("*")).alias("n_left_out"), (F.sum("t") >= 0.95 * F.sum("capacity_tokens")).alias("well_filled"))
    return docs.join(fill, "spec_id")


def _mixed(spark: SparkSession, d: str, nearest: bool = False) -> tuple[DataFrame, DataFrame]:
    return mix(token_counts(_table(spark, d, "documents"), "doc_id", "text", ["source"]), _table(spark, d, "source_targets"), nearest)


def p8_uses(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their uses."""
    return _mixed(spark, d)[0].withColumnRenamed("key", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixed(spark, d)[1]


def p8_properties(spark: SparkSession, d: str) -> DataFrame:
    """What every mix must hold, per source: no use beyond the repeats, and the share met."""
    s = _mixed(spark, d)[1]
    return s.select("source", "target_share", (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.005).alias("share_met"))


def p8_shares_of_all(spark: SparkSession, d: str) -> DataFrame:
    """The second reading: as many tokens as there are, with the nearest shares that the repeats allow."""
    return _mixed(spark, d, nearest=True)[1]


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every document's statistics, outlierness with its contributions, and class."""
    return classify(*[_table(spark, d, n) for n in ("documents", "quality_samples", "common_words")])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_statistics(spark, d).where("text_class != 'prose'").select("doc_id", "text_class")


_P3_BASE = r"""
with r as (select id, any_value(content) as content from (select id, content from working_memory union all select id, content from memories) where id is not null and content is not null group by id),
parts as (select *, list_filter(regexp_split_to_array(content, '[|;,\n]'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) as items,
  case when regexp_matches(content, '^\s*\{') and json_valid(content) then json_type(content) = 'OBJECT' else false end as is_json from r),
forms0 as (select id, case
  when is_json then 'f' || array_to_string(list_sort(list_transform(json_keys(content), lambda k: SQ(k) || '=' || SQ(coalesce(json_extract_string(content, '$."' || k || '"'), '')))), '|')
  when len(items) > 1 and list_bool_and(list_transform(items, lambda x: regexp_matches(x, ITEM))) then
    'f' || array_to_string(list_sort(list_transform(items, lambda x: SQ(regexp_extract(x, ITEM, 1)) || '=' || SQ(regexp_extract(x, ITEM, 2)))), '|')
  else 'w' || SQ(content) end as form, SQ(content) as words from parts),
forms as (select id, words, min(form) over (partition by words) as form from forms0),
g as (select form, min(id) as keep_id, count(*)::bigint as n_copies from forms where words <> '' group by form having count(*) > 1)
"""


def _expand(sql: str) -> str:
    sql = sql.replace("ITEM", r"""'^[\s\-*•>–—"]*([\p{L}\p{N}_][\p{L}\p{N}_ ]*?)"?\s*[:=]\s*(\S.*)$'""")
    # SQ(x): letters and digits only, in lower case, sharp s written out.
    out, at = "", 0
    while (i := sql.find("SQ(", at)) >= 0:
        depth, j = 1, i + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += sql[at:i] + r"replace(lower(regexp_replace(" + sql[i + 3 : j - 1] + r", '[^\p{L}\p{N}]+', '', 'g')), 'ß', 'ss')"
        at = j
    return out + sql[at:]


_P3 = _expand(_P3_BASE)

QUERIES = {
    "p3_found": (p3_found, _P3 + "select keep_id, id as copy_id from forms join g using (form) where id <> keep_id and words <> ''"),
    "p3_collapsed": (p3_collapsed, _P3 + "select keep_id, n_copies from g"),
    "p4_found": (p4_found, None),
    "p4_masked": (p4_masked, None),
    "p7_containers": (p7_containers, None),
    "p7_properties": (p7_properties, "select spec_id, count(*)::bigint as n_documents, 0::bigint as n_repeated, 0::bigint as n_split_needlessly, 0::bigint as n_overfull, 0::bigint as n_left_out, true as well_filled from pack_specs, documents where length(text) > 0 group by spec_id"),
    "p8_uses": (p8_uses, None),
    "p8_shares": (p8_shares, None),
    "p8_properties": (p8_properties, "select source, target_share, true as within_repeats, true as share_met from source_targets"),
    "p8_shares_of_all": (p8_shares_of_all, None),
    "p9_found": (p9_found, None),
    "p9_statistics": (p9_statistics, None),
}
