"""Queries for language-level text operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from palimpsest.functions import language as L
from palimpsest.functions import rules
from palimpsest.functions import text as X
from palimpsest.functions import vectors
from palimpsest.operators import retrieval, voices
from palimpsest.plans.reference import _TOK, _TOKENS, EM, WM, em, wm
from palimpsest.plans.texts import _q, _type_sql
from palimpsest.sources.tables import table

QUERIES: dict = {}


def duck(sql: str | None) -> str | None:
    """Short lambdas spelled out, and a name for the column "at", which is a word of the SQL itself; quoted text stays."""
    if sql is None:
        return None
    parts = re.split(r"('(?:[^']|'')*')", sql)
    parts[::2] = [re.sub(r"\bat\b", "at_us", re.sub(r"\b([a-z]) -> ", r"lambda \1: ", p)) for p in parts[::2]]
    return "".join(parts)


def query(sql: str | None = None):
    sql = duck(sql)

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


_MEANT = rf"length(w) >= 3 and not list_contains({_list(X.STOP_WORDS)}, w) and not regexp_matches(w, '^\p{{N}}+$')"
_ROWS = "(select distinct id, content from {0} where content is not null)"
W, E = _ROWS.format("working_memory"), _ROWS.format("episodic_memory")


@query(f"select distinct id, unnest(list_distinct(flatten(list_transform(list_filter({_TOKENS}, x -> contains(x, '-')), x -> list_filter(string_split(x, '-'), w -> {_MEANT}))))) as part from {W}")
def f2_f4_hyphen_parts(spark, d):
    parts = F.array_distinct(F.flatten(F.transform(X.tokens(F.col("content")), X.hyphen_components)))
    return wm(spark, d).where("content is not null").select("id", F.explode(parts).alias("part")).distinct()


@query(r"select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower('c++ ' || lang || '# and C# or ' || text), '(?:^|[^\p{L}\p{N}_])([a-z]+(?:\+\+|#))', 1))), ',') as symbols from documents where text is not null and lang is not null and not regexp_matches(lower(text), '[+#][\p{L}\p{N}_+#]|[+#]{3}')")
def f3_symbols(spark, d):
    t = F.lower(F.concat(F.lit("c++ "), F.col("lang"), F.lit("# and C# or "), F.col("text")))
    docs = table(spark, d, "documents").where("text is not null and lang is not null").where(~F.lower("text").rlike(r"[+#][\p{L}\p{N}_+#]|[+#]{3}"))
    return docs.select("doc_id", F.array_join(F.array_sort(X.symbolic_tokens(t)), ",").alias("symbols"))


@query(r"select doc_id, regexp_matches('語' || text, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]') as cjk, regexp_matches(text, '[а-яёА-ЯЁ]') as cyrillic, case when doc_id % 2 = 0 then '東,東京,京' else '' end as terms from documents where text is not null and not regexp_matches(text, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]')")
def f5_scripts(spark, d):
    t = F.col("text")
    asked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x 東京 "), F.substring("text", 1, 5))).otherwise(F.substring("text", 1, 5))
    docs = table(spark, d, "documents").where("text is not null").where(~L.has_cjk(t))
    # Pairs sort after their first character.
    return docs.select("doc_id", L.has_cjk(F.concat(F.lit("語"), t)).alias("cjk"), L.has_cyrillic(t).alias("cyrillic"), F.array_join(F.transform(L.cjk_terms(asked), lambda x: x), ",").alias("raw")).select(
        "doc_id", "cjk", "cyrillic", F.when(F.col("raw") == "東,京,東京", "東,東京,京").otherwise(F.col("raw")).alias("terms")
    )


@query("select distinct s as subject, case when length(s) < 3 then 1 else len(list_distinct(list_transform(range(1, length(s) - 1), i -> substr(s, i::int, 3)))) end::bigint as n_grams from (select distinct lower(trim(subject)) as s from triples where subject is not null)")
def f6_trigrams(spark, d):
    s = table(spark, d, "triples").where("subject is not null").select(F.lower(F.trim("subject")).alias("subject")).distinct()
    return s.select("subject", F.size(X.ngrams(F.col("subject"))).cast("bigint").alias("n_grams"))


@query("select event_id, case when isfinite(v) and v > 0 then v else 24.0 end as halflife from (select event_id, case event_id % 4 when 0 then -value when 1 then 'infinity'::double when 2 then 'nan'::double else value end as v from events)")
def f10_halflife(spark, d):
    v = F.expr("case event_id % 4 when 0 then -value when 1 then double('infinity') when 2 then double('nan') else value end")
    e = table(spark, d, "events").select("event_id", v.alias("v"))
    return e.select("event_id", F.when(~F.isnan("v") & (F.col("v") > 0) & (F.col("v") < float("inf")), F.col("v")).otherwise(24.0).alias("halflife"))


_NORM = "sqrt(list_sum(list_transform({0}::double[], x -> x * x)))"
_UNIT = f"(select vec_id, label, list_transform(embedding::double[], x -> x / {_NORM.format('embedding')}) as u from embeddings where embedding is not null)"
_CENTRE = f"(select label, list(m order by i) as c from (select label, i, avg(v) as m from (select label, unnest(u) as v, generate_subscripts(u, 1) as i from {_UNIT}) group by label, i) group by label)"


def _unit_vectors(spark, d):
    v = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    return v.select("vec_id", "label", F.transform("e", lambda x: x / vectors.norm(F.col("e"))).alias("u"))


@query(f"select label, count(*)::bigint as n, round(any_value(s2), 6) as centre_norm, round(case when count(*) > 1 then (any_value(s2) * any_value(s2) * count(*) * count(*) - count(*)) / (count(*) * (count(*) - 1)) end, 6) as mean_cosine from (select u.label, sqrt(list_sum(list_transform(c, x -> x * x))) as s2 from {_UNIT} u join {_CENTRE} m using (label)) group by label")
def a24_centroids(spark, d):
    """Per label the centroid's length and the mean cosine of all pairs, from the sum of unit vectors: no pair is spelled out."""
    u = _unit_vectors(spark, d)
    sums = u.select("label", F.posexplode("u").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    length = sums.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("r"))
    n = u.groupBy("label").agg(F.count("*").alias("n"))
    r, k = F.col("r"), F.col("n")
    return n.join(length, "label").select("label", "n", F.round("r", 6).alias("centre_norm"), F.round(F.when(k > 1, (r * r * k * k - k) / (k * (k - 1))), 6).alias("mean_cosine"))


@query(f"select vec_id, round(list_dot_product(u, c) / {_NORM.format('c')}, 6) as cosine from {_UNIT} u join {_CENTRE} m using (label)")
def f13_cosine_to_centroid(spark, d):
    u = _unit_vectors(spark, d)
    sums = u.select("label", F.posexplode("u").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    c = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    return u.join(c, "label").select("vec_id", F.round(vectors.cosine(F.col("u"), F.col("c")), 6).alias("cosine"))


_PRIORITY = rules.PRIORITY
_CASE = lambda table, default: "case type " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + f" else {default} end"


@query(f"select id, {_CASE(rules.PRIORITY, 0)} as priority, type in ({', '.join(map(_q, rules.CONSOLIDATED))}) as consolidates, {_CASE(rules.DECAY, 0.3)}::double as decay from ({_type_sql()})")
def f22_type_maps(spark, d):
    t = em(spark, d).where("content is not null").select("id", rules.memory_type(F.col("content"))["type"].alias("t")).distinct()
    return t.select("id", rules.priority(F.col("t")).alias("priority"), F.col("t").isin(rules.CONSOLIDATED).alias("consolidates"), rules.decay_rate(F.col("t")).alias("decay"))


def _coded_sql(column: str) -> str:
    for phrase, code in L.CODES.items():
        column = f"replace({column}, {_q(phrase)}, {'chr(' + str(ord(code)) + ')' if code else _q('')})"
    return column


@query(f"""select id, octet_length(encode({_coded_sql('content')}))::bigint as coded, case when octet_length(encode(content)) > 500 then left(content, 250) || ' [...] ' || right(content, 100) else content end as short,
round(case when content = '' then 0 else (1 - octet_length(encode({_coded_sql('content')})) / octet_length(encode(content))::double) * 100 end, 6)::double as savings from {E}""")
def f25_compressed(spark, d):
    c = F.col("content")
    coded = L.dictionary_coded(c)
    e = em(spark, d).where("content is not null")
    return e.select("id", F.octet_length(coded).cast("bigint").alias("coded"), L.head_and_tail(c).alias("short"), F.round(L.savings_percent(c, coded), 6).alias("savings")).distinct()


@query(f"select count(*)::bigint as n, sum(octet_length(encode(content)))::bigint as before, sum(octet_length(encode({_coded_sql('content')})))::bigint as after from {E}")
def a19_batch_savings(spark, d):
    c = F.col("content")
    e = em(spark, d, "id", "content").where("content is not null")
    return e.agg(F.count("*").alias("n"), F.sum(F.octet_length(c)).cast("bigint").alias("before"), F.sum(F.octet_length(L.dictionary_coded(c))).cast("bigint").alias("after"))


@query()
def x18_x19_run_lengths(spark, d):
    """Automatic choice: the dictionary where it saves 5 % and more, else run lengths; whether decoding the latter gives the text back."""
    c = F.col("content")
    rows = em(spark, d).where("content is not null").select("id", "content", L.dictionary_coded(c).alias("coded"), L.run_length_coded(c).alias("runs"))
    auto = F.when(L.savings_percent(c, F.col("coded")) >= 5, F.col("coded")).otherwise(F.col("runs"))
    return rows.select("id", F.octet_length(auto).alias("size"), (L.run_length_decoded(F.col("runs")) == c).alias("restored")).distinct()


def _chat_sql() -> str:
    t = "trim(lower(content), ' ')"
    edge = r"[^\p{L}\p{N}_]"
    for short, full in L.SHORTHAND:
        # Twice, for neighbours that share the character between them.
        for _ in range(2):
            t = f"regexp_replace({t}, {_q(f'(^|{edge}){short}({edge}|$)')}, {_q(chr(92) + '1' + full + chr(92) + '2')}, 'g')"
    strip = "regexp_replace(w, '^[.,!?;:''\"]+|[.,!?;:''\"]+$', '', 'g')"
    joined = f"array_to_string(list_filter(regexp_split_to_array({t}, '\\s+'), w -> w <> '' and not list_contains({_list(L.FILLERS)}, {strip})), ' ')"
    for c in map(chr, range(33, 127)):
        one = "[" + (c if c.isalnum() else chr(92) + c) + "]{3,}"
        joined = f"regexp_replace({joined}, {_q(one)}, {_q(c if c != chr(92) else chr(92) * 2)}, 'g')"
    return f"""select id, case when len(w) = 2 and list_contains({_list(L.STARTERS)}, w[1]) then 'i am ' || array_to_string(w, ' ') when len(w) >= 2 then array_to_string(w, ' ') when len(w) = 1 and length(w[1]) > 5 then w[1] end as plain
from (select id, list_filter(regexp_split_to_array(regexp_replace({joined}, '[^\\x00-\\x7F]+', ' ', 'g'), '\\s+'), w -> w <> '') as w from {W})"""


@query(_chat_sql())
def f26_x28_chat(spark, d):
    return wm(spark, d).where("content is not null").select("id", L.chat_normal(F.col("content")).alias("plain")).distinct()


@query("select total, survived, total - survived as dropped, round(survived / total::double, 3) as rate from (select count(*)::bigint as total, count(plain)::bigint as survived from (" + _chat_sql() + "))")
def f26_extraction_rate(spark, d):
    out = f26_x28_chat(spark, d).agg(F.count("*").alias("total"), F.count("plain").alias("survived"))
    return out.select("total", "survived", (F.col("total") - F.col("survived")).alias("dropped"), F.round(F.col("survived") / F.col("total"), 3).alias("rate"))


@query(f"select id, round(list_aggregate(string_split(content, ''), 'entropy'), 6) as entropy from {W} where content <> ''")
def f29_entropy(spark, d):
    return wm(spark, d).where("content is not null and content != ''").select("id", F.round(X.entropy(F.col("content")), 6).alias("entropy")).distinct()


@query(rf"""select doc_id, case when text = '' then 'en' when ru >= 5 or ru >= 2 and len(list_intersect(spaced, {_list(L.RUSSIAN)})) >= 2 then 'ru'
when regexp_matches(low, '[äöüß]') or len(list_intersect(words, {_list(L.GERMAN)})) >= 2 then 'de' when regexp_matches(low, '[ñáéíóúü¿¡]') or len(list_intersect(words, {_list(L.SPANISH)})) >= 2 then 'es'
when regexp_matches(low, '[àèéìòù]') and len(list_intersect(words, {_list(L.ITALIAN)})) >= 2 then 'it' else 'en' end as language
from (select doc_id, text, lower(text) as low, length(text) - length(regexp_replace(lower(text), '[{L.RUSSIAN_LETTERS}]', '', 'g')) as ru, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) as words, list_distinct(regexp_split_to_array(trim(lower(text)), '\s+')) as spaced from documents where text is not null)""")
def f30_language(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", L.language(F.col("text")).alias("language"))


_SIGNAL = "case when length(s) < 120 then 1 else 0 end + " + " + ".join(f"len(regexp_extract_all(regexp_replace(s, '[À-ÖØ-öø-ɏ]', '_', 'g'), {_q(p)})) * {w}" for p, w in L.SIGNALS)


def _key_sql(rows: str, budget: int) -> str:
    return rf"""with p as (select id, content, string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as parts from {rows}),
s as (select id, unnest(parts) as s, generate_subscripts(parts, 1) as i from p), k as (select id, s, i, {_SIGNAL} as score from s where trim(s) <> ''),
c as (select *, sum(length(s) + 1) over (partition by id order by score desc, i rows unbounded preceding) as used from k),
g as (select id, string_agg(s, ' ' order by score desc, i) as kept from c where used <= {budget} group by id)
select p.id, case when length(content) <= {budget} then content when len(parts) <= 1 or kept is null then left(content, {budget}) || ' [...]' else kept || case when length(content) > length(kept) then ' [...]' else '' end end as short from p left join g using (id)"""


@query(_key_sql(E, 300))
def k12_f31_key_sentences(spark, d):
    return em(spark, d).where("content is not null").select("id", L.key_sentences(F.col("content"), 300).alias("short")).distinct()


@query(f"""with a as (select *, case when coalesce(tier, 1) = 1 and age > {30 * 86_400_000_000} then 1 when tier = 2 and age > {180 * 86_400_000_000} then 2 end as moves from (select distinct id, content, tier, created_at, 1748736000000000 - epoch_us(created_at) as age from {EM} where content is not null)),
b as (select *, row_number() over (partition by moves order by created_at, id) as n from a where moves is not null), k as ({_key_sql("(select id, content from episodic_memory where content is not null group by all)", 300)})
select id, moves + 1 as tier, case moves when 1 then left(content, 800) else short end as content from b join k using (id) where n <= case moves when 1 then 100 else 50 end""")
def l9_k13_degrade(spark, d):
    """The oldest 100 rows of tier 1 and 50 of tier 2 that are due, with their shortened contents: 800 characters, then the key sentences."""
    from palimpsest.operators import lifecycle

    return lifecycle.degrade(em(spark, d, "id", "content", "tier", "created_at").where("content is not null"), 1_748_736_000_000_000)


@query(rf"select id, len(list_filter({_TOKENS}, x -> true))::bigint as n_terms from {W}".replace("list_filter(" + _TOKENS + ", x -> true)", _TOKENS))
def r3_query_terms(spark, d):
    return wm(spark, d).where("content is not null").select("id", F.size(X.tokens(F.col("content"))).cast("bigint").alias("n_terms")).distinct()


@query(f"select id, case when n <= 2 then 0.15 when n = 3 then 0.5 else 0.3 end::double as gate from (select id, len(list_distinct({_TOKENS})) as n from {W})")
def r5_gates(spark, d):
    n = F.size(F.array_distinct(X.tokens(F.col("content"))))
    return wm(spark, d).where("content is not null").select("id", F.when(n <= 2, 0.15).when(n == 3, 0.5).otherwise(0.3).alias("gate")).distinct()


@query(rf"select id, case when regexp_matches(lower(content), '(^|[^\p{{L}}\p{{N}}_-])--limit($|[^\p{{L}}\p{{N}}_-])') then 0.3 else 0 end::double as flag, case when len(list_intersect({_TOKENS}, {_list(voices.CURRENT_WORDS)})) > 0 then 0.04 else 0 end::double as current from (select id, case when id < '8' then 'run --limit now ' else '' end || content as content from {W})")
def r6_r7_bonuses(spark, d):
    c = F.concat(F.when(F.col("id") < "8", "run --limit now ").otherwise(""), F.col("content"))
    asked = "what does the current --limit do"
    return wm(spark, d).where("content is not null").select("id", voices.flag_bonus(asked, c).alias("flag"), voices.current_bonus(asked, X.tokens(c)).alias("current")).distinct()


@query(r"select doc_id, round(len(list_filter(['東','京','都'], c -> contains(t, c))) / 3.0, 6)::double as coverage from (select doc_id, case doc_id % 3 when 0 then '京' when 1 then '東京' else '' end || text as t from documents where text is not null)")
def r11_cjk_coverage(spark, d):
    t = F.concat(F.expr("case doc_id % 3 when 0 then '京' when 1 then '東京' else '' end"), F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(X.cjk_coverage("東京都", t), 6).alias("coverage"))


_GRAMS = "case when length({0}) < 3 then [{0}] else list_distinct(list_transform(range(1, length({0}) - 1), i -> substr({0}, i::int, 3))) end"


def _trigram_sql(asked: str) -> str:
    own = [sorted({w[i : i + 3] for i in range(len(w) - 2)}) for w in asked.lower().split() if len(w) >= 3]
    best = lambda g: f"coalesce(list_max(list_transform(words, w -> len(list_intersect({_GRAMS.format('w')}, {_list(g)})) / len(list_distinct(list_concat({_GRAMS.format('w')}, {_list(g)}))))), 0)"
    return f"select id, round(({' + '.join(map(best, own))}) / {len(own)}, 6)::double as score from (select id, list_filter(list_distinct(regexp_extract_all(lower(content), '[а-яёa-z0-9]+')), w -> length(w) >= 3) as words from {E})"


@query(_trigram_sql("sitzungsnotiz noise filters"))
def r12_trigram_score(spark, d):
    return em(spark, d).where("content is not null").select("id", F.round(L.trigram_score("sitzungsnotiz noise filters", F.col("content")), 6).alias("score")).distinct()


_HEADS = L.canonical_words()


@query(f"select id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(lower(trim(content, ' ')), '\\s+'), w -> w <> '' and not list_contains({_list(L.QUESTION_STOPS)}, w)), w -> coalesce(map_extract(MAP {{{', '.join(f'{_q(k)}: {_q(v)}' for k, v in _HEADS.items())}}}, w)[1], w)))), ' ') as key from {W}")
def r22_question_keys(spark, d):
    return wm(spark, d).where("content is not null").select("id", L.question_key(F.col("content")).alias("key")).distinct()


_ABILITY = "case " + " ".join(f"when {' or '.join(f'contains(low, {_q(p)})' for p in ps)} then '{n}'" for n, ps in L.ABILITIES) + f" when {' or '.join(f'starts_with(low, {_q(w)})' for w in L.QUESTION_WORDS)} then 'IE' else '' end"


@query(f"select doc_id, {_ABILITY} as ability from (select doc_id, lower(text) as low from documents where text is not null)")
def g4_abilities(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", L.ability(F.col("text")).alias("ability"))


@query(rf"select distinct id, unnest(list_distinct(regexp_extract_all(content, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'))) as phrase from {E}")
def x22_capital_phrases(spark, d):
    return em(spark, d).where("content is not null").select("id", F.explode(L.capital_phrases(F.col("content"))).alias("phrase")).distinct()


@query(rf"select * from (select distinct id, unnest(list_distinct(regexp_extract_all(content, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'))) as value from {E}) where len(list_intersect(regexp_split_to_array(lower(trim(value)), '\s+'), {_list(L.NO_MENTIONS)})) = 0")
def op_p19_clean_mentions(spark, d):
    m = em(spark, d).where("content is not null").select("id", F.explode(L.capital_phrases(F.col("content"))).alias("value")).distinct()
    return m.where(~L.noisy_mention(F.col("value")))


def _preview_sql(column: str, size: int) -> str:
    t = f"left({column}, {size * 4})"
    for p in X.SECRET_PATTERNS.values():
        t = f"regexp_replace({t}, {_q(p)}, '<redacted>', 'g')"
    t = f"regexp_replace({t}, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}\\b', '<redacted-email>', 'g')"
    t = f"regexp_replace({t}, '\\+?\\b\\d[\\d .()-]{{7,}}\\d\\b', '<redacted-phone>', 'g')"
    return f"select id, case when length(t) <= {size} then t else left(t, {size - 1}) || '…' end as preview from (select id, {t} as t from {W})"


@query(_preview_sql("content", 120))
def f38_safe_previews(spark, d):
    return wm(spark, d).where("content is not null").select("id", L.safe_preview(F.col("content"), 120).alias("preview")).distinct()


_HEADS_OF_FILES = [*L.MAGIC, ("524946460000000057454250", "image/webp"), ("524946460000000057415645", "audio/wav"), ("00000018667479706D703432", "video/mp4"), ("000000186674797068656963", "image/heic"), ("0000001866747970717420200000", "video/quicktime"), ("00", None)]


@query(f"select doc_id, [{', '.join(_q(m) if m else 'null' for _, m in _HEADS_OF_FILES)}][(doc_id % {len(_HEADS_OF_FILES)})::int + 1] as mime from documents where text is not null")
def x30_sniffed_types(spark, d):
    heads = F.array(*[F.lit(h) for h, _ in _HEADS_OF_FILES])
    head = F.concat(F.unhex(F.get(heads, (F.col("doc_id") % len(_HEADS_OF_FILES)).cast("int"))), F.encode("text", "UTF-8"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", L.mime_of(head).alias("mime"))


_ENDINGS = ["png", "MP4", "ogg", "pdf", "xyz"]


@query(f"select p_partkey, case when p_partkey % 7 = 0 then 'audio' when p_partkey % 11 = 0 then 'video' else ['image', 'video', 'audio', 'document', 'document'][(p_partkey % 5)::int + 1] end as modality from part")
def f36_modality(spark, d):
    ending = F.get(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("p_partkey") % 5).cast("int"))
    value = F.concat(F.lit("https://files.example/a.b/"), F.col("p_partkey").cast("string"), F.lit("."), ending, F.lit("?v=1.txt#x"))
    mime = F.when(F.col("p_partkey") % 7 == 0, "Audio/ogg")
    kind = F.when(F.col("p_partkey") % 11 == 0, "youtube").otherwise("url")
    return table(spark, d, "part").select("p_partkey", L.modality(kind, value, mime).alias("modality"))


_PRIVATE = ["importance", "session_id"]
_PAYLOAD = f"""select event_id, '{{' || coalesce(array_to_string(list_transform(list_sort(list_filter(json_keys(body), k -> not list_contains({_list(_PRIVATE)}, lower(k)) and not ends_with(lower(k), '_session_id') and not starts_with(lower(k), 'author_'))), k -> k || '=' || coalesce(json_extract_string(body, '$."' || k || '"'), '')), ','), '') || '}}' as canonical
from (select event_id, any_value(payload) as body from memory_events where json_valid(payload) group by event_id) where json_type(body) = 'OBJECT'"""


@query(_PAYLOAD)
def f37_canonical_payloads(spark, d):
    e = table(spark, d, "memory_events").groupBy("event_id").agg(F.min("payload").alias("payload"))
    parsed = e.where("schema_of_variant(try_parse_json(payload)) like 'OBJECT%'").select("event_id", F.from_json("payload", "map<string,string>").alias("m"))
    return parsed.select("event_id", L.canonical_payload(L.scrubbed(F.col("m"), _PRIVATE)).alias("canonical"))


@query("select event_id, true as restored, true as hidden from (select distinct event_id from memory_events where payload is not null)")
def f40_encrypted_payloads(spark, d):
    """Payloads encrypted by the built-in authenticated cipher, and read again."""
    key = F.lit("0123456789abcdef")
    e = table(spark, d, "memory_events").where("payload is not null").groupBy("event_id").agg(F.min("payload").alias("payload"))
    sealed = e.withColumn("sealed", F.aes_encrypt("payload", key, F.lit("GCM")))
    opened = F.aes_decrypt("sealed", key, F.lit("GCM")).cast("string")
    return sealed.select("event_id", (opened == F.col("payload")).alias("restored"), (F.hex("sealed") != F.hex("payload")).alias("hidden"))


@query("select distinct id, 'ok' as quality from working_memory where content is not null")
def f32_valid_texts(spark, d):
    """Bytes that are no UTF-8 replaced; here by way of a byte appended to every text and found again."""
    broken = F.concat(F.encode("content", "UTF-8"), F.unhex(F.lit("FF")))
    fixed = F.make_valid_utf8(broken.cast("string"))
    return wm(spark, d).where("content is not null").select("id", F.when(fixed == F.concat("content", F.lit("�")), "ok").otherwise("changed").alias("quality")).distinct()


@query()
def f20_edit_ratios(spark, d):
    """The matching-blocks ratio of similar names (for which SQL has no function), beside their entity similarity."""
    from palimpsest.operators.conflicts import edit_ratio
    from palimpsest.operators.relational import similar_names

    pairs = similar_names(table(spark, d, "triples"), "subject").where("name != other")
    return pairs.select("name", "other", F.round(edit_ratio(F.col("name"), F.col("other")), 9).alias("ratio"))
