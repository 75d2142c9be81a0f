"""Patterns mined from rows, and retrieval over structured facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import tokens
from palimpsest.operators.sync import transitions

# Words of feeling and of time scope.
EMOTIONS = {
    "positive": ["happy", "excited", "great", "awesome", "love", "enjoy", "glad", "pleased"],
    "negative": ["sad", "angry", "frustrated", "upset", "hate", "disappointed", "worried"],
    "neutral": ["fine", "okay", "alright", "normal", "standard"],
}
SCOPES = [
    (r"\b(yesterday|today|tomorrow|now|soon|later|earlier)\b", "point_in_time"), (r"\b(last\s+week|last\s+month|last\s+year|next\s+week)\b", "point_in_time"), (r"\b(since|from|starting)\b.*\b(until|to|through|end)\b", "duration"),
    (r"\b(between|from)\b.*\b(and|to)\b", "range"), (r"\b\d{1,2}:\d{2}\s*(AM|PM|am|pm)?\b", "point_in_time"), (r"\b\d{4}-\d{2}-\d{2}\b", "point_in_time"),
]


def frequent_words(rows: DataFrame, content: str, n: int) -> DataFrame:
    """The n words that occur in most rows, ties by word."""
    words = rows.select(F.explode(F.array_distinct(tokens(F.col(content)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def word_pairs(rows: DataFrame, content: str, vocabulary: list[str]) -> DataFrame:
    """Rows that hold both words, for pairs of a bounded vocabulary (pairs within a row only)."""
    kept = F.array_sort(F.array_intersect(tokens(F.col(content)), F.array(*[F.lit(w) for w in vocabulary])))
    pairs = F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return rows.select(kept.alias("w")).where(F.size("w") > 1).select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("n"))


def frequent_pairs(rows: DataFrame, content: str, n: int) -> DataFrame:
    """The n most frequent pairs of distinct words within a row, over all words; ties by the pair.

    Pairs are made inside one row only and summed before the shuffle.
    """
    words = F.array_sort(F.array_distinct(tokens(F.col(content))))
    pairs = F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    counted = rows.select(words.alias("w")).where(F.size("w") > 1).select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "first", "second").limit(n)


def emotion(content: Column) -> Column:
    """The first feeling of which the text has a word, or null."""
    low, out = F.lower(content), F.lit(None).cast("string")
    for name, words in reversed(EMOTIONS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def time_scope(content: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(SCOPES):
        out = F.when(content.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def gist(content: Column) -> Column:
    """First sentence if longer than 10 characters, cut at 100, else the first 100 characters."""
    first = F.split(content, r"[.!?]+")[0]
    return F.when(F.length(first) > 10, F.substring(F.trim(first), 1, 100)).otherwise(F.trim(F.substring(content, 1, 100)))


def names(content: Column) -> Column:
    # Fixed value: how a name is written.
    return F.regexp_extract_all(content, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"), 1)


def location(content: Column) -> Column:
    """The first place that a text names by its kind, or null."""
    found = F.regexp_extract(F.lower(content), r"\b(office|home|work|school|hospital|store|restaurant|building|room)\b", 1)
    return F.when(found != "", found)


# Pronouns; verbs of plain statements; first words that make no subject.
PRONOUNS = r"(?i)\b(I|you|we|they|he|she|it|me|us|them|him|her)\b"
VERBS = [("is", "is"), ("has", "has"), ("uses", "uses"), ("works_at", "works (?:at|for)")]
NO_SUBJECTS = "i you he she it we they this that these those there here what who which my your his her their our its".split()


def participants(content: Column) -> Column:
    """Up to five names and pronouns, in order of the alphabet."""
    pronouns = F.regexp_extract_all(content, F.lit(PRONOUNS), 1)
    return F.slice(F.array_sort(F.array_distinct(F.concat(names(content), pronouns))), 1, 5)


def statements(content: Column) -> Column:
    """(subject, predicate, object) of sentences with is, has, uses or works at; at most five."""
    one = lambda name, verb: F.transform(
        F.regexp_extract_all(content, F.lit(rf"\b[A-Z][a-zA-Z]+(?: [A-Z][a-zA-Z]+)* {verb} (?:a |an |the )?[a-zA-Z0-9]+"), 0),
        lambda s: F.struct(
            F.regexp_extract(s, rf"^(.+?) {verb} ", 1).alias("subject"), F.lit(name).alias("predicate"), F.regexp_extract(s, rf" {verb} (?:a |an |the )?([a-zA-Z0-9]+)$", 1).alias("object")
        ),
    )
    found = F.flatten(F.array(*[one(n, v) for n, v in VERBS]))
    sound = lambda f: (F.length(f["subject"]) > 2) & (F.length(f["object"]) > 2) & ~F.lower(F.split(f["subject"], " ")[0]).isin(NO_SUBJECTS)
    return F.slice(F.filter(found, sound), 1, 5)


def extract_facts(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, fact_type, value, position: dates, versions, measures and negations named in texts."""
    c = F.col(content)
    kinds = {"date": r"\b\d{4}-\d{2}-\d{2}\b", "version": r"\bv?\d+\.\d+(?:\.\d+)+\b", "measure": r"\b\d+(?:\.\d+)? ?(?:ms|seconds?|minutes?|hours?|days?|GB|MB|KB|%)", "negation": r"\b(?:never|not|cannot|nobody|nothing) \w+ \w+"}
    each = [_found(c, n, p) for n, p in kinds.items()]
    return rows.select(key, F.explode(F.flatten(F.array(*each))).alias("f")).select(key, "f.fact_type", "f.value", "f.position")


def _found(content: Column, name: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(content, F.lit(pattern), 0), lambda v, i: F.struct(F.lit(name).alias("fact_type"), v.alias("value"), (i + 1).cast("long").alias("position")))


# Words of order and of denial.
ORDER_WORDS = r"\b(first|then|next|after|before|until|later|finally)\b"
DENIALS = r"\b(never|not|cannot|nobody|nothing|don't|won't)\b"


def passes(question: str) -> list[str]:
    """Patterns to search by, the surest first: the question's numbers, its names, words of the same meaning as its own, its last word."""
    import re

    from palimpsest.functions.language import QUESTION_STOPS, canonical_words, concepts

    numbers = re.findall(r"\b\d+\b", question)
    names = [w for w in re.findall(r"\b[A-Z][a-z]+\b", question) if w.lower() not in QUESTION_STOPS]
    heads, groups = canonical_words(), concepts()
    words = [w for w in question.lower().split() if w not in QUESTION_STOPS]
    alike = [s for w in words if w in heads for s in groups[heads[w]] if s != w]
    word = lambda ws: rf"\b({'|'.join(dict.fromkeys(map(re.escape, ws)))})\b"
    return [p for p in (word(numbers) if numbers else "", word(names) if names else "", word(alike) if alike else "", re.escape(words[-1]) if words else "") if p]


def timeline(days: DataFrame, prefix: str, n: int) -> DataFrame:
    """Dated rows (id, day) whose day begins so, the latest first."""
    return days.where(F.startswith("day", F.lit(prefix))).orderBy(F.desc("day"), "id").limit(n)


def negations(rows: DataFrame, words: list[str]) -> DataFrame:
    """Rows that deny something and name all the words."""
    low = F.lower("content")
    out = rows.where(low.rlike(DENIALS))
    for w in words:
        out = out.where(F.contains(low, F.lit(w)))
    return out


def of_entities(facts: DataFrame, names: list[str]) -> DataFrame:
    """Facts whose subject, without its kind, is one of the names."""
    return facts.where(F.regexp_replace(F.lower(F.trim("subject")), "^[a-z]+:", "").isin([n.lower() for n in names]))


def confidences(rows: DataFrame) -> DataFrame:
    """kind, value, n, confidence: the three most frequent hours and two weekdays by their share of rows (id, session_id, source, created_at), the three most frequent neighbours of sources by theirs of all neighbours."""
    dated = rows.where("created_at is not null").select("id", "created_at").distinct()
    total = dated.agg(F.count("*").alias("total"))

    def best(kind: str, value: Column, n: int) -> DataFrame:
        counted = dated.groupBy(value.alias("v")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).orderBy(F.desc("n"), "v").limit(n)
        return counted.select(F.lit(kind).alias("kind"), F.col("v").cast("string").alias("value"), "n", F.round(F.col("n") / F.col("total"), 6).alias("confidence"))

    known = rows.where("source is not null").agg((F.count("*") - 1).alias("total"))
    pairs = transitions(rows, "session_id", ["created_at", "id"], "source").crossJoin(F.broadcast(known)).orderBy(F.desc("n"), "before", "after").limit(3)
    told = pairs.select(F.lit("sequence").alias("kind"), F.concat_ws(" > ", "before", "after").alias("value"), "n", F.round(F.least(F.lit(1.0), F.col("n") / F.greatest(F.lit(2), F.col("total"))), 6).alias("confidence"))
    return best("hour", F.hour("created_at"), 3).unionByName(best("weekday", F.weekday("created_at"), 2)).unionByName(told)


def best_pass(passes: list[DataFrame], key: str, n: int) -> DataFrame:
    """Rows of several search passes: each row once, by its earliest pass, then key."""
    every = None
    for i, p in enumerate(passes, 1):
        one = p.select(key).withColumn("pass", F.lit(i))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.min("pass").alias("pass")).orderBy("pass", key).limit(n)
