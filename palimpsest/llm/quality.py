"""Per-document text statistics and robust outlierness against the prose of the document's language.

All statistics are JVM expressions over the whole text.  Mean and covariance of
prose are estimated per language over all documents by concentration steps: from
labelled prose as a start, documents within the chi-square quantile of the
current estimate give the next one (sums of products, aggregated in Spark).  The
squared Mahalanobis distance splits into one contribution per statistic.

What an outlier is (list, table, junk) or whether it still reads as prose comes
from a ridge softmax over the whitened deviations and the distance, fitted to at
most ``MAX_SAMPLES`` labelled rows.

Null texts, and texts without any visible character, have no statistics and no
class.  Loose language codes are reduced to two letters; a language without
common words, or a null, takes the language whose common words it has most of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import durable, tuned

MAX_SAMPLES = 20_000
MAX_WORDS = 20_000
CLASSES = ["prose", "list", "table", "junk"]
STATISTICS = [
    "word_count", "word_length", "symbol_ratio", "digit_ratio", "line_end_share", "common_share", "line_words", "marker_share", "cell_share", "cell_regular", "gap_share",
    "sentence_rate", "vowel_share", "longest_token", "repeat_share", "odd_letters", "upper_share", "short_line_share", "separator_rate",
]
CONCENTRATION_STEPS = 3
CHI2_Z = 1.96  # Standard normal quantile of the share of prose kept in a step (0.975).
RIDGE = 0.05

_MARKER = r"^\s*(?:[-*•+–—▪◦‣·>]\s|\(?\d{1,3}[.)]\s|\(?[a-zA-Z][.)]\s|\[[ xX]?\]\s|☐|☑)"
# Patterns begin with one class of characters, so that most places are passed by with one test.
_CELLS = r"(?=[\t|,; <])(?:[\t|]|[,;](?=\S)| {2,}(?=\S)|</t[dh]>)"
_GAP = r"(?=[\t| <])(?:[\t|](?<=\S[\t|])| (?<=\S ) |</t[dh]>)"
_SENTENCE = r"[.!?…](?<=\p{L}[.!?…])[\"'”»)]*(?:\s|$)"
_END = r"[.!?…:][\"'”»)\]]*\s*$"


def short_lang(lang: Column) -> Column:
    return F.lower(F.substring(F.regexp_replace(F.trim(lang), r"[^A-Za-z].*$", ""), 1, 2))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def with_statistics(docs: DataFrame, words: dict[str, list[str]], text: str = "text", lang: str = "lang") -> DataFrame:
    """Add ``s_`` columns for STATISTICS and ``language``.  ``words`` are the common words by language (a small fixed table).

    Characters of a class are counted by the length that is left without them, so a
    pattern is met once a run and not once a character; words are split once, and
    counts over words and lines are taken from those arrays.
    """
    names = sorted(words)
    t = F.col(text)
    df = docs.where(F.regexp_like(t, F.lit(r"\S")))
    # Texts of ASCII alone have simpler classes.
    plain = F.octet_length(t) == F.length(t)
    either = lambda f, ascii_only, any_letter: F.when(plain, f(ascii_only)).otherwise(f(any_letter))
    df = df.withColumns(
        {
            "__list": F.array_remove(either(lambda p: F.split(F.lower(t), p), r"[^a-z0-9]+", r"[^\p{L}\p{N}]+"), ""),
            "__tokens": F.split(F.trim(F.lower(t)), r"\s+"),
            "__lines": F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0),
            "__code": short_lang(F.col(lang)),
        }
    )
    df = df.withColumns(
        {
            # Words and tokens joined again are the text without what stood between them.
            "__alnum": F.array_join("__list", ""),
            "__visible": F.length(F.array_join("__tokens", "")),
            "__cells": F.transform("__lines", lambda x: F.regexp_count(F.trim(x), F.lit(_CELLS))),
        }
    )
    lines, n_lines = F.col("__lines"), F.size("__lines")
    of_lines = lambda test: _share(F.size(F.filter(lines, test)), n_lines)
    known = F.when(F.col("__code").isin(names), F.col("__code"))
    held = lambda n: F.size(F.filter("__list", lambda x: x.isin([w.lower() for w in words[n]])))
    # The words of every language are only counted where the text does not say its own.
    df = df.withColumn("__letters", either(lambda p: _without(F.col("__alnum"), p), r"[0-9]+", r"\p{N}+"))
    df = df.withColumn("__common", F.when(known.isNull(), F.array(*[held(n) for n in names]).cast("array<int>")))
    most = F.get(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.array_position("__common", F.array_max("__common")).cast("int") - 1)
    own = F.array_max("__common")
    for n in names:
        own = F.when(known == n, held(n)).otherwise(own)
    n_letters, n_alnum = F.length("__letters"), F.length("__alnum")
    celled = F.filter("__cells", lambda c: c >= 1)
    w = F.size("__list")
    df = df.withColumns(
        {
            "language": F.coalesce(known, most, F.lit("")),
            "s_word_count": F.log1p(w.cast("double")),
            "s_word_length": F.least(_share(n_alnum, w), F.lit(30.0)),
            "s_symbol_ratio": 1 - _share(n_alnum, F.col("__visible")),
            "s_digit_ratio": _share(n_alnum - n_letters, F.col("__visible")),
            "s_line_end_share": of_lines(lambda x: x.rlike(_END)),
            "s_common_share": _share(own, w),
            "s_line_words": F.log1p(_share(w, n_lines)),
            "s_marker_share": of_lines(lambda x: x.rlike(_MARKER)),
            "s_cell_share": _share(F.size(celled), n_lines),
            "s_cell_regular": F.when(F.size(celled) >= 2, _share(F.size(F.filter(celled, lambda c: c == F.array_max(celled))), n_lines)).otherwise(0.0),
            "s_gap_share": of_lines(lambda x: F.trim(x).rlike(_GAP)),
            "s_sentence_rate": F.least(_share(F.regexp_count(t, F.lit(_SENTENCE)) * 12, w), F.lit(3.0)),
            "s_vowel_share": _share(F.length(either(lambda p: _without(F.col("__letters"), p), r"[^aeiouy]+", r"[^aeiouyäöüáéíóúàèùâêîôûœ]+")), n_letters),
            "s_longest_token": F.log1p(F.array_max(F.transform("__tokens", lambda x: F.length(x))).cast("double")),
            "s_repeat_share": 1 - _share(F.size(F.array_distinct("__tokens")), F.size("__tokens")),
            "s_odd_letters": _share(F.when(plain, 0).otherwise(F.regexp_count(t, F.lit(r"[\x{FFFD}ÃÂâï½¿€™œ‰©°]"))), F.col("__visible")),
            "s_upper_share": _share(F.length(either(lambda p: _without(t, p), r"[^A-Z]+", r"[^\p{Lu}]+")), n_letters),
            # A fifth word ends the search.
            "s_short_line_share": of_lines(lambda x: ~x.rlike(r"^[^\p{L}\p{N}]*(?:[\p{L}\p{N}]++[^\p{L}\p{N}]++){4}[\p{L}\p{N}]")),
            "s_separator_rate": F.least(_share((F.length(t) * 2 - F.length(F.replace(t, F.lit(","), F.lit(""))) - F.length(F.replace(t, F.lit(";"), F.lit("")))) * 5, w), F.lit(5.0)),
        }
    )
    return df.drop("__alnum", "__visible", "__lines", "__code", "__common", "__letters", "__list", "__tokens", "__cells")


Model = dict[str, tuple[np.ndarray, np.ndarray]]
Moments = dict[str, tuple[float, np.ndarray, np.ndarray]]


def deviations(pdf: pd.DataFrame, model: Model) -> np.ndarray:
    """Whitened deviations of a batch's rows from the prose of their language."""
    x = pdf[[f"s_{s}" for s in STATISTICS]].to_numpy(float)
    z = np.zeros_like(x)
    for lang in pdf.language.unique():
        mean, white = model[lang]
        rows = (pdf.language == lang).to_numpy()
        z[rows] = (x[rows] - mean) @ white
    return z


def _moments(stats: DataFrame, model: Model | None = None, limit: float = 0.0) -> Moments:
    """Per language: count, mean and covariance, of all rows or of those within ``limit`` of a model.

    Each task adds up its rows; the driver gets one row per task group and language.
    """
    k = len(STATISTICS)
    cols = [f"s_{s}" for s in STATISTICS]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            if model is not None and len(pdf):
                pdf = pdf[(deviations(pdf, model) ** 2).sum(1) <= limit]
            for lang, group in pdf.groupby("language"):
                x = group[cols].to_numpy(float)
                x = np.hstack([np.ones((len(x), 1)), x])
                sums[lang] = sums.get(lang, 0) + x.T @ x
        if sums:
            yield pd.DataFrame({"language": list(sums), "at": [list(range((k + 1) ** 2))] * len(sums), "v": [a.ravel().tolist() for a in sums.values()]})

    parts = stats.select("language", *cols).mapInPandas(partial, "language string, at array<int>, v array<double>")
    summed = parts.select("language", F.arrays_zip("at", "v").alias("c")).select("language", F.explode("c").alias("c")).groupBy("language", "c.at").agg(F.sum("c.v").alias("v")).collect()
    out: Moments = {}
    for lang in {r["language"] for r in summed}:
        a = np.zeros((k + 1) ** 2)
        for r in summed:
            if r["language"] == lang:
                a[r["at"]] = r["v"]
        a = a.reshape(k + 1, k + 1)
        if a[0, 0] >= 2:
            mean = a[0, 1:] / a[0, 0]
            out[lang] = (a[0, 0], mean, a[1:, 1:] / a[0, 0] - np.outer(mean, mean))
    return out


def _shrunk(n: float, cov: np.ndarray, pooled: np.ndarray) -> np.ndarray:
    """Covariance with a little of the pooled one and a floor on every variance."""
    weight = n / (n + 5 * len(cov))
    return weight * cov + (1 - weight) * pooled + np.diag(np.maximum(1e-4, 0.02 * np.diag(pooled)))


def _white(cov: np.ndarray) -> np.ndarray:
    """Symmetric inverse root: its rows keep the statistics' identity, so squares of z are contributions."""
    values, vectors = np.linalg.eigh(cov)
    return (vectors / np.sqrt(np.maximum(values, 1e-9))) @ vectors.T


def chi2_limit(k: int) -> float:
    """The chi-square quantile by the cube-root normal approximation."""
    return k * (1 - 2 / (9 * k) + CHI2_Z * (2 / (9 * k)) ** 0.5) ** 3


def fit_prose(stats: DataFrame, labelled_prose: DataFrame, languages: set[str]) -> Model:
    """Concentration steps over all documents, started from labelled prose."""
    start = _moments(labelled_prose) or _moments(stats)
    if not start:
        return {}
    n_all = sum(n for n, _, _ in start.values())
    pooled = sum(n * c for n, _, c in start.values()) / n_all
    overall = sum(n * m for n, m, _ in start.values()) / n_all
    moments: Moments = {lang: start.get(lang, (0.0, overall, pooled)) for lang in languages | set(start)}
    # The few labelled rows spread less than prose at large: start wide.
    widen = 4.0
    for _ in range(CONCENTRATION_STEPS):
        model = {x: (m, _white(widen * _shrunk(n, c, pooled))) for x, (n, m, c) in moments.items()}
        new = _moments(stats, model, chi2_limit(len(STATISTICS)))
        moments = {x: new.get(x, moments[x]) for x in moments}
        if new:
            pooled = sum(n * c for n, _, c in new.values()) / sum(n for n, _, _ in new.values())
        widen = 1.3
    return {x: (m, _white(_shrunk(n, c, pooled))) for x, (n, m, c) in moments.items()}


def _squash(z: np.ndarray) -> np.ndarray:
    return np.sign(z) * np.log1p(np.abs(z))


def fit_classes(z: np.ndarray, labels: list[str], steps: int = 60) -> np.ndarray:
    """Ridge softmax by damped Newton steps on squashed deviations, their sizes and the distance; weights (features, classes)."""
    x = features(z)
    y = np.array([[float(c == lab) for c in CLASSES] for lab in labels])
    n, f = x.shape
    k = len(CLASSES)
    w = np.zeros((f, k))
    penal = RIDGE * np.ones(f)
    penal[0] = 1e-6
    for _ in range(steps):
        p = _softmax(x @ w)
        grad = (x.T @ (p - y) / n + penal[:, None] * w / f).ravel(order="F")
        hess = np.zeros((f * k, f * k))
        for a in range(k):
            for b in range(k):
                q = p[:, a] * ((a == b) - p[:, b])
                hess[a * f : (a + 1) * f, b * f : (b + 1) * f] = (x * q[:, None]).T @ x / n
        hess += np.diag(np.tile(penal / f, k)) + 1e-6 * np.eye(f * k)
        step = np.linalg.solve(hess, grad).reshape((f, k), order="F")
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def features(z: np.ndarray) -> np.ndarray:
    s = _squash(z)
    return np.hstack([np.ones((len(z), 1)), s, np.abs(s), np.log1p((z**2).sum(1, keepdims=True))])


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def classify(docs: DataFrame, samples: DataFrame, common_words: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, language, the statistics, outlierness (squared distance), contributions (they add up to it) and text_class."""
    tuned(docs.sparkSession)
    words: dict[str, list[str]] = {}
    common = common_words.where("lang is not null and word is not null").limit(MAX_WORDS + 1).collect()
    if len(common) > MAX_WORDS:
        raise ValueError(f"at most {MAX_WORDS} common words")
    for r in common:
        words.setdefault(r["lang"].strip().lower()[:2], []).append(r["word"])
    stats = durable(with_statistics(docs.select(F.col(key).alias("__key"), "text", "lang"), words).drop("text", "lang"))
    labelled = durable(with_statistics(samples.where(F.col("text_class").isin(CLASSES)).limit(MAX_SAMPLES), words).drop("text", "lang"))
    # A text's language is one of the common words' or, where they name none, empty.
    model = fit_prose(stats, labelled.where("text_class = 'prose'"), set(words) | {""})
    known = labelled.toPandas()
    # Without any text there is nothing to score, without labels all is prose.
    weights = fit_classes(deviations(known, model), list(known.text_class)) if model and len(known) else np.eye(2 * len(STATISTICS) + 2, len(CLASSES))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                z = deviations(pdf, model)
                pdf["outlierness"] = (z**2).sum(1)
                pdf["squares"] = list(z**2)
                pdf["text_class"] = [CLASSES[i] for i in (features(z) @ weights).argmax(1)]
                yield pdf

    fields = stats.schema.simpleString()[7:-1].replace(":", " ")
    scored = stats.mapInPandas(score, f"{fields}, outlierness double, squares array<double>, text_class string")
    contributions = F.map_from_arrays(F.array(*[F.lit(n) for n in STATISTICS]), F.col("squares"))
    return scored.select(F.col("__key").alias(key), "language", *[F.col(f"s_{n}").alias(n) for n in STATISTICS], "outlierness", contributions.alias("contributions"), "text_class")
