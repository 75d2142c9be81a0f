"""Text expressions: tokens, similarities, entities, labels and noise, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in recall, token shape, synonyms.
STOP_WORDS = (
    "a an and are as at be by can could did do does for from had has have how i in is it its me my of on or our related should that the their there this to totally unrelated "
    "use uses was we what when where which who why with you your again into not please somewhere supposed them then they whatever ask asking query question questions search retrieve recall"
).split()
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}_]*(?:[_.:/+-]+[\p{L}\p{N}][\p{L}\p{N}_]*)*"
SYNONYMS = {
    "branding": ["brand", "positioning", "identity", "wording"],
    "preference": ["prefer", "prefers", "want", "wants", "reject", "rejects", "avoid", "grounded"],
    "professional": ["software", "builder"],
    "url": ["link", "profile"],
    "current": ["now", "live", "latest"],
    "feeling": ["feel", "feels"],
    "imposter": ["self-doubt", "doubt", "insecure"],
}


def _words(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


def meaningful(token: Column) -> Column:
    return (F.length(token) >= 3) & ~F.array_contains(_words(STOP_WORDS), token) & ~token.rlike(r"^\p{N}+$")


def tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0), meaningful)


def hyphen_components(token: Column) -> Column:
    return F.when(F.contains(token, F.lit("-")), F.array_distinct(F.filter(F.split(token, "-"), meaningful))).otherwise(F.array().cast("array<string>"))


def leading_hyphen_fragments(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_-])--?[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*(?!-)"), 0))


def symbolic_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z]+(?:\+\+|#)(?![\p{L}\p{N}_+#])"), 0))


def expanded(token_list: Column) -> Column:
    """The tokens and the meaningful parts of those with separators."""
    parts = F.flatten(F.transform(token_list, lambda t: F.filter(F.split(t, r"[_:/.-]+"), meaningful)))
    return F.array_distinct(F.concat(token_list, parts))


def cjk_characters(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"), 0))


def cjk_coverage(query: str, content: Column) -> Column:
    """Share of the query's distinct CJK characters that the content has."""
    wanted = cjk_characters(F.lit(query))
    return F.coalesce(F.try_divide(F.size(F.filter(wanted, lambda c: F.contains(content, c))).cast("double"), F.size(wanted)), F.lit(0.0))


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own only gram."""
    size = F.length(text)
    return F.when(size < n, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, F.lit(n)))))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != ""))


def _near(token: str):
    return lambda c: (F.length(c) >= 4) & (F.contains(c, F.lit(token)) | F.contains(F.lit(token), c))


def lexical_relevance(query_tokens: list[str], content_tokens: Column, content: Column, query: str = "") -> Column:
    """Exact tokens 1, synonyms 0.75, substrings of four or more letters 0.4, whole query 1, over the number of tokens, at most 1."""
    score = F.lit(0.0)
    for t in dict.fromkeys(query_tokens):
        near = F.exists(content_tokens, _near(t)) if len(t) >= 4 else F.lit(False)
        alike = F.arrays_overlap(content_tokens, _words(SYNONYMS[t])) if t in SYNONYMS else F.lit(False)
        score = score + F.when(F.array_contains(content_tokens, t), 1.0).when(alike, 0.75).when(near, 0.4).otherwise(0.0)
    if query:
        score = score + F.when(F.contains(F.lower(content), F.lit(query.lower())), 1.0).otherwise(0.0)
    return F.least(score / max(1, len(set(query_tokens))), F.lit(1.0))


def minimum_relevance(n_tokens: int) -> float:
    return 0.15 if n_tokens <= 2 else 0.5 if n_tokens == 3 else 0.3


def entity_similarity(a: Column, b: Column) -> Column:
    """Equal 1; prefix 0.7 + 0.3 r (0 below r = 0.3); substring 0.5 + 0.3 r; else 1 - edits / longer; r is shorter / longer."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    longer, shorter = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    r = F.try_divide(shorter.cast("double"), longer)
    return (
        F.when(x == y, 1.0)
        .when(F.startswith(x, y) | F.startswith(y, x), F.when(r < 0.3, 0.0).otherwise(0.7 + 0.3 * r))
        .when(F.contains(x, y) | F.contains(y, x), 0.5 + 0.3 * r)
        .otherwise(1.0 - F.levenshtein(x, y) / longer)
    )


# Shapes of entities.
ENTITY_PATTERNS = [(r"@([\p{L}\p{N}_]{2,30})", 1), (r"#([\p{L}\p{N}_]{2,30})", 1), (r"\"([^\"]{2,50})\"", 1), (r"\b([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*){1,4})\b", 1), (r"\b([A-Z][a-zA-Z]{1,20})\b", 1)]


def entities(text: Column) -> Column:
    """Mentions, tags, quotes and capitalised names; stop words and parts of longer finds are dropped."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), g) for p, g in ENTITY_PATTERNS]))
    kept = F.array_distinct(F.filter(F.transform(found, F.trim), lambda e: ~F.array_contains(_words(STOP_WORDS), F.lower(e)) & (F.length(e) >= 2)))
    return F.filter(kept, lambda e: ~F.exists(kept, lambda o: (F.length(o) > F.length(e)) & F.contains(o, e)))


# Noise patterns, markers and keywords.
NOISE_PATTERNS = [
    r"^\s*(\$|>|#)\s*(pip|npm|npx|yarn|cargo|brew|apt|dnf|pacman)\s", r"^\s*(Collecting|Downloading|Installing|Building|Successfully installed)", r"^\s*Requirement already satisfied",
    r"^\s*(added|removed|changed)\s+\d+\s+package", r"^\s*(npm warn|npm error|npm notice)", r"^\s*(total\s+\d+|drwx|-\w+-\w+\s)", r"^\[?(heartbeat|ping|pong|alive|ok)\]?$", r"^\s*(tick|tock)\s*$",
    r"^cron\s+(started|completed|skipped|tick)", r"^Traceback \(most recent call last\):", r"^(DEBUG|INFO|WARNING|ERROR|CRITICAL)\s+\d{4}-\d{2}-\d{2}",
    r"^(Phase|Step|Stage)\s+\d+\s+(done|complete|started|pending)", r"^(PR|Issue|Commit|Merge)\s*#\d+\s+(fixed|done|merged|closed)", r"^\s*(TODO|FIXME|HACK|XXX)\b", r"^(ok|done|yes|no|sure|thanks|got it)\.?$",
]
SECRET_PATTERNS = {
    "api_key": r"(?:sk|pk|rk)-[a-zA-Z0-9]{20,}", "cloud_key": r"AKIA[0-9A-Z]{16}", "code_host_token": r"gh[pousr]_[A-Za-z0-9]{36}", "chat_token": r"xox[baprs]-[A-Za-z0-9-]+", "web_key": r"AIza[0-9A-Za-z_\-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "assignment": r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*['\"]?[^\s'\"<>{}]{8,}",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----", "database_url": r"(?:postgres|mysql|mongodb|redis)://[^:]+:[^@]+@", "environment": r"(?i)^\s*(?:DB_PASS|SECRET_KEY|AUTH_TOKEN|API_SECRET)\s*=",
}
TRIVIAL = ["done", "ok", "yes", "no", "sure", "thanks", "got it", "acknowledged", "heartbeat", "ping", "pong", "tick", "tock", "alive"]
VALUABLE = ["prefer", "always remember", "never", "project", "environment", "convention", "insight", "decision", "user", "config", "setup", "password policy", "deployment", "architecture"]
TERMINAL = ["collecting ", "downloading ", "installing ", "requirement already", "successfully installed", "npm warn", "npm error", "total ", "drwx", "-rw-r--r--"]
NOISY_SOURCES = ["heartbeat", "cron", "debug", "terminal"]


def _any(test, items) -> Column:
    out = F.lit(False)
    for x in items:
        out = out | test(x)
    return out


def secrets(text: Column) -> Column:
    """Labels of the kinds of secret in the text."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SECRET_PATTERNS.items()]), lambda x: x.isNotNull())


def noise_score(content: Column, importance: Column, source: Column) -> Column:
    """0 to 1: raised by noise signals, then held at 0.3 by words of value unless a secret was found, then raised by a noisy source."""
    low = F.lower(F.trim(content))
    has = lambda items: _any(lambda x: F.contains(low, F.lit(x)), items)
    leaked = F.size(secrets(content)) > 0
    lines = F.size(F.split(content, "\n"))
    stops = F.size(F.split(content, r"\. ")) - 1
    rise = F.greatest(
        F.when(_any(content.rlike, NOISE_PATTERNS), 0.8).otherwise(0.0),
        F.when(leaked, 0.9).otherwise(0.0),
        F.when((F.length(low) < 15) & low.isin(TRIVIAL), 0.7).otherwise(0.0),
        F.when(has(TERMINAL), 0.85).otherwise(0.0),
        F.when(F.contains(low, F.lit("traceback")) | F.contains(content, F.lit('  File "')), 0.85).otherwise(0.0),
        F.when((lines > 30) & (F.length(content) > 1000) & (stops < lines * 0.1), 0.65).otherwise(0.0),
        F.when(importance < 0.2, 0.5).otherwise(0.0),
    )
    held = F.when(~leaked & has(VALUABLE), F.least(rise, F.lit(0.3))).otherwise(rise)
    final = F.when(F.coalesce(source.isin(NOISY_SOURCES), F.lit(False)), F.greatest(held, F.lit(0.7))).otherwise(held)
    return F.when(content.isNull() | (low == ""), 1.0).otherwise(final)


def suggested_action(score: Column, secret_labels: Column) -> Column:
    return F.when(F.size(secret_labels) > 0, "flag").when(score >= 0.8, "delete").when(score >= 0.5, "archive").otherwise("keep")


# Patterns of query intent and their weight factors (vector, text, importance).
INTENTS = {
    "temporal": [r"\b(when|last|yesterday|today|tomorrow|ago|before|after|since|until|during|recently|lately)\b", r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"],
    "factual": [r"\bwhat\s+is\b", r"\bwho\s+is\b", r"\bwhere\s+is\b", r"\b(definition|define|explain|meaning)\b", r"\bhow\s+(many|much|long|far)\b"],
    "entity": [r"\b(tell\s+me\s+about|what\s+do\s+you\s+know\s+about)\b", r"\b(who\s+is|what\s+does)\s+[a-z]+\b", r"\b(about|regarding|concerning)\s+[a-z]+\b"],
    "preference": [r"\b(prefer|like|dislike|want|hate|love|enjoy|favorite|best|worst)\b", r"\b(should\s+i|would\s+you|do\s+you\s+recommend)\b", r"\b(choose|pick|select|option|choice|decide)\b"],
    "procedural": [r"\bhow\s+(to|do|can|should|would)\b", r"\b(step|process|procedure|workflow|guide|tutorial)\b", r"\b(setup|install|configure|build|deploy|run|execute|start|stop)\b"],
}
INTENT_WEIGHTS = {"temporal": (0.6, 1.5, 0.8), "factual": (1.0, 1.2, 0.9), "entity": (1.1, 1.0, 1.3), "preference": (0.9, 0.8, 1.5), "procedural": (1.3, 0.9, 0.7), "general": (1.0, 1.0, 1.0)}


def intent(query: Column) -> Column:
    """struct(category, confidence): most patterns hit wins, then the listed order; 0.3 + 0.15 a hit, at most 1; none: general, 0."""
    low = F.lower(query)
    scored = []
    for i, (name, patterns) in enumerate(INTENTS.items()):
        hits = sum((F.when(low.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0))
        scored.append(F.struct(hits.alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    hit = best["hits"] > 0
    return F.struct(F.when(hit, best["name"]).otherwise("general").alias("category"), F.when(hit, F.least(F.lit(1.0), 0.3 + 0.15 * best["hits"])).otherwise(0.0).alias("confidence"))


def entropy(text: Column) -> Column:
    """Bits per character of the text's own character distribution."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def token_estimate(text: Column, per_token: float = 4.0) -> Column:
    return F.ceil(F.length(text) / per_token).cast("long")


def folded(text: Column) -> Column:
    """Spanish accents folded."""
    return F.translate(F.lower(text), "áéíóúüñ", "aeiouun")


def content_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
