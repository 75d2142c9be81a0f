"""Language-level text expressions: scripts, languages, chat text, compression, key sentences, query expansion, previews."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions.text import SECRET_PATTERNS, ngrams

# Markers of languages, in the order of the tests.
RUSSIAN_LETTERS = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
RUSSIAN = "я ты он она оно мы вы они не на в с по для что как это так но да нет уже ещё мой твой наш ваш этот тот".split()
GERMAN = (
    "ich du wir ist nicht für und der die das ein eine kein keine mein meine dann auch immer nie niemals mag will möchte kann kannst können habe hast hat haben bin bist sind seid "
    "einen einer eines dem den beim zum zur nach mit von bei aus auf vor aber oder weil denn dass sehr schon noch mal man nur wenn wie als doch gerne gern lieber einfach eigentlich vielleicht natürlich genau bereits eben"
).split()
SPANISH = (
    "y de por con para que qué como el la lo los las un una del este esta esto ese esa eso aquel mi mis tu tus su sus es está son hay tiene puede más no también si ya nunca he se me te le a yo "
    "ante bajo contra desde en entre hacia hasta según sin sobre tras todo toda cada muy pero siempre usa hacer antes recuerda evita"
).split()
ITALIAN = (
    "e il la i le di che non un una per è in sono mi ha ma lo se su con da come questo quello anche o ho ci si perché perche quando chi dove molto del della delle dei degli nel nella sul sulla sui sulle al alla agli alle"
).split()


def _any_char(low: Column, letters: str) -> Column:
    return F.length(F.translate(low, letters, "")) < F.length(low)


def _markers(words: Column, markers: list[str]) -> Column:
    return F.size(F.array_intersect(words, F.array(*[F.lit(m) for m in markers])))


def language(text: Column) -> Column:
    """ru, de, es, it or en, in this order of tests; a null or empty text is en."""
    low = F.lower(text)
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), 0))
    spaced = F.array_distinct(F.split(F.trim(low), r"\s+"))
    russian = F.length(low) - F.length(F.translate(low, RUSSIAN_LETTERS, ""))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "en")
        .when((russian >= 5) | ((russian >= 2) & (_markers(spaced, RUSSIAN) >= 2)), "ru")
        .when(_any_char(low, "äöüß") | (_markers(words, GERMAN) >= 2), "de")
        .when(_any_char(low, "ñáéíóúü¿¡") | (_markers(words, SPANISH) >= 2), "es")
        .when(_any_char(low, "àèéìòù") & (_markers(words, ITALIAN) >= 2), "it")
        .otherwise("en")
    )


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]")


def has_cyrillic(text: Column) -> Column:
    return text.rlike("[а-яёА-ЯЁ]")


def cjk_terms(text: Column) -> Column:
    """Distinct CJK characters and pairs of neighbours."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]+"), 0)
    grams = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 1), grams(r, 2)))))


_SCORED_WORD = "[а-яёa-z0-9]+"


def _like(grams: list[str]):
    own = F.array(*[F.lit(g) for g in grams])
    return lambda word: F.size(F.array_intersect(own, ngrams(word))) / F.size(F.array_union(own, ngrams(word)))


def trigram_score(query: str, content: Column) -> Column:
    """Mean over the query's words of three letters and more of the best trigram overlap with a word of the content."""
    asked = [w for w in re.findall(_SCORED_WORD, query.lower()) if len(w) >= 3]
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit(_SCORED_WORD), 0)), lambda w: F.length(w) >= 3)
    if not asked:
        return F.lit(0.0)
    total = F.lit(0.0)
    for w in asked:
        total = total + F.coalesce(F.array_max(F.transform(words, _like(sorted({w[i : i + 3] for i in range(len(w) - 2)})))), F.lit(0.0))
    return total / len(asked)


# Chat shorthand, fillers and first words that lack a subject.
SHORTHAND = [
    ("u", "you"), ("ur", "your"), ("u're", "you are"), ("r", "are"), ("y", "why"), ("b4", "before"), ("bc", "because"), ("cuz", "because"), ("gonna", "going to"), ("wanna", "want to"), ("gotta", "got to"), ("kinda", "kind of"),
    ("sorta", "sort of"), ("dunno", "don't know"), ("lemme", "let me"), ("gimme", "give me"), ("outta", "out of"), ("hafta", "have to"), ("shoulda", "should have"), ("woulda", "would have"), ("coulda", "could have"),
]
FILLERS = "lol lmao lmaoo lmfao rofl omg omgg omggg brb idk idc tbh imo imho fwiw irl afaik iirc tldr nvm ikr wtf smh fr ngl istg w wdym".split()
STARTERS = "going coming thinking wondering feeling trying hoping planning working looking checking running testing building fixing deploying".split()


def chat_normal(text: Column) -> Column:
    """Chat text in plain words, or null where nothing is left: shorthand spelled out, fillers dropped, repeated characters and non-ASCII folded, a missing subject added."""
    t = F.trim(F.lower(text))
    for short, full in SHORTHAND:
        t = F.regexp_replace(t, rf"\b{short}\b", full)
    words = F.filter(F.split(t, r"\s+"), lambda w: (w != "") & ~F.regexp_replace(w, r"""^[.,!?;:'"]+|[.,!?;:'"]+$""", "").isin(FILLERS))
    joined = F.array_join(words, " ")
    folded = F.regexp_replace(F.regexp_replace(joined, r"(.)\1{2,}", "$1"), r"[^\x00-\x7F]+", " ")
    last = F.filter(F.split(folded, r"\s+"), lambda w: w != "")
    n, first = F.size(last), F.get(last, 0)
    out = F.array_join(last, " ")
    return F.when((n == 2) & first.isin(STARTERS), F.concat(F.lit("i am "), out)).when(n >= 2, out).when((n == 1) & (F.length(first) > 5), out)


# Phrases of the compression dictionary and their codes.
CODES = {
    "remember that ": "", "the user said ": "", "the user asked ": "", "the user wants ": "", "conversation about ": "", "please note that ": "", "important: ": "", "user preference: ": "",
    "project context: ": "\t", "api key ": "\n", "token ": "\x0b", "session ": "\x0c",
}


def dictionary_coded(text: Column) -> Column:
    for phrase, code in CODES.items():
        text = F.replace(text, F.lit(phrase), F.lit(code))
    return text


def dictionary_decoded(text: Column) -> Column:
    """Codes to phrases; phrases without a code of their own are lost."""
    for phrase, code in CODES.items():
        if code:
            text = F.replace(text, F.lit(code), F.lit(phrase))
    return text


def head_and_tail(text: Column) -> Column:
    """Over 500 bytes only the first 250 and the last 100 characters."""
    return F.when(F.octet_length(text) > 500, F.concat(F.substring(text, 1, 250), F.lit(" [...] "), F.substring(text, -100, 100))).otherwise(text)


@F.pandas_udf(StringType())
def run_length_coded(text: pd.Series) -> pd.Series:
    """Runs of four to 255 equal characters as [c*n]; longer runs are several."""
    return text.str.replace(r"(?s)(.)\1{3,254}", lambda m: f"[{m[1]}*{len(m[0])}]", regex=True)


@F.pandas_udf(StringType())
def run_length_decoded(text: pd.Series) -> pd.Series:
    return text.str.replace(r"(?s)\[(.)\*(\d+)\]", lambda m: m[1] * int(m[2]), regex=True)


def savings_percent(before: Column, after: Column) -> Column:
    return F.when(F.octet_length(before) == 0, 0.0).otherwise((1 - F.octet_length(after) / F.octet_length(before)) * 100)


# What makes a sentence worth keeping.
SIGNALS = [
    (r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", 3), (r"\b[A-Z]{2,}\b", 3),
    (r"\b(Docker|Kubernetes|AWS|GCP|Azure|Terraform|Python|Rust|Go|TypeScript|React|Next\.?js|Node\.?js|SQLite|Postgres|Redis|nginx|systemd|Linux|macOS|Windows)\b", 4),
    (r"\b(prefers?|uses?|likes?|loves?|hates?|dislikes?|wants?|needs?)\b", 2), (r"\b(password|token|secret|key|credential|auth|encrypt|decrypt|private)\b", 3),
    (r"\b(production|staging|deploy|database|backup|migration)\b", 2), (r"\b(critical|urgent|important|breaking|incident|outage|down)\b", 3), (r"\b(always|never|every|must|should)\b", 1),
    (r"\b(\d{1,3}\.\d{1,3}\.\d{1,3})\b", 3), (r"\b(https?://|www\.|[a-z]+\.[a-z]{2,})\b", 2), (r"""["'].*?["']""", 1),
]


def signal(sentence: Column) -> Column:
    score = F.when(F.length(sentence) < 120, 1).otherwise(0)
    # Accented letters are letters, but none that the patterns ask for.
    sentence = F.regexp_replace(sentence, "[À-ÖØ-öø-ɏ]", "_")
    for pattern, weight in SIGNALS:
        score = score + F.regexp_count(sentence, F.lit(pattern)) * weight
    return score


def key_sentences(text: Column, budget: int = 300) -> Column:
    """The sentences of most signal while the budget lasts, else the text's beginning; a text within the budget stays."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    scored = F.transform(F.filter(parts, lambda s: F.trim(s) != ""), lambda s, i: F.struct((-signal(s)).alias("k"), i.alias("i"), s.alias("s")))
    zero = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))

    def add(acc: Column, x: Column) -> Column:
        fits = acc["open"] & (acc["used"] + F.length(x["s"]) + 1 <= budget)
        return F.struct(
            F.when(fits, acc["used"] + F.length(x["s"]) + 1).otherwise(acc["used"]).alias("used"), fits.alias("open"), F.when(fits, F.concat(acc["kept"], F.array(x["s"]))).otherwise(acc["kept"]).alias("kept")
        )

    kept = F.aggregate(F.array_sort(scored), zero, add, lambda acc: F.array_join(acc["kept"], " "))
    first = F.concat(F.substring(text, 1, budget), F.lit(" [...]"))
    cut = F.when((F.size(parts) <= 1) | (kept == ""), first).otherwise(F.concat(kept, F.when(F.length(text) > F.length(kept), " [...]").otherwise("")))
    return F.when(F.length(text) <= budget, text).otherwise(cut)


# Words of one meaning, first the one that stands for all.
CONCEPTS = """
database db datastore data_store | password pass pwd passwd credential secret token | config configuration settings cfg setup | error bug issue fault failure crash exception traceback | fix repair resolve solve patch correct address
deploy deployment release ship push rollout | server host machine vm instance node vps | api endpoint interface service | key token credential secret api_key | user account profile identity person
model llm ai provider gpt claude gemini | speed fast quick performance latency throughput | memory recall remember storage retention | search find lookup query retrieve locate | file document doc text note
code script program source implementation | test verify check validate probe examine | backup snapshot copy save archive | install setup configure bootstrap init | update upgrade refresh renew sync
delete remove destroy purge clean wipe erase | list show display enumerate catalog | time date when timestamp schedule | url link address uri path | health status check pulse alive up
service daemon process systemd worker | port socket bind listen | network internet connection connectivity dns | ssh terminal shell remote connect | git commit push pull repo repository branch
log output stdout stderr trace debug | cron schedule job task timer periodic | email mail message inbox smtp | image picture photo screenshot graphic | browser web page site navigate chrome
monitor watch observe track survey | alert notify notification warning ping | migrate transfer move relocate port | compare diff versus vs contrast | save store persist preserve keep
"""
# Words that a question is asked without.
QUESTION_STOPS = (
    "a an the is are was were be been have has had do does did will would could should may might can shall must i you he she it we they me him her us them my your his its our their mine yours hers ours theirs "
    "what which who whom where when why how this that these those of in to for on with at by from as into through during before after above below between under and but or nor not so than too very just about also "
    "really actually basically simply if then else while because though although"
).split()


def concepts() -> dict[str, list[str]]:
    return {g.split()[0]: g.split()[1:] for g in re.split(r"[|\n]", CONCEPTS) if g.strip()}


def canonical_words() -> dict[str, str]:
    """Word to the word that stands for it; of several groups the last one named holds."""
    out: dict[str, str] = {}
    for head, others in concepts().items():
        out[head] = head
        out |= dict.fromkeys(others, head)
    return out


def question_key(text: Column) -> Column:
    """Words without stop words, each by the word that stands for it, once, in alphabetical order: equal for questions that ask the same."""
    table = F.create_map(*[F.lit(x) for kv in canonical_words().items() for x in kv])
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: (w != "") & ~w.isin(QUESTION_STOPS))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w)))), " ")


def expanded_question(text: str) -> str:
    """Every known word as a group of its alternatives."""
    head, groups, out = canonical_words(), concepts(), []
    for w in text.lower().split():
        c = head.get(w)
        if w in QUESTION_STOPS or c is None:
            out.append(w)
        else:
            group = [c, *groups[c]]
            out.append("(" + "|".join(group if w in group else [w, *group]) + ")")
    return " ".join(out)


# Phrases that tell what kind of answer a question wants, in the order of the tests.
ABILITIES = [
    ("TR", ["how many days", "how many weeks", "how many months", "how long", "how much time", "what date", "what day", "when did", "when does", "what is the deadline", "how many years", "between which dates", "timeline", "how far apart"]),
    ("EO", ["list the order", "walk me through", "order in which", "chronological", "in what order", "sequence of events"]),
    ("CR", ["have i", "did i", "am i", "has this", "contradict", "contradiction", "conflict"]),
    ("IE", ["how many", "what is the", "what are the", "what was the", "what were the", "what was my", "what is", "what was", "what version", "which version", "when was", "when were", "how much", "how big", "how large", "how fast"]),
    ("PF", ["my preference", "what do i like", "what do i prefer", "what do i hate", "what do i dislike", "what do i love", "what do i want", "what do i need", "what do i tend", "do i like", "do i prefer", "do i hate", "do i dislike", "do i love", "do i want", "do i need", "my favorite", "my favourite", "my fav", "things i like", "things i love", "things i hate", "things i dislike", "things i prefer", "things i tend", "things i don", "things i avoid", "what i like", "what i love", "what i hate", "what i dislike", "what i prefer", "what i tend", "what i don", "what i avoid", "preferences"]),
    ("ABS", ["tell me about my background", "previous development", "work experience", "personal background"]),
    ("MR", ["across my", "across all", "in my project", "in my sessions", "across sessions"]),
]
QUESTION_WORDS = ["what ", "when ", "where ", "which ", "who ", "how "]


def ability(question: Column) -> Column:
    """The kind of answer a question wants, or an empty text."""
    low, out = F.lower(question), F.lit("")
    starts = F.lit(False)
    for w in QUESTION_WORDS:
        starts = starts | F.startswith(low, F.lit(w))
    out = F.when(starts, "IE").otherwise(out)
    for name, phrases in reversed(ABILITIES):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(low, F.lit(p))
        out = F.when(hit, name).otherwise(out)
    return out


# Words that are no mention of anything.
NO_MENTIONS = (
    "assistant user skill review target class level signals phase api pi summary added active be not whether all no replying ai memory conversation fact false true none null signal "
    "agent model system note task project result output input data step process point way thing time work"
).split()


def noisy_mention(value: Column) -> Column:
    """Whether any word of a mention is one of no meaning."""
    return F.arrays_overlap(F.split(F.lower(F.trim(value)), r"\s+"), F.array(*[F.lit(w) for w in NO_MENTIONS]))


def capital_phrases(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)*"), 0))


def safe_preview(text: Column, size: int = 120) -> Column:
    """The beginning of a text without secrets, mail addresses and telephone numbers."""
    t = F.substring(text, 1, size * 4)
    for pattern in SECRET_PATTERNS.values():
        t = F.regexp_replace(t, pattern, "<redacted>")
    t = F.regexp_replace(t, r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "<redacted-email>")
    t = F.regexp_replace(t, r"\+?\b\d[\d .()-]{7,}\d\b", "<redacted-phone>")
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.substring(t, 1, size - 1), F.lit("…")))


# First bytes of file types; kinds of file by their ending.
MAGIC = [
    ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("255044462D", "application/pdf"), ("4F676753", "audio/ogg"), ("494433", "audio/mpeg"), ("FFFB", "audio/mpeg"),
    ("664C6143", "audio/flac"), ("504B0304", "application/zip"), ("1A45DFA3", "video/webm"),
]
MODALITY = {
    "image": "png jpg jpeg gif webp bmp tiff heic svg", "video": "mp4 mov webm mkv avi m4v", "audio": "mp3 wav flac ogg m4a aac opus",
}


def mime_of(head: Column) -> Column:
    """The type that the first bytes tell, or null."""
    h = F.hex(F.substring(head, 1, 12))
    at = lambda i, n: F.substring(h, 2 * i + 1, 2 * n)
    riff = F.when(at(8, 4) == "57454250", "image/webp").when(at(8, 4) == "57415645", "audio/wav").when(at(8, 4) == "41564920", "video/x-msvideo")
    brand = F.when(at(8, 4).isin("68656963", "68656978", "68657663", "6865696D"), "image/heic").when(at(8, 4) == "71742020", "video/quicktime").otherwise("video/mp4")
    out = F.when((F.length(h) >= 24) & (at(4, 4) == "66747970"), brand)
    out = F.when(F.startswith(h, F.lit("52494646")), F.coalesce(riff, out)).otherwise(out)
    for prefix, mime in reversed(MAGIC):
        out = F.when(F.startswith(h, F.lit(prefix)), mime).otherwise(out)
    return out


def modality(kind: Column, value: Column, mime: Column) -> Column:
    """image, video, audio or document: from the MIME type, else the kind of reference, else the file's ending."""
    top = F.lower(F.trim(F.split(mime, "/")[0]))
    ending = F.lower(F.regexp_extract(F.regexp_replace(value, r"[?#].*$", ""), r"[^/.]\.([A-Za-z0-9]+)$", 1))
    by_ending = F.lit("document")
    for name, endings in MODALITY.items():
        by_ending = F.when(ending.isin(endings.split()), name).otherwise(by_ending)
    return F.when(top.isin("image", "video", "audio"), top).when(top.isin("application", "text"), "document").when(kind == "youtube", "video").otherwise(by_ending)


def scrubbed(metadata: Column, private: list[str]) -> Column:
    """A map's entries that are not private: named so, an author's, or a session id."""
    low = lambda k: F.lower(k)
    return F.map_filter(metadata, lambda k, v: ~(low(k).isin(private) | low(k).endswith("_session_id") | low(k).startswith("author_")))


def canonical_payload(fields: Column) -> Column:
    """A map as text with its keys in order, to compare payloads by meaning."""
    entries = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit("="), F.coalesce(e["v"], F.lit("")))), ","), F.lit("}"))
