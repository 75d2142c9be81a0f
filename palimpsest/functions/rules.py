"""Rule tables: memory types, the compact text encoding, and their expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Memory types in order; patterns with type and base confidence; words that raise a type's confidence.
TYPES = ["fact", "preference", "decision", "commitment", "goal", "event", "instruction", "relationship", "context", "learning", "observation", "error", "artifact", "unknown"]
TYPE_RULES = [
    (r"\b(is|are|was|were)\s+(a|an|the)\s+\w+", "fact", 0.6),
    (r"\b(has|have|had)\s+\d+", "fact", 0.7),
    (r"\b(contains|consists?|comprises?)\b", "fact", 0.8),
    (r"\b(version|v)\s*\d+\.?\d*", "fact", 0.9),
    (r"\b(API|endpoint|URL|database|DB)\s+(is|at|points?\s+to)", "fact", 0.8),
    (r"\b(created|modified|updated)\s+(on|at)\s+\d{4}", "fact", 0.8),
    (r"\b(prefer|likes?|enjoys?|loves?|hates?|dislikes?)\b", "preference", 0.8),
    (r"\b(want|wants|wanted)\s+(to|the|a|an)\b", "preference", 0.6),
    (r"\b(rather|instead|alternative)\b", "preference", 0.5),
    (r"\b(dark\s+mode|light\s+mode|theme|color\s+scheme)\b", "preference", 0.9),
    (r"\b(usually|typically|normally|generally)\b", "preference", 0.6),
    (r"\b(decided|chose|selected|picked|opted)\b", "decision", 0.9),
    (r"\b(going\s+with|settled\s+on|locked\s+in)\b", "decision", 0.8),
    (r"\b(choose|select|pick)\s+(between|from|among)\b", "decision", 0.7),
    (r"\b(final\s+decision|final\s+call|final\s+choice)\b", "decision", 0.9),
    (r"\b(will\s+use|using|adopt|adopting)\s+(the|a|an)?\s*\w+", "decision", 0.7),
    (r"\b(will|shall|must|need\s+to)\s+\w+\s+(by|before|until)\b", "commitment", 0.8),
    (r"\b(deadline|due\s+date|due|milestone)\b", "commitment", 0.9),
    (r"\b(promise|committed|pledged|obligated)\b", "commitment", 0.9),
    (r"\b(deliver|ship|release|deploy)\s+(by|before|on)\b", "commitment", 0.8),
    (r"\b(EOD|COB|end\s+of\s+day|close\s+of\s+business)\b", "commitment", 0.7),
    (r"\b(tomorrow|next\s+week|Monday|Friday)\s+(by|at)\b", "commitment", 0.6),
    (r"\b(goal|objective|target|aim|purpose)\b", "goal", 0.9),
    (r"\b(achieve|reach|hit|attain|accomplish)\s+\d+", "goal", 0.8),
    (r"\b(KPI|metric|OKR|success\s+criteria)\b", "goal", 0.9),
    (r"\b(roadmap|plan|strategy)\s+(for|to)\b", "goal", 0.7),
    (r"\b(reach|get\s+to|grow\s+to)\s+\d+[KkMm]?\s+(users|customers|revenue)\b", "goal", 0.8),
    (r"\b(meeting|call|discussion|conversation)\s+(with|about)\b", "event", 0.7),
    (r"\b(happened|occurred|took\s+place|went\s+down)\b", "event", 0.8),
    (r"\b(yesterday|last\s+week|last\s+month|earlier\s+today)\b", "event", 0.6),
    (r"\b(scheduled|planned|booked|set\s+up)\s+(for|at)\b", "event", 0.7),
    (r"\b(incident|outage|bug|issue)\s+#?\d+", "event", 0.8),
    (r"\b( launched|released|shipped|deployed)\s+(on|at)\b", "event", 0.8),
    (r"\b(always|never|must|should|shall|do\s+not|don't)\b", "instruction", 0.7),
    (r"\b(rule|policy|guideline|procedure|protocol)\b", "instruction", 0.9),
    (r"\b(how\s+to|steps?\s+to|guide\s+to|tutorial)\b", "instruction", 0.8),
    (r"\b(remember\s+to|make\s+sure|ensure|verify)\b", "instruction", 0.6),
    (r"\b(first|then|next|finally)\s*,?\s*\w+", "instruction", 0.5),
    (r"\b(if\s+.+\s+then\s+.+)", "instruction", 0.7),
    (r"\b(manages?|reports?\s+to|supervises?|leads?)\b", "relationship", 0.9),
    (r"\b(owns?|belongs?\s+to|part\s+of|member\s+of)\b", "relationship", 0.8),
    (r"\b(works?\s+with|collaborates?\s+with|partners?\s+with)\b", "relationship", 0.8),
    (r"\b(depends?\s+on|requires?|needs?)\b", "relationship", 0.7),
    (r"\b(related\s+to|connected\s+to|associated\s+with)\b", "relationship", 0.6),
    (r"\b(is\s+a|is\s+an)\s+(type\s+of|kind\s+of|form\s+of)\b", "relationship", 0.7),
    (r"\b(currently|right\s+now|at\s+the\s+moment|presently)\b", "context", 0.7),
    (r"\b(working\s+on|focusing\s+on|dealing\s+with)\b", "context", 0.8),
    (r"\b(status|state|phase|stage)\s+(is|of)\b", "context", 0.7),
    (r"\b(in\s+progress|ongoing|active|pending|blocked)\b", "context", 0.8),
    (r"\b(environment|setup|configuration|settings?)\b", "context", 0.6),
    (r"\b(today|this\s+week|this\s+sprint|this\s+quarter)\b", "context", 0.5),
    (r"\b(learned|realized|discovered|found\s+out)\b", "learning", 0.8),
    (r"\b(lesson|takeaway|insight|finding)\b", "learning", 0.9),
    (r"\b(turns?\s+out|surprisingly|interestingly)\b", "learning", 0.7),
    (r"\b(should\s+have|could\s+have|would\s+have)\b", "learning", 0.6),
    (r"\b(best\s+practice|lessons?\s+learned|post[-\s]?mortem)\b", "learning", 0.9),
    (r"\b(noticed|observed|saw|seems?)\b", "observation", 0.7),
    (r"\b(pattern|trend|correlation|tends?\s+to)\b", "observation", 0.9),
    (r"\b(often|frequently|sometimes|rarely|usually)\s+\w+", "observation", 0.6),
    (r"\b(appears?|looks?\s+like|seems?\s+like)\b", "observation", 0.6),
    (r"\b(increasing|decreasing|growing|shrinking|stable)\b", "observation", 0.7),
    (r"\b(every\s+time|whenever|each\s+time)\b", "observation", 0.8),
    (r"\b(error|bug|issue|problem|failure|crash)\b", "error", 0.7),
    (r"\b(broke|broken|failed|failing|doesn't\s+work)\b", "error", 0.8),
    (r"\b(do\s+not|never|avoid|watch\s+out|be\s+careful)\s+\w+\s+(error|bug|issue)\b", "error", 0.9),
    (r"\b(deprecated|obsolete|legacy|outdated)\b", "error", 0.8),
    (r"\b(exception|timeout|crash|hang|freeze)\b", "error", 0.8),
    (r"\b(workaround|hotfix|patch|kludge)\b", "error", 0.7),
    (r"\b(document|doc|spreadsheet|sheet|slide)\b", "artifact", 0.6),
    (r"\b(file|folder|directory|path)\s+(name|called|at)\b", "artifact", 0.7),
    (r"\b(PR|pull\s+request|issue|ticket|ticket)\s+#?\d+", "artifact", 0.9),
    (r"\b(commit|branch|tag|release)\s+[a-f0-9]{7,40}\b", "artifact", 0.9),
    (r"\b(repo|repository|project|codebase)\s+(at|on|in)\b", "artifact", 0.7),
    (r"\b(link|URL|href|reference)\s+(to|for)\b", "artifact", 0.6),
    (r"\b(README|CHANGELOG|LICENSE|CONTRIBUTING)\b", "artifact", 0.9),
]
BOOSTERS = {
    "fact": ["verified", "confirmed", "official", "documented", "according to", "data shows"],
    "preference": ["always", "never", "absolutely", "definitely", "strongly"],
    "decision": ["final", "official", "approved", "agreed", "consensus"],
    "commitment": ["promise", "guarantee", "committed", "deadline", "SLA"],
    "goal": ["target", "objective", "KPI", "OKR", "success metric"],
    "event": ["specifically", "exactly", "precisely", "at", "on"],
    "instruction": ["mandatory", "required", "critical", "important"],
    "relationship": ["directly", "reports to", "managed by", "owned by"],
    "context": ["currently", "right now", "active", "in progress"],
    "learning": ["key lesson", "important finding", "critical insight"],
    "observation": ["consistently", "repeatedly", "over time", "pattern"],
    "error": ["critical", "severe", "blocking", "P0", "P1"],
    "artifact": ["official", "canonical", "source of truth", "reference"],
}
# Prefixes, phrases and separators of the compact encoding.
CATEGORY_CODES = {"PREFERENCE": "PREF", "TRAIT": "TRAIT", "STATUS": "STAT", "INSTRUCTION": "INST", "PROJECT": "PROJ", "LOCATION": "LOC", "FAMILY": "FAM", "OCCUPATION": "OCC", "DECISION": "DEC", "EVENT": "EVT", "TOOL": "TOOL", "FACT": "FACT", "OPINION": "OPN"}
PHRASES = {
    "User asked ": "ASK ",
    "User wants ": "WANT ",
    "User prefers ": "PREF ",
    "User likes ": "LIKE ",
    "User dislikes ": "DISLIKE ",
    "User is ": "IS ",
    "User has ": "HAS ",
    "User built ": "BUILT ",
    "User asked for ": "ASK ",
    "User requested ": "REQ ",
    "Married to ": "MARRIED→",
    "Email: ": "@",
    "GitHub: ": "GH:",
    "Location: ": "LOC:",
    "Phone: ": "PH:",
    "User email is ": "@",
    "User voice message ": "VM ",
    "User stack: ": "STACK|",
    "Full-stack developer": "FSDEV",
    "Software Developer": "SDEV",
    "AI Systems Engineer": "AIENG",
    "real-time": "RT",
    "Real-time": "RT",
    "bilingual": "bi",
    "Bilingual": "bi",
    "self-hosted": "selfhost",
    "automation": "auto",
    "transcription": "transc",
    "translation": "transl",
}
SEPARATORS = [
    (" - ", " | "),
    (" -- ", " | "),
    (" | ", " | "),
    (", ", " | "),
    (" and ", "+"),
    (" or ", "/"),
    (" for ", "→"),
    (" to ", "→"),
    (" with ", " w/ "),
    (" over ", ">"),
    (" instead of ", "!>"),
    (" because of ", "∵"),
    (" due to ", "∵"),
    (" using ", "→"),
    (" built ", "→"),
    (" in ", ":"),
    (" at ", "@"),
    (" on ", "@"),
    (" from ", "<-"),
]


# How types rank, which are consolidated, how fast they fade.
PRIORITY = {"instruction": 10, "commitment": 9, "error": 8, "goal": 7, "decision": 6, "preference": 5, "fact": 4, "relationship": 4, "learning": 3, "observation": 3, "event": 2, "context": 2, "artifact": 1, "unknown": 0}
CONSOLIDATED = ["fact", "preference", "decision", "goal", "learning", "observation", "relationship", "instruction"]
DECAY = {
    "context": 0.9, "event": 0.7, "observation": 0.5, "learning": 0.3, "preference": 0.2, "fact": 0.1, "relationship": 0.1, "instruction": 0.05, "error": 0.05, "decision": 0.3, "commitment": 0.5, "goal": 0.4, "artifact": 0.1, "unknown": 0.5,
}


def _looked_up(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def priority(kind: Column) -> Column:
    return _looked_up(PRIORITY, kind, 0)


def decay_rate(kind: Column) -> Column:
    return _looked_up(DECAY, kind, 0.3)


def memory_type(content: Column) -> Column:
    """struct(type, confidence): each rule that matches scores its confidence times 1 + 0.1 * the type's position; the best wins, of equals the first.

    Longer matches and raising words add to a rule's confidence, up to 1.  Without a
    match a text of under five words is a fact, a longer one context, at 0.3; an
    empty or null text is unknown at 0.
    """
    low = F.lower(content)
    lengths = F.array(*[F.length(F.regexp_extract(low, "(?i)" + pattern, 0)) for pattern, _, _ in TYPE_RULES])
    kinds = list(BOOSTERS)
    raised = F.array(*[sum((F.when(F.contains(low, F.lit(b.lower())), 0.05).otherwise(0.0) for b in BOOSTERS[k]), F.lit(0.0)) for k in kinds])
    rules = F.array(
        *[
            F.struct(F.lit(-i).alias("order"), F.lit(kind).alias("type"), F.lit(base).alias("base"), F.lit(kinds.index(kind)).alias("at"), F.lit(1.0 + 0.1 * TYPES.index(kind)).alias("weight"))
            for i, (_, kind, base) in enumerate(TYPE_RULES)
        ]
    )

    def option(r: Column, n: Column, raises: Column) -> Column:
        longer = F.when(n > 20, 0.1).when(n > 10, 0.05).otherwise(0.0)
        confidence = F.least(r["base"] + longer + F.get(raises, r["at"]), F.lit(1.0))
        return F.struct(F.when(n > 0, F.round(confidence * r["weight"], 9)).alias("score"), r["order"].alias("order"), r["type"].alias("type"), confidence.alias("confidence"))

    # The one-element array binds both arrays to a name, so that each pattern runs once.
    bound = F.array(F.struct(lengths.alias("n"), raised.alias("up")))
    best = F.transform(bound, lambda b: F.array_max(F.filter(F.zip_with(rules, b["n"], lambda r, n: option(r, n, b["up"])), lambda o: o["score"].isNotNull())))[0]
    short = F.size(F.filter(F.split(F.trim(content), r"\s+"), lambda w: w != "")) < 5
    none = content.isNull() | (F.trim(content) == "")
    plain = F.struct(F.when(none, "unknown").when(short, "fact").otherwise("context").alias("type"), F.when(none, 0.0).otherwise(0.3).alias("confidence"))
    pick = lambda b: F.when(~none & b.isNotNull(), F.struct(b["type"].alias("type"), b["confidence"].alias("confidence"))).otherwise(plain)
    return F.transform(F.array(best), pick)[0]


def compact(text: Column) -> Column:
    """The compact encoding: category prefix, phrases longest first, separators in order, tight parentheses."""
    out = text
    for full, code in CATEGORY_CODES.items():
        rest = F.substring(text, F.lit(len(full) + 3), F.length(text))
        out = F.when(F.startswith(text, F.lit(f"{full}: ")), F.concat(F.lit(f"{code}|"), rest)).otherwise(out)
    for phrase, short in sorted(PHRASES.items(), key=lambda x: -len(x[0])):
        out = F.replace(out, F.lit(phrase), F.lit(short))
    for mark, short in SEPARATORS:
        out = F.replace(out, F.lit(mark), F.lit(short))
    return F.replace(F.regexp_replace(out, r"\(\s*", "("), F.lit(" )"), F.lit(")"))
