"""Tokens, symbols and terms of texts and questions, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of identifiers and prose: a letter and small letters; capitals before a
# capitalised word, a digit or an edge; a capital; digits. White space, _ / . - and all else part them.
# An underscore parts words too, so capitals may stand before one.
WORDS = r"[a-zA-Z][a-z]+|[A-Z]+(?=[A-Z][a-z]|[0-9]|_|\b)|[A-Z][a-z]*|[0-9]+"

# Words that are no search terms.
STOP_WORDS = [
    "where", "is", "are", "the", "a", "an", "how", "does", "what", "which", "files", "file", "function", "method", "class", "in", "of", "to", "and",
    "or", "it", "this", "that", "for", "on", "with", "all", "find", "me", "show", "explain",
]

# Intents in the order that breaks ties, and the patterns that vote for them.
INTENT_RULES = [
    ("LOCATION", ["where is", "find", "locate", "which file", "where are", "implementation of"]),
    ("EXPLANATION", ["what does", "explain", "describe", "how does", "what is"]),
    ("ARCHITECTURE", ["architecture", "overview", "structure", "main module", "components"]),
    ("FLOW", ["flow", "trace", "end-to-end", "step by step", "journey", "from.*to"]),
    ("DEPENDENCY", ["depends on", "dependency", "dependencies", "which files depend", "who uses"]),
    ("IMPACT", ["impact", "affect", "if i change", "if i modify", "what breaks", "what would break"]),
    ("DEBUGGING", ["error", "bug", "fail", "exception", "crash", "broken", "debug"]),
    ("CONFIGURATION", ["config", "configuration", "environment variable", "env var", "setting", ".env"]),
    ("SYMBOL_LOOKUP", ["implement", "definition of", "implemented in", "declared in"]),
    ("DOCUMENTATION", ["documentation", "comment", "docstring", "readme"]),
    ("ONBOARDING", ["new developer", "onboarding", "getting started", "first", "understand"]),
    ("COMPARISON", ["compare", "difference between", "vs", "versus", "similar"]),
]
GENERAL = "GENERAL_CODEBASE_QA"
MULTI_HOP = ["trace", "from.*to", "end.to.end", "complete.*flow", "full.*flow", "what.*happen.*when", "journey", "chain", "path", "step.*by.*step"]

# Words that widen a question, by the word they stand for.
SYNONYMS = {
    "login": ["authenticate", "signin", "sign_in", "loginUser", "AuthService", "LoginController"],
    "authentication": ["auth", "authenticate", "jwt", "token", "AuthService", "login", "signIn"],
    "register": ["signup", "registration", "createUser", "UserRegistration", "sign_up"],
    "user": ["UserService", "UserRepository", "UserController", "account"],
    "order": ["OrderService", "OrderRepository", "OrderController", "cart", "purchase"],
    "payment": ["PaymentService", "transaction", "billing", "checkout", "stripe"],
    "database": ["db", "repository", "dao", "datasource", "connection", "orm", "entity"],
    "token": ["jwt", "jwtService", "generateToken", "validateToken", "bearer"],
    "password": ["hash", "bcrypt", "passwordEncoder", "checkPassword"],
    "config": ["settings", "environment", "env", ".env", "properties"],
}


def tokenize(text: Column) -> Column:
    """Lower-case words of identifiers and prose; a text without any gives itself in lower case."""
    found = F.array(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)))  # named by a lambda, so that a text is matched once
    return F.get(F.transform(found, lambda tokens: F.when(F.size(tokens) == 0, F.array(F.lower(text))).otherwise(F.transform(tokens, F.lower))), F.lit(0))


def query_tokens(question: Column) -> Column:
    """Tokens of a question, behind the whole question unless that is one of them."""
    raw, tokens = F.lower(F.trim(question)), tokenize(question)
    return F.when(F.array_contains(tokens, raw), tokens).otherwise(F.concat(F.array(raw), tokens))


# How a question names a symbol, tried in this order. The last pattern's suffixes are alternatives of one group.
EXACT_SYMBOL = [
    r"`([A-Za-z_][\w.]*)`",
    r'"([A-Za-z_][\w.]*)"',
    r"\b([A-Z][A-Za-z0-9]*(?:\.[a-z][A-Za-z0-9]*)+)\b",
    r"\b([A-Z][A-Za-z]{3,}(?:Service|Controller|Repository|Handler|Manager))\b",
]


def exact_symbol(question: Column) -> Column:
    """The symbol a question names: in backticks, in quotes, dotted, or a class by its suffix; else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(question, p, 1), F.lit("")) for p in EXACT_SYMBOL))


def search_terms(question: Column) -> Column:
    """Up to ten terms: the exact symbol, then identifiers over two letters that are no stop words."""
    words = F.regexp_extract_all(question, F.lit(r"[A-Za-z_]\w*"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(STOP_WORDS))
    exact = exact_symbol(question)
    return F.slice(F.array_distinct(F.concat(F.when(exact.isNull(), F.array().cast("array<string>")).otherwise(F.array(exact)), kept)), 1, 10)


def expanded_terms(question: Column, terms: Column) -> Column:
    """Up to twenty: terms, synonyms of base words inside the question, and the question itself."""
    lowered = F.lower(F.trim(question))
    more = [F.when(lowered.contains(base), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for base, words in SYNONYMS.items()]
    return F.slice(F.array_distinct(F.concat(terms, *more, F.array(lowered))), 1, 20)


def intent_hits(question: Column) -> Column:
    """Array of (intent, hits, rule) structs, one for each rule."""
    lowered = F.lower(F.trim(question))
    votes = [
        F.struct(F.lit(name).alias("intent"), sum((F.when(lowered.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0)).alias("hits"), F.lit(i).alias("rule"))
        for i, (name, patterns) in enumerate(INTENT_RULES)
    ]
    return F.array(*votes)


def intent(question: Column) -> tuple[Column, Column]:
    """(intent, confidence): most hits, the earlier rule at a tie; none: the general intent at 0.4."""
    best = F.array_max(F.transform(intent_hits(question), lambda v: F.struct(v["hits"].alias("hits"), (-v["rule"]).alias("order"), v["intent"].alias("intent"))))
    hits = best["hits"]
    return F.when(hits == 0, GENERAL).otherwise(best["intent"]), F.when(hits == 0, 0.4).otherwise(F.least(F.lit(0.4) + F.lit(0.2) * hits, F.lit(0.95)))


def multi_hop(question: Column) -> Column:
    lowered = F.lower(F.trim(question))
    out = F.lit(False)
    for p in MULTI_HOP:
        out = out | lowered.rlike(p)
    return out


def embedding_text(symbol_type: Column, qualified: Column, path: Column, doc: Column, code: Column) -> Column:
    """What a symbol's vector is made of, null parts left out."""
    return F.concat_ws("\n", F.concat(symbol_type, F.lit(": "), qualified), F.concat(F.lit("file: "), path), F.substring(doc, 1, 500), F.substring(code, 1, 1200))


def lexical_text(qualified: Column, name: Column, path: Column, doc: Column, code: Column) -> Column:
    """What a symbol's postings are made of, null parts as empty strings."""
    none = F.lit("")
    return F.concat_ws(" ", *(F.coalesce(c, none) for c in (qualified, name, path, doc)), F.coalesce(F.substring(code, 1, 400), none))


def evidence_grade(answer: Column) -> Column:
    """How sure an answer's own words are."""
    low = F.lower(answer)
    return F.when(low.contains("insufficient evidence") | low.contains("not found"), "NOT_FOUND").when(low.contains("inferred") | low.contains("likely"), "INFERRED").otherwise("CONFIRMED")


def short_label(name: Column, width: int = 30) -> Column:
    """Names over the width end in an ellipsis."""
    return F.when(F.length(name) > width, F.concat(F.substring(name, 1, width - 3), F.lit("…"))).otherwise(name)


def compact_number(n: Column) -> Column:
    """12, 1.5K, 2.0M."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1000, F.format_string("%.1fK", n / 1000)).otherwise(n.cast("string"))


def relative_time(at: Column, now: Column) -> Column:
    """just now, 5m ago, 3h ago, 2d ago, each rounded down; a time to come is just now."""
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 60_000_000)
    said = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, said(minutes, "m")).when(minutes < 1440, said(minutes / 60, "h")).otherwise(F.when(minutes.isNotNull(), said(minutes / 1440, "d")))


# What an answer is asked to do for an intent.
INSTRUCTIONS = {
    "ARCHITECTURE": "Name the main parts, what each is for, and how they depend on each other.",
    "FLOW": "Follow the calls in order from the entry point, and cite each step.",
    "IMPACT": "List what depends on the symbol directly, then what depends on that.",
    "DEPENDENCY": "List what the symbol uses and what uses it.",
    "DEBUGGING": "Name likely causes and where in the code each would show.",
    "CONFIGURATION": "Name the settings, their defaults and where they are read.",
    "ONBOARDING": "Start with what to read first and say why.",
}
DEFAULT_INSTRUCTION = "Answer from the cited code alone, and say so if it is not enough."


def instruction(intent_: Column) -> Column:
    """The instruction of an intent."""
    known = F.create_map(*(F.lit(x) for kv in INSTRUCTIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, intent_), F.lit(DEFAULT_INSTRUCTION))
