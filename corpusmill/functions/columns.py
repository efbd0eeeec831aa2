"""Scalar functions on columns: languages, hashes, token estimates, guards, tokens and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and their languages.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "rb": "ruby",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp",
    "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala",
    "md": "markdown", "mdx": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "sql": "sql", "sh": "bash", "css": "css", "html": "html",
}

# Folders and file names that are never indexed, and the extensions that are.
SKIPPED_FOLDERS = ["node_modules", ".git", "dist", "build", "out", ".next", "vendor", "target", ".venv", "venv", "__pycache__", ".idea", ".vscode", "coverage", ".turbo", ".cache", "bin", "obj"]
SKIPPED_NAMES = r"\.min\.js$|\.min\.css$|\.lock$|\.map$|^package-lock\.json$"
INDEXED = sorted(LANGUAGES)
MAX_BYTES = 200_000
NUL_WINDOW = 8192

# Patterns of symbol definitions by family of languages, tried in this order.
C_FAMILY = ["java", "csharp", "cpp", "c", "kotlin", "scala", "swift", "php"]
SIGNATURES = [
    (["typescript", "javascript"], r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z0-9_$]+)", "function"),
    (["typescript", "javascript"], r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z0-9_$]+)", "class"),
    (["typescript", "javascript"], r"^\s*(?:export\s+)?interface\s+([A-Za-z0-9_$]+)", "interface"),
    (["typescript", "javascript"], r"^\s*(?:export\s+)?type\s+([A-Za-z0-9_$]+)\s*=", "type"),
    (["typescript", "javascript"], r"^\s*(?:export\s+)?enum\s+([A-Za-z0-9_$]+)", "enum"),
    (["typescript", "javascript"], r"^\s*(?:export\s+)?const\s+([A-Za-z0-9_$]+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>", "function"),
    (["typescript", "javascript"], r"^\s*(?:public|private|protected|static|async|\s)*\s*([A-Za-z0-9_$]+)\s*\([^)]*\)\s*(?::[^{]+)?\{", "method"),
    (["python"], r"^\s*def\s+([A-Za-z0-9_]+)", "function"),
    (["python"], r"^\s*async\s+def\s+([A-Za-z0-9_]+)", "function"),
    (["python"], r"^\s*class\s+([A-Za-z0-9_]+)", "class"),
    (["go"], r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z0-9_]+)", "function"),
    (["go"], r"^\s*type\s+([A-Za-z0-9_]+)\s+(?:struct|interface)", "type"),
    (["rust"], r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z0-9_]+)", "function"),
    (["rust"], r"^\s*(?:pub\s+)?struct\s+([A-Za-z0-9_]+)", "struct"),
    (["rust"], r"^\s*(?:pub\s+)?enum\s+([A-Za-z0-9_]+)", "enum"),
    (["rust"], r"^\s*(?:pub\s+)?trait\s+([A-Za-z0-9_]+)", "trait"),
    (["rust"], r"^\s*impl(?:<[^>]*>)?\s+([A-Za-z0-9_]+)", "impl"),
    (C_FAMILY, r"^\s*(?:public|private|protected|internal|static|final|abstract|\s)*\s*(?:class|interface|struct|enum)\s+([A-Za-z0-9_]+)", "class"),
    (C_FAMILY, r"^\s*(?:public|private|protected|internal|static|final|virtual|override|async|\s)*[A-Za-z0-9_<>,.\[\]]+\s+([A-Za-z0-9_]+)\s*\([^;]*\)\s*\{", "method"),
]
HEADING = r"^#{1,3}\s+(.+)"

# Patterns of instructions hidden in a question.
INJECTIONS = [
    r"ignore\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+(?:instructions|prompts?|context)",
    r"disregard\s+(?:the\s+)?(?:system|previous|above)",
    r"you\s+are\s+now\s+(?:a|an|in)\b",
    r"new\s+(?:instructions?|system\s+prompt)\s*[:.]",
    r"forget\s+(?:everything|all|your\s+instructions)",
    r"reveal\s+(?:your\s+)?(?:system\s+prompt|instructions|api\s+keys?)",
    r"print\s+(?:your\s+)?(?:system\s+prompt|env(?:ironment)?\s+variables?)",
    r"\b(?:exfiltrate|leak)\b.*\b(?:key|token|secret|env)",
    r"do\s+anything\s+now|DAN\s+mode",
]
MAX_QUESTION = 2000

# US dollars per million tokens in and out, by model.
PRICES = [
    ("gpt-4o-mini", 0.15, 0.6), ("gpt-4o", 2.5, 10.0), ("gpt-4.1-mini", 0.4, 1.6),
    ("text-embedding-3-small", 0.02, 0.0), ("text-embedding-3-large", 0.13, 0.0),
    ("gemini-2.5-flash", 0.3, 2.5), ("gemini-2.5-flash-lite", 0.1, 0.4), ("gemini-2.5-pro", 1.25, 10.0), ("gemini-embedding-001", 0.15, 0.0),
    ("local-hashing-vectorizer-1536", 0.0, 0.0),
]

FNV_START, FNV_PRIME, MASK_32 = 2166136261, 16777619, 4294967295


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def detect_lang(path: Column) -> Column:
    """Language by what follows the last dot, in lower case; text for anything unknown."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(F.substring_index(path, ".", -1))), F.lit("text"))


def should_index(path: Column, size: Column) -> Column:
    """Whether a file of that path and size belongs in an index."""
    name = F.substring_index(path, "/", -1)
    return (size > 0) & (size <= MAX_BYTES) & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_FOLDERS))) & ~name.rlike(SKIPPED_NAMES) & F.lower(F.substring_index(name, ".", -1)).isin(INDEXED)


def signed_languages() -> list[str]:
    """Languages that have patterns of signatures."""
    return sorted({x for langs, _, _ in SIGNATURES for x in langs})


def match_signature(line: Column, lang: str) -> Column:
    """struct(symbol, kind) of the first pattern of a language that an unindented line matches, null without any."""
    tries = [F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).alias("symbol"), F.lit(kind).alias("kind"))) for langs, pattern, kind in SIGNATURES if lang in langs]
    return F.when(~F.substring(line, 1, 1).isin(" ", "\t", "\n", "\x0b", "\f", "\r"), F.coalesce(*tries))


def content_hash(path: Column, start0: Column, content: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", path, start0.cast("string"), content)), 1, 16)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def clean_question(q: Column) -> Column:
    return trimmed(F.substring(q, 1, MAX_QUESTION))


def injection_reason(q: Column) -> Column:
    """Start of the first pattern that the question matches, null without any."""
    clean = clean_question(q)
    return F.coalesce(*[F.when(clean.rlike("(?i)" + p), F.lit(f"matched pattern {p[:40]}…")) for p in INJECTIONS])


def fence_untrusted(code: Column) -> Column:
    return F.replace(code, F.lit("```"), F.lit("ʼʼʼ"))


def client_key(forwarded: Column, real_ip: Column) -> Column:
    first = F.when(F.length(forwarded) > 0, trimmed(F.split_part(forwarded, F.lit(","), F.lit(1))))
    return F.coalesce(first, real_ip, F.lit("anonymous"))


def strip_code_lines(content: Column) -> Column:
    """Lines that look like comments or hold a word, joined by spaces, cut at 800 characters."""
    kept = F.filter(F.split(content, "\n"), lambda l: trimmed(l).rlike(r"^//|^\*|^#") | l.rlike(r"(?i)[a-z]{4,}"))
    return F.substring(F.array_join(kept, " "), 1, 800)


def strip_to_prose(content: Column) -> Column:
    """The variant for answers: comment marks go, lines without a word too, cut at 600 characters."""
    bare = F.transform(F.split(content, "\n"), lambda l: trimmed(F.regexp_replace(l, r"^\s*[/*#-]+\s?", "")))
    return F.substring(F.array_join(F.filter(bare, lambda l: l.rlike(r"(?i)[a-z]{4,}")), " "), 1, 600)


def snippet(content: Column, most: int = 1200) -> Column:
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("\n…"))).otherwise(content)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def code_tokens(text: Column) -> Column:
    """Ordered tokens: each word in lower case, then its parts between underscores; then all pieces of camel case."""
    words = F.transform(_matches(F.lower(text), r"[a-z0-9_]+"), lambda t: F.concat(F.array(t), F.filter(F.split(t, "_"), lambda p: (p != "") & (p != t))))
    pieces = F.filter(F.transform(_matches(text, r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"), F.lower), lambda p: F.length(p) > 1)
    return F.concat(F.flatten(words), pieces)


def query_terms(question: Column, most: int = 40) -> Column:
    """Distinct search terms of a question in order of first use."""
    words = F.transform(F.filter(_matches(F.lower(question), r"[a-z0-9_]+"), lambda t: F.length(t) >= 2), lambda t: F.concat(F.array(t), F.filter(F.split(t, "_"), lambda p: F.length(p) >= 2)))
    pieces = F.transform(_matches(question, r"[A-Z]?[a-z]{2,}|[0-9]{2,}"), F.lower)
    return F.slice(F.array_distinct(F.concat(F.flatten(words), pieces)), 1, most)


def char_ngrams(token: Column, low: int = 3, high: int = 5) -> Column:
    """Runs of low to high characters of ^token$, repeats included."""
    s = F.concat(F.lit("^"), token, F.lit("$"))

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))
        return F.when(F.length(s) >= n, every).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(n) for n in range(low, high + 1)])


def fnv1a(feature: Column) -> Column:
    """32-bit FNV-1a of an ASCII string, as a long."""
    codes = F.transform(F.sequence(F.lit(1), F.length(feature)), lambda i: F.ascii(F.substring(feature, i, F.lit(1))).cast("long"))
    return F.aggregate(codes, F.lit(FNV_START).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK_32).cast("long")))


def hash_sign(h: Column) -> Column:
    return F.when(h.bitwiseAND(F.lit(65536).cast("long")) == 0, 1).otherwise(-1)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def rounded(x: Column, places: int) -> Column:
    """x to some places as floating-point engines round: halves of the scaled double go away from zero, and zero keeps its sign.

    round() rounds the decimal digits that a double prints as, and drops the sign.
    """
    scale, whole = F.lit(10.0**places), float(1 << 52)  # doubles from there on are whole numbers
    y = F.abs(x) * scale
    low = F.floor(F.least(y, F.lit(whole))).cast("double")
    near = F.when(y < whole, low + F.when(y - low >= 0.5, 1.0).otherwise(0.0)).otherwise(y)
    return F.when(y == float("inf"), x).otherwise(F.signum(x) * near / scale)


def six_digits(x: Column) -> Column:
    """x to six significant digits."""
    k = F.lit(5) - F.floor(F.log10(F.abs(x)))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * F.pow(F.lit(10.0), k)) / F.pow(F.lit(10.0), k))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def stem(term: Column) -> Column:
    """Harman's S-stemmer: plural endings only."""
    return (
        F.when(~term.endswith("s"), term)  # most words need no pattern
        .when(term.rlike("[^ea]ies$"), F.regexp_replace(term, "ies$", "y"))
        .when(term.rlike("[^aeo]es$"), F.regexp_replace(term, "es$", "e"))
        .when(term.rlike("[^us]s$"), F.regexp_replace(term, "s$", ""))
        .otherwise(term)
    )
