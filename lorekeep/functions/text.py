"""Text functions: Column in, Column out. Null texts give null (or the empty result named in each docstring)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "do", "does", "for", "from",
    "how", "i", "in", "is", "it", "me", "my", "of", "on", "or", "tell", "that", "the",
    "to", "was", "were", "what", "when", "where", "which", "who", "why", "with", "you",
    "your", "about", "did", "had", "has", "have", "this", "these", "those",
)
#: Arguments of a command that are looked at before all are.
HEAD = 16
CLAIM_STOPWORDS = ("the", "and", "for", "with", "from", "what", "how", "are", "was", "this", "that", "does", "can")
NAME_ALIASES = {"postgres": "postgresql", "pg": "postgresql", "js": "javascript", "ts": "typescript"}
RELATION_ALIASES = {
    "include": "includes", "use": "uses", "contain": "contains", "require": "requires", "return": "returns",
    "run": "runs", "define": "defines", "own": "owns", "provide": "provides", "support": "supports",
    "extend": "extends", "implement": "implements", "depend on": "depends on", "depends_on": "depends on",
}
# Secrets, in the order in which they are masked, and what stays of each. Spark's replacement keeps groups, so
# the groups stand around the secret.
SECRET_PATTERNS = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[redacted]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{16,}", "[redacted]"),
    (r"\bsk-[A-Za-z0-9_-]{16,}", "[redacted]"),
    (r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "[redacted]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[redacted]"),
    (r"(?i)(\bBearer\s+)[A-Za-z0-9._~+/=-]{12,}", "$1[redacted]"),
    (
        r"""(?i)((?<![a-zA-Z0-9])(?:api[_-]?key|secret|token|password|passwd|pwd|auth|credential)(?:[_-][a-zA-Z0-9]+)*+["']?"""
        r"""\s*[:=]\s*["']?)(?!\[redacted\]|Bearer )[^\s"']{6,}""",
        "$1[redacted]",
    ),
)
# Languages by file ending.
LANGUAGES = {
    "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript",
    "tsx": "typescript", "py": "python", "go": "go", "rs": "rust", "scss": "scss",
}


def hash128(*parts: Column) -> Column:
    """First 32 hexadecimal digits of the SHA-256 of the parts, joined without a separator; null parts are empty."""
    joined = F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.substring(F.sha2(joined, 256), 1, 32)


def words(text: Column, separator: str) -> Column:
    """Lower-case stretches between matches of the separator, without empty ones; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), separator), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Words of letters and decimal digits."""
    return words(text, r"[^\p{L}\p{Nd}]+")


def shingles(text: Column, n: int = 3) -> Column:
    """The set of n-word shingles; the set of words where there are fewer than n."""
    found = tokens(text)
    return _bind(
        found,
        lambda w: F.array_distinct(
            F.when(
                F.size(w) >= n,
                F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " ")),
            ).otherwise(w)
        ),
    )


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(left, right))
    either = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(both / either)


def query_terms(text: Column) -> Column:
    """Distinct terms of a query in order: at least two of [a-z0-9], no stop words."""
    found = F.filter(words(text, "[^a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))
    return F.array_distinct(found)


def topic_keys(terms: Column) -> Column:
    """Keys of terms in order: all joined, the first, each neighbouring pair."""
    pairs = F.when(
        F.size(terms) >= 2,
        F.transform(
            F.sequence(F.lit(1), F.size(terms) - 1), lambda i: F.concat(terms[i - 1], F.lit("."), terms[i])
        ),
    ).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(F.array(F.array_join(terms, "."), F.get(terms, 0)), pairs))
    return F.when(F.size(terms) > 0, keys).otherwise(F.array().cast("array<string>"))


def matches_all_prefixes(text: Column, query: str) -> Column:
    """Whether every word of the query begins some word of the text; false for a query without words."""
    wanted = [w for w in re.split(r"[^\w-]+", query.lower()) if w]
    found = words(text, r"[^\p{L}\p{N}_-]+")

    def begins(prefix: str) -> Column:
        return F.exists(found, lambda w: w.startswith(prefix))

    out = F.lit(bool(wanted))
    for prefix in wanted:
        out = out & begins(prefix)
    return out


def distinct_terms(text: Column, longer_than: int, limit: int) -> Column:
    """The first `limit` distinct words of letters and numbers that are longer than given."""
    return F.slice(F.array_distinct(F.filter(words(text, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > longer_than)), 1, limit)


def claim_terms(text: Column) -> Column:
    """The distinct words of a question by which claims are matched: three letters or more, without the commonest."""
    return F.array_distinct(F.filter(words(text, r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*CLAIM_STOPWORDS)))


def collapse(text: Column) -> Column:
    """Lower case, trimmed, each run of white space one space; null gives the empty text."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def _alias(name: Column, aliases: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(table, name), name)


def normalize_entity(name: Column) -> Column:
    return _alias(collapse(name), NAME_ALIASES)


def normalize_relation(name: Column) -> Column:
    return _alias(collapse(name), RELATION_ALIASES)


def normalize_type(name: Column) -> Column:
    """Blank types are concepts."""
    return F.coalesce(F.nullif(collapse(name), F.lit("")), F.lit("concept"))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+", "-"), F.lit("-"))


def command_signature(tool: Column, args: Column, most: int = 4) -> Column:
    """The tool's slug and those of the first arguments that are neither flags nor numbers; bash goes unnamed."""
    raw = F.trim(F.lower(F.coalesce(args, F.lit(""))))

    def named(words: Column) -> Column:
        kept = F.filter(words, lambda t: (t != "") & ~t.startswith("-") & ~t.rlike(r"^\d+$"))
        slugs = F.transform(kept, lambda t: slug(F.regexp_replace(t, r"^\./", "")))
        return F.slice(F.filter(slugs, lambda t: t != ""), 1, most)

    # Few arguments have to be looked at in most cases; all are where the first ones, each whole, do not give enough.
    first = named(F.slice(F.split(raw, r"\s+", HEAD + 1), 1, HEAD))
    body = F.array_join(F.when(F.size(first) == most, first).otherwise(named(F.split(raw, r"\s+"))), "-")
    own = slug(tool)
    return (
        F.when(body == "", F.when(own == "", F.lit("unknown")).otherwise(own))
        .when(own.isin("bash", ""), body)
        .otherwise(F.concat(own, F.lit("-"), body))
    )


def error_digest(text: Column, tail: int = 512) -> Column:
    """A digest of an error's end that ignores case, spacing and line numbers; `none` for a blank one."""
    stripped = F.trim(F.coalesce(text, F.lit("")))
    masked = F.regexp_replace(F.right(stripped, F.lit(tail)), r":\d+(?::\d+)?\b", ":#")
    digest = hash128(F.lower(F.trim(F.regexp_replace(masked, r"\s+", " "))))
    return F.when(stripped == "", F.lit("none")).otherwise(digest)


def redact(text: Column) -> tuple[Column, Column]:
    """The text with secrets masked, and how many were; a masked text stays as it is."""
    hits = F.lit(0)
    for pattern, kept in SECRET_PATTERNS:
        hits = hits + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, kept)
    return text, hits


def truncate_head_tail(text: Column, budget: int, head_share: float = 0.4) -> Column:
    """Texts over the budget lose their middle; a mark says how many characters."""
    head = int(budget * head_share)
    tail = budget - head
    cut = F.concat(
        F.left(text, F.lit(head)),
        F.lit("\n…["), (F.length(text) - budget).cast("string"), F.lit(" chars elided]…\n"),
        F.right(text, F.lit(tail)),
    )
    return F.when((F.lit(budget) <= 0) | (F.length(text) <= budget), text).otherwise(cut)


def normalize_paths(text: Column, root: str, home: str) -> Column:
    for old, new in ((f"{root}/", "./"), (root, "."), (f"{home}/", "~/"), (home, "~")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def scrub(text: Column, budget: int, root: str, home: str) -> Column:
    """Truncated, then redacted, then with short paths."""
    return normalize_paths(redact(truncate_head_tail(text, budget))[0], root, home)


def tokens_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)


def sections(text: Column) -> Column:
    """Parts of a marked-up text, each from a heading of level one or two; what precedes the first is a part."""
    return F.filter(F.split(text, r"(?m)(?=^#{1,2}\s)"), lambda s: F.trim(s) != "")


def grounded(content: Column, source: Column, least: float = 0.6, length: int = 4) -> Column:
    """Whether a statement is borne out by its source.

    Tokens with a digit or a slash must all occur in the source; of the other tokens of at least `length`
    characters the given share must be tokens of the source, and there must be one.
    """
    pattern = F.lit("[a-z0-9./_-]+")
    said, given = F.lower(content), F.lower(source)
    own, known = F.regexp_extract_all(said, pattern, 0), F.regexp_extract_all(given, pattern, 0)
    critical = F.filter(own, lambda t: t.rlike("[0-9/]"))
    plain = F.filter(own, lambda t: ~t.rlike("[0-9/]") & (F.length(t) >= length))
    found = _bind(known, lambda k: F.size(F.filter(plain, lambda t: F.array_contains(k, t))))
    enough = (F.size(plain) > 0) & (found >= F.size(plain) * least)
    return F.coalesce(F.forall(critical, lambda t: F.contains(given, t)) & enough, F.lit(False))


def embed_text(queries: Column, content: Column) -> Column:
    return F.concat_ws(" ", queries, content)


def wiki_title(anchor: Column) -> Column:
    bare = F.regexp_replace(anchor, "^(topic|entity|code|group|split|directory):", "")
    name = F.trim(F.translate(bare, ":_-", "   "))
    return F.when(name == "", F.lit("Evidence")).otherwise(F.concat(F.upper(F.left(name, F.lit(1))), F.substring(name, 2, 1 << 30)))


def language_of(path: Column) -> Column:
    return _alias_or_null(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), LANGUAGES)


def _alias_or_null(name: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), name)


def page_text(html: Column) -> Column:
    """The text of a web page: without scripts, styles and page furniture, tags gone, white space collapsed."""
    for tag in ("script", "style", "noscript", "nav", "header", "footer", "aside", "form"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), r"\s+", " "))


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
