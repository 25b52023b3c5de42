"""Column expressions over names, paths and source text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffix -> language.
EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "cpp",
    ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".dart": "dart", ".scala": "scala",
}
#: Other names of languages.
LANGUAGE_ALIASES = {"c++": "cpp", "c#": "csharp", "cs": "csharp"}
#: Concerns in their order, as substring patterns.
CONCERNS = {
    "api_controllers": "controller|endpoint|api|route|handler|websocket",
    "services_logic": "service|manager|processor|executor|engine",
    "persistence_db": "repository|model|entity|schema|dao|migration|sql|database",
    "events_messaging": "kafka|redis|consumer|producer|event|queue|rabbit",
    "frontend_ui": "component|page|view|frontend|react|jsx|tsx|html|css",
    "tests": "test|spec|mock|testing",
}
#: Words that never count as symbols of a query.
STOP_WORDS = ("the", "and", "for", "how", "where", "what", "function", "class", "method", "def", "code", "file", "all")
ENTRY_POINT = "route|endpoint|controller|handler|main|cli|job|task|listener|event|run"


def tokens(text: Column) -> Column:
    """Identifier-aware tokens of a text, with repeats.

    Each run of ASCII letters, digits and underscores gives itself in lower case; its parts between
    underscores, if it has any; and its camel-case parts, if there is more than one. Parts of a
    snake-case name therefore count twice. Null gives null, an empty text no tokens.
    """

    def one(t: Column) -> Column:
        snake = F.when(F.contains(t, F.lit("_")), F.filter(F.split(F.lower(t), "_"), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
        camel = F.regexp_extract_all(t, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\d|\W|$)|\d+)"), F.lit(1))
        return F.concat(F.array(F.lower(t)), snake, F.when(F.size(camel) > 1, F.transform(camel, F.lower)).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit("([a-zA-Z0-9_]+)"), F.lit(1)), one))


def query_symbols(query: Column) -> Column:
    """The words of a query that may name symbols: the whole query, then its identifiers of three or
    more characters that are no stop words, without repeats."""
    words = F.filter(F.regexp_extract_all(query, F.lit("([a-zA-Z0-9_]{3,})"), F.lit(1)), lambda w: ~F.lower(w).isin(*STOP_WORDS))
    return F.array_distinct(F.filter(F.concat(F.array(F.trim(query)), words), lambda w: w != ""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """Language by suffix, null if the suffix is not registered."""
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[extension(path)]


def language_alias(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv])[low], low)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def concern(path: Column, name: Column) -> Column:
    """The first concern whose pattern occurs in "path name", else ``general``."""
    target = F.lower(F.concat_ws(" ", F.coalesce(path, F.lit("")), F.coalesce(name, F.lit(""))))
    out = None
    for k, p in CONCERNS.items():
        out = F.when(target.rlike(p), k) if out is None else out.when(target.rlike(p), k)
    return out.otherwise("general")


def requested_concerns(query: Column) -> Column:
    low = F.lower(query)
    return F.filter(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in CONCERNS.items()]), lambda x: x.isNotNull())


def relationship(source: Column, target: Column) -> Column:
    """The label of a dependency between two files, by rules in order."""
    s, t = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(target, F.lit("")))
    return (
        F.when(s.contains("controller") & t.contains("service"), "exposes_endpoint_to_service")
        .when(s.contains("consumer") & t.contains("service"), "consumes_event_triggers_service")
        .when(s.contains("service") & t.rlike("repository|entity|model"), "manages_persistence")
        .when(s.rlike("test|spec"), "tests_implementation")
        .when(t.rlike("test|spec"), "tested_by")
        .otherwise("imports")
    )


def match_type(query: Column, name: Column, path: Column, method: Column, exact: Column) -> Column:
    q, n, p = F.lower(query), F.lower(F.coalesce(name, F.lit(""))), F.lower(path)
    on_path = F.exists(F.split(q, r"\s+"), lambda w: (F.length(w) > 3) & F.contains(p, w))
    return (
        F.when(exact | ((n != "") & F.contains(q, n)), "exact_symbol").when(on_path, "path_keyword")
        .when(method == "dense_vector", "semantic_vector").when(method == "bm25", "keyword_bm25").otherwise("hybrid_rrf")
    )


def match_confidence(kind: Column, score: Column) -> Column:
    return (
        F.when(kind == "exact_symbol", "very_high")
        .when(kind == "semantic_vector", F.when(score > 0.5, "high").otherwise("medium"))
        .when(kind == "keyword_bm25", "medium")
        .otherwise(F.when(score > 0.03, "high").otherwise("medium"))
    )


def match_reason(kind: Column, name: Column, path: Column, score: Column) -> Column:
    """A sentence for people about why a row was returned."""
    return (
        F.when(kind == "exact_symbol", F.format_string("defines the symbol %s", name))
        .when(kind == "path_keyword", F.format_string("path %s holds words of the query", path))
        .when(kind == "semantic_vector", F.format_string("vector similarity %.3f", score))
        .when(kind == "keyword_bm25", F.lit("shares rare words with the query"))
        .otherwise(F.lit("ranked by words and vectors together"))
    )


def lines_of(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")


def signature(content: Column) -> Column:
    """The first line that is not blank, trimmed; empty if there is none."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(content, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), F.lit(0)), F.lit(""))


def docstring(content: Column) -> Column:
    """At most 200 characters between the first two triple quotes (double, else single), else null."""
    pick = None
    for q in ('"""', "'''"):
        parts = F.split(content, q)
        cut = F.substring(F.regexp_replace(F.get(parts, F.lit(1)), r"^\s+|\s+$", ""), 1, 200)
        case = F.when(F.size(parts) >= 3, cut)
        pick = F.when(content.contains(q), case) if pick is None else pick.when(content.contains(q), case)
    return F.when(pick != "", pick)


def repo_of_url(url: Column) -> tuple[Column, Column]:
    """(organisation, repository) of a repository address, cleaned; fallbacks where none is found."""
    u = F.regexp_replace(F.trim(url), r"\.git$", "")
    pat = r"[:/]([a-zA-Z0-9_\-\.]+)/([a-zA-Z0-9_\-\.]+)$"
    clean = lambda i: F.regexp_replace(F.lower(F.regexp_extract(u, pat, i)), "[^a-zA-Z0-9_]", "_")
    ok = F.coalesce(u.rlike(pat), F.lit(False))
    return F.when(ok, clean(1)).otherwise("external_org"), F.when(ok, clean(2)).otherwise("git_repo")


def collection_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-zA-Z0-9_-]", "_")


def point_id(org: Column, dept: Column, repo: Column, path: Column, start: Column, end: Column, name: Column, content: Column) -> Column:
    """A deterministic id of a block's content and place."""
    e = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws(":", e(org), e(dept), e(repo), e(path), e(start), e(end), e(name), F.sha2(e(content), 256)), 256)


def truncated(content: Column, limit: Column) -> Column:
    return F.when((limit > 0) & (F.length(content) > limit), F.concat(F.substring(content, F.lit(1), limit), F.lit("\n... [truncated]"))).otherwise(content)
