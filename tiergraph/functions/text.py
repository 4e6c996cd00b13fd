"""Column functions over names, paths and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a query drops.
STOP_WORDS = [
    "a", "an", "and", "any", "are", "as", "at", "be", "by", "find", "for", "from", "in", "into", "imports", "importing", "is", "it", "list", "on",
    "or", "the", "this", "that", "these", "those", "to", "using", "was", "were", "what", "when", "where", "which", "who", "why", "with",
]
MAX_QUERY_WORDS = 10
#: A symbol whose source is shorter is shown whole, not summarized.
SMALL_BODY = 500
FUNCTION_KINDS = ["function", "regular_function", "method", "closure", "async_function"]
TYPE_KINDS = ["struct", "class", "enum", "type", "interface", "trait"]

#: A test file by its name: a test, tests or spec part set off by the start, an underscore or a dot.
TEST_NAME = r"^(tests?|spec)_|_(tests?|spec)([._]|$)|\.(test|spec)\."


def tokens(s: Column) -> Column:
    """SF1. Letter and digit runs, cut where an ASCII lower-case letter or digit meets an upper-case one, A-Z in lower case."""
    cut = F.regexp_replace(s, r"([a-z0-9])([A-Z])", "$1 $2")
    low = F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def word_tokens(word: str) -> list[str]:
    """SF1 of one word, off the cluster."""
    cut = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", word)
    return [t for t in re.split(r"[\W_]+", "".join(c.lower() if c.isascii() else c for c in cut)) if t]


def word_matches(s: Column, word: str) -> Column:
    """SF2. Some token of s starts with some token of word; letters are compared as they are, so both are lower-cased before."""
    parts = word_tokens(word)
    if not parts:
        return F.lit(False)

    def hit(t: Column) -> Column:
        out = t.startswith(parts[0])
        for p in parts[1:]:
            out = out | t.startswith(p)
        return out

    return F.exists(tokens(s), hit)


def query_words(query: str) -> list[str]:
    """SF3. White-space words in lower case, kept whole, of two bytes or more, that are no stop words, each once, ten at most."""
    words = [w for w in query.lower().split() if len(w.encode()) >= 2 and w not in STOP_WORDS]
    return list(dict.fromkeys(words))[:MAX_QUERY_WORDS]


def query_words_of(query: Column) -> Column:
    """SF3 of a column of queries."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOP_WORDS))
    return F.slice(F.array_distinct(words), 1, MAX_QUERY_WORDS)


def search_words(query: str) -> list[str]:
    """FIL3. White-space words of two characters or more in lower case, ten at most."""
    return [w for w in query.lower().split() if len(w) >= 2][:MAX_QUERY_WORDS]


def clamp_limit(limit: int | None, default: int = 10, most: int = 30) -> int:
    return min(max(limit or default, 1), most)


def normalize_path(p: Column) -> Column:
    """SF4. Forward slashes, none doubled or at the end, no leading ./; empty becomes a dot."""
    s = F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "/+", "/")
    s = F.regexp_replace(F.regexp_replace(s, r"^(\./)+", ""), "/$", "")
    return F.when(s == "", ".").otherwise(s)


def join_relative(source_file: Column, relative: Column) -> Column:
    """JN10. The posix path of relative seen from source_file's folder; .. steps up, . stays."""
    parts = F.split(F.concat_ws("/", F.regexp_replace(source_file, "/?[^/]*$", ""), relative), "/")

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((part == "") | (part == "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def extension(p: Column) -> Column:
    return F.regexp_extract(basename(p), r"\.([^.]+)$", 1)


def stem(p: Column) -> Column:
    """SF5. File name without its last extension, in lower case; null if empty."""
    name = basename(p)
    s = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return F.when(s != "", F.lower(s))


def contains_word(haystack: Column, needle: Column, source_text: bool = False) -> Column:
    """SF6. needle stands in haystack as a whole word.

    Words are set off by _ and -, or with source_text by anything but letters, digits and _.
    """
    side = "[^A-Za-z0-9_]" if source_text else "[_-]"
    quoted = F.regexp_replace(needle, r"([^A-Za-z0-9_])", r"\\$1")
    return (needle != "") & F.regexp_like(haystack, F.concat(F.lit(f"(^|{side})"), quoted, F.lit(f"({side}|$)")))


def truncate(s: Column, n: int) -> Column:
    """SF7. s if it has n characters or fewer, else its first n - 3 and three dots (the dots alone up to n = 3)."""
    return F.when(F.char_length(s) > n, F.concat(F.left(s, F.lit(max(n - 3, 0))), F.lit("..."))).otherwise(s)


def lines_of(text: Column) -> Column:
    """Lines without their ends, \\n or \\r\\n; what follows the last end is a line unless empty."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def numbered(source: Column) -> Column:
    """SF8. Each line, with its end, after its number and a tab; an empty text has no line."""
    body = F.regexp_replace(source, r"\n\z", "")
    rows = F.array_join(F.transform(F.split(body, "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\t"), x)), "\n")
    return F.when(source == "", "").otherwise(F.concat(rows, F.when(source.endswith("\n"), "\n").otherwise("")))


def is_small_body(body: Column) -> Column:
    """SF8. Fewer than SMALL_BODY characters; no body is not small."""
    return F.coalesce(F.char_length(body) < SMALL_BODY, F.lit(False))


def is_test_file(path: Column) -> Column:
    """FIL9. By file name, or any folder named tests, test, spec or __tests__."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return basename(F.lower(path)).rlike(TEST_NAME) | F.concat(F.lit("/"), low).rlike(r"/(tests|test|spec|__tests__)/")


def is_test_path(path: Column) -> Column:
    """FIL10. By file name, or any path part whose name before the first dot is tests, test, spec or __tests__."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    part = F.exists(F.split(low, "/"), lambda x: F.substring_index(x, ".", 1).isin("tests", "test", "spec", "__tests__"))
    return basename(F.lower(path)).rlike(TEST_NAME) | part


def is_function_kind(kind: Column) -> Column:
    return F.lower(kind).isin(FUNCTION_KINDS)


def is_type_kind(kind: Column) -> Column:
    return F.lower(kind).isin(TYPE_KINDS)


def is_preservable(kind: Column) -> Column:
    """FIL11."""
    return is_function_kind(kind) | is_type_kind(kind)


def is_method(code: Column) -> Column:
    """FIL12. self stands as a word before the first brace or semicolon."""
    return F.regexp_extract(code, r"^([^{;]*)", 1).rlike(r"(^|[^A-Za-z0-9_])self([^A-Za-z0-9_]|$)")


def is_snake(name: Column) -> Column:
    """FIL13. An underscore and no upper-case letter."""
    return name.contains("_") & ~name.rlike(r"\p{IsUppercase}")


def is_camel(name: Column) -> Column:
    """FIL13. A lower-case letter first and an upper-case one later."""
    return name.rlike(r"^\p{IsLowercase}") & name.rlike(r"\p{IsUppercase}")


def under(path: Column, scope: str) -> Column:
    """FIL7, FIL14. path is scope or lies below it; the empty scope holds all."""
    return F.lit(True) if scope in ("", ".") else (path == scope) | path.startswith(scope.rstrip("/") + "/")


def safe_scope(scope: str) -> str:
    """A scope with forward slashes and no end slash; one that climbs out is refused."""
    clean = re.sub("/+", "/", scope.replace("\\", "/")).strip("/")
    clean = clean[2:] if clean.startswith("./") else clean
    if ".." in clean.split("/"):
        raise ValueError("scope may not contain '..'")
    return "" if clean == "." else clean


def doc_summary(text: Column) -> dict[str, Column]:
    """SF9. headings (20), decisions (10), terminology of the first 100 lines (15) and configuration values (10) of a markdown text.

    Decisions are lines of more than 20 bytes that speak of a decision, a design or an architecture;
    terminology has a colon or dash and more than 10 bytes; configuration is a key of capitals and
    underscores, =, and what follows. Lines are given whole, trimmed; a heading without its marks.
    """
    lines = lines_of(text)
    pick = lambda xs, cond, n: F.slice(F.filter(xs, cond), 1, n)
    says = lambda x: F.lower(x).contains("decision") | F.lower(x).contains("designed") | F.lower(x).contains("architecture")
    return {
        "headings": F.transform(pick(lines, lambda x: x.startswith("#"), 20), lambda x: strip(F.regexp_replace(x, "^#+", ""))),
        "decisions": F.transform(pick(lines, lambda x: says(x) & (F.octet_length(x) > 20), 10), strip),
        "terminology": F.transform(pick(F.slice(lines, 1, 100), lambda x: (x.contains(": ") | x.contains(" - ")) & (F.octet_length(x) > 10) & ~x.startswith("#"), 15), strip),
        "config_values": pick(F.transform(lines, strip), lambda x: x.rlike(r"^[\p{IsUppercase}_]+="), 10),
    }


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^[\s\x0b]+|[\s\x0b]+\z", "")


def batch_responses(content: Column, n: int) -> Column:
    """SF10. n texts: place i has that of the last line whose first # is followed by i, a colon and the text (trimmed, empty ones too); else null."""
    if n < 1:
        return F.array().cast("array<string>")
    found = F.transform(lines_of(content), lambda x: F.struct(F.regexp_extract(x, r"^[^#]*#\s*\+?(\d+)\s*:", 1).try_cast("bigint").alias("i"), strip(F.regexp_extract(x, r"^[^#]*#[^:]*:(.*)$", 1)).alias("t")))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.try_element_at(F.filter(found, lambda r: r["i"] == k), F.lit(-1))["t"])


# Schemes of an origin and the port that each implies; bytes of a key.
SCHEME_PORTS = {"https": 443, "ssh": 22, "git": 9418}
MAX_KEY_BYTES = 512


def origin_key(url: Column) -> Column:
    """SF12. host/owner/repo of a git origin in lower case: no scheme, user, standard port, .git or end slash.

    Null for other schemes, control characters, a path of one part or with empty, . or .. parts, a port that is none, and
    keys of more than MAX_KEY_BYTES bytes. Without a scheme the form is host:path, by ssh.
    """
    s = strip(url)
    has_scheme = s.contains("://")
    scheme = F.when(has_scheme, F.lower(F.substring_index(s, "://", 1))).otherwise("ssh")
    rest = F.regexp_replace(F.regexp_replace(s, r"^.*?://", ""), r"^.*@", "")
    scp_host = F.regexp_replace(F.regexp_extract(s, r"^(.*):", 1), r"^.*@", "")
    scp_path = F.regexp_extract(s, r"^.*:(.*)$", 1)
    place = F.when(has_scheme, F.regexp_extract(rest, r"^([^/]*)/", 1)).otherwise(F.when(~scp_path.startswith("/"), scp_host).otherwise(""))
    path = F.when(has_scheme, F.regexp_extract(rest, r"^[^/]*/(.*)$", 1)).otherwise(scp_path)
    port_text = F.regexp_extract(place, r":([^:]*)$", 1)
    host = F.when(place.contains(":"), F.regexp_replace(place, r":[^:]*$", "")).otherwise(place)
    port = F.when(port_text.rlike(r"^\+?\d{1,9}$"), F.regexp_replace(port_text, r"^\+", "").try_cast("int"))
    known = F.create_map(*[F.lit(x) for kv in SCHEME_PORTS.items() for x in kv])
    shown = F.when(~place.contains(":") | (port == known[scheme]), host).otherwise(F.concat(host, F.lit(":"), port.cast("string")))
    trimmed = F.regexp_replace(path, r"/+$", "")
    repo = F.regexp_replace(F.regexp_replace(trimmed, r"\.git$", ""), r"/+$", "")
    key = F.translate(F.concat(shown, F.lit("/"), repo), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    good = scheme.isin(list(SCHEME_PORTS)) & ~s.rlike(r"\p{Cc}") & (host != "") & ~trimmed.rlike(r"(^|/)\.{0,2}(/|$)") & repo.contains("/")
    fits = (~place.contains(":") | port.between(0, 65535)) & (F.octet_length(key) <= MAX_KEY_BYTES)
    return F.when(good & fits, key)


def short_hash(s: Column) -> Column:
    """SF11. First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(s, 256), 1, 16)


def crate_name(s: Column) -> Column:
    """SF16."""
    return F.replace(F.lower(s), F.lit("-"), F.lit("_"))


# Licences that may be redistributed, and why others may not.
PERMISSIVE = ["apache-2.0", "mit", "bsd-3-clause", "bsd-2-clause", "isc", "unlicense"]
RESTRICTIVE = {
    "qwen-research": "Qwen RESEARCH LICENSE AGREEMENT \u2014 non-commercial only",
    "qwen research license agreement": "Qwen RESEARCH LICENSE AGREEMENT \u2014 non-commercial only",
    "gpl-3.0": "GPL-3.0 \u2014 copyleft, incompatible with proprietary redistribution",
    "agpl-3.0": "AGPL-3.0 \u2014 copyleft, incompatible with proprietary redistribution",
}
UNRECOGNISED = "unrecognised licence \u2014 cannot verify redistribution rights"


def license_class(name: Column) -> dict[str, Column]:
    """SF13. status (admissible or excluded) and, for excluded ones, the reason."""
    low = strip(F.lower(name))
    good = F.coalesce(low.isin(PERMISSIVE), F.lit(False))
    reasons = F.create_map(*[F.lit(x) for kv in RESTRICTIVE.items() for x in kv])
    return {"status": F.when(good, "admissible").otherwise("excluded"), "reason": F.when(~good, F.coalesce(reasons[low], F.lit(UNRECOGNISED)))}


def missing_summary(summary: Column, name: Column) -> Column:
    """FIL15. No summary, and the name is no test's."""
    return summary.isNull() & ~F.lower(name).startswith("test_")
