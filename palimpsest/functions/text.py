"""String functions as column expressions; patterns read alike in Java and RE2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a line's variables are masked with, most specific first.
MASKS = (
    (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "<email>"),
    (r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s\"']+", "<url>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<ip>"),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:?\d{2})?", "<ts>"),
    (r"\b(?:0x)?[0-9a-fA-F]{16,}\b", "<hex>"),
    (r"\b\d+(?:\.\d+)?(?:ns|us|ms|s|m|h)\b", "<dur>"),
    (r"(?:^|\s)/(?:[A-Za-z0-9._\-]+/)+[A-Za-z0-9._\-]*", " <path>"),
    (r"\b\d+(?:\.\d+)?\b", "<num>"),
)
#: Named patterns of text that tries to steer its reader.
INJECTIONS = (
    ("override_instructions", r"(?i)\b(ignore|disregard|forget)\b[^.]{0,40}\b(previous|prior|above|earlier|all)\b[^.]{0,20}\b(instruction|prompt|rule|direction)"),
    ("assert_conclusion", r"(?i)\b(the\s+)?root\s+cause\s+is\b|\bconclude\s+that\b|\bstop\s+investigating\b|\bno\s+further\s+investigation\b"),
    ("redirect_tooling", r"(?i)\b(call|fetch|curl|POST|GET)\b[^.]{0,30}\b(https?://|endpoint|webhook|api\s+key)"),
    ("raise_privilege", r"(?i)\b(raise|increase|remove|disable)\b[^.]{0,30}\b(budget|limit|guardrail|verification|read-only|readonly)"),
    ("impersonate_operator", r"(?i)\b(system|operator|administrator)\s*[:>]\s|\bnew\s+instructions?\b|\byou\s+are\s+now\b"),
)
#: Classes of words in incident chat.
TERMS = (
    ("deploy", r"(?i)\b(deploy(s|ed|ing|ment|ments)?|re-?deploy(ed|ing)?|releas(e|ed|ing)|ship(ped|ping)?|roll(ed|ing)?[ -]?out|rollout)\b"),
    ("flag", r"(?i)\b(feature[ -]?flags?|flag(s|ged|ging)?|toggl(e|ed|ing)|kill[ -]?switch(es)?)\b"),
    ("mitigated", r"(?i)\b(mitigat(e|ed|ing|ion)|resolved|recover(ed|ing|y)|back to normal|stable now|all clear|fixed)\b"),
    ("restart", r"(?i)\b(restart(s|ed|ing)?|reboot(s|ed|ing)?|bounc(e|ed|ing)|recycl(e|ed|ing)|kill(ed)? the pods?)\b"),
    ("rollback", r"(?i)\b(roll(ed|ing)?[ -]?back|rollback|revert(s|ed|ing)?)\b"),
    ("scale", r"(?i)\b(scal(e|ed|ing)[ -]?(up|down|out|in)|autoscal(e|ed|er|ing)|replicas?|add(ed|ing)? (nodes|capacity|instances))\b"),
    ("vendor", r"(?i)\b(vendor|third[ -]party|provider|status ?page|upstream (outage|incident)|their (outage|incident))\b"),
)
#: Endings that say how a service is deployed, not what it is.
NAME_SUFFIXES = r"(-svc|-service|-deploy|-deployment|-app)+$"
TRAILING_KINDS = ("api", "svc", "service", "web", "worker")


def masked(line: Column) -> Column:
    out = reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), MASKS, line)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def matched(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """Names of the patterns that a text matches, in their order."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in patterns)))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, two characters at least."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2)


def normalised_name(value: Column) -> Column:
    """Last path segment, lower case, one separator, without deployment endings (unless nothing would be left) or separators."""
    last = F.lower(F.trim(F.element_at(F.split(value, "/"), -1)))
    dashed = F.regexp_replace(F.regexp_replace(last, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    bare = F.regexp_replace(dashed, NAME_SUFFIXES, "")
    return F.regexp_replace(F.when(bare == "", dashed).otherwise(bare), "-", "")


def name_tokens(value: Column) -> Column:
    """A name's words, without a trailing deployment kind."""
    words = F.filter(F.split(F.lower(value), "[^a-z0-9]+"), lambda t: t != "")
    return F.when((F.size(words) > 1) & F.element_at(words, -1).isin(*TRAILING_KINDS), F.slice(words, 1, F.size(words) - 1)).otherwise(words)


def jaccard(a: Column, b: Column) -> Column:
    total = F.size(F.array_union(a, b))
    return F.when(total == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / total)


def name_score(a: Column, b: Column) -> Column:
    """0.85 for names that are equal word by word, 0.45 + 0.4 times their Jaccard index from 0.5 on, else 0."""
    x, y = name_tokens(a), name_tokens(b)
    j = jaccard(F.array_distinct(x), F.array_distinct(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(x == y, 0.85).when(j >= 0.5, 0.45 + 0.4 * j).otherwise(0.0)


def slug(value: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(dashed, 1, 63), "^-+|-+$", "")


def section_digest(label: Column, part: Column, text: Column) -> Column:
    return F.sha2(F.concat(label, F.char(F.lit(0)), part.cast("string"), F.char(F.lit(0)), text), 256)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def term_key(*fields: Column) -> Column:
    """Key of a normalised query term: the digest of its fields as JSON."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


#: Last labels of host names inside a network.
INTERNAL = ("local", "localdomain", "internal", "intranet", "lan", "home", "arpa", "cluster", "svc")


def short_host(host: Column) -> Column:
    """What a host is called: the first label of a name inside the network, the last but one of a public name, an address whole.

    Case, a port, brackets and a last dot don't count. Null and blank give an empty name.
    """
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(host, F.lit("")))), r"\.$", "")
    name = F.when(bare.rlike(r"^\[.*\](:[^:]*)?$"), F.regexp_extract(bare, r"^\[(.*)\]", 1)).otherwise(F.regexp_replace(bare, r"^([^:]+):[^:]*$", "$1"))
    labels = F.split(name, r"\.")
    inside = F.element_at(labels, -1).isin(*INTERNAL) | F.array_contains(labels, "svc")
    address = name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | name.contains(":")
    return F.when(address, name).when((F.size(labels) < 2) | inside, F.element_at(labels, 1)).otherwise(F.try_element_at(labels, F.lit(-2)))


def pieces(text: Column, most: int) -> Column:
    """A text in pieces of at most `most` characters, cut at spaces where there are any."""
    return F.filter(F.regexp_extract_all(text, F.lit(rf"(?s)\S.{{0,{most - 1}}}(?=\s|$)|\S{{{most}}}"), F.lit(0)), lambda p: F.trim(p) != "")
