"""Scalar functions on refs, stamps, pseudonyms, selectors, headers and JSON. Built-in expressions, but for JSON documents
of any shape, which go through Arrow-batched functions."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a pseudonym begins with, and how many hex digits follow.
PSEUDONYM, DIGITS = "px_", 16
#: Shapes in which a person is written.
PERSON = (
    r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    r"(?:^|\s)@[A-Za-z][A-Za-z0-9._\-]{2,}",
    r"\buser:[^\s,\"]+",
    r"\bserviceAccount:[^\s,\"]*@[^\s,\"]+",
)
#: The naming rule of incident channels and the words that make one a drill.
CHANNEL = r"^sev([0-9])-([0-9]{4}-[0-9]{2}-[0-9]{2})(?:-([a-z0-9][a-z0-9_-]*))?$"
DRILLS = ("test", "drill", "gameday")
#: The mount under which a database's socket lies.
SOCKETS = "/cloudsql/"
#: Characters of an excerpt, and of what stands before the match.
EXCERPT, LEAD = 120, 20


def parse_ref(text: Column) -> Column:
    """namespace and value of namespace=value, at the first sign; null where either is empty."""
    at = F.locate("=", text)
    return F.when((at > 1) & (at < F.length(text)), F.struct(F.substring(text, F.lit(1), at - 1).alias("namespace"), F.substring(text, at + 1, F.length(text)).alias("value")))


def pseudonym(value: Column, key: bytes) -> Column:
    """Keyed pseudonym (HMAC-SHA-256, 16 hex digits after px_); empty stays empty, and a pseudonym stays as it is."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    mac = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)
    return F.when((value == "") | value.startswith(PSEUDONYM), value).otherwise(F.concat(F.lit(PSEUDONYM), F.substring(mac, 1, DIGITS)))


def image_ref(value: Column) -> Column:
    """name@algorithm:hex of an image pinned by a digest, without its tag; null for any other."""
    name, digest = F.regexp_extract(value, r"^(.*)@([^@]*)$", 1), F.lower(F.regexp_extract(value, r"^(.*)@([^@]*)$", 2))
    name = F.regexp_replace(name, r":[^:/]*$", "")
    return F.when((name != "") & digest.rlike("^[^:]+:[0-9a-f]+$"), F.concat(name, F.lit("@"), digest))


def version_stamp(value: Column) -> Column:
    """namespace, value and reason: a stamped value as commit, pinned image or release, or why it is none of them.

    A commit is whole (40 or 64 hex digits); the more specific reading wins.
    """
    v = F.trim(F.coalesce(value, F.lit("")))
    low = F.lower(v)
    image = image_ref(v)

    def ref(namespace: str, value: Column) -> Column:
        return F.struct(F.lit(namespace).alias("namespace"), value.alias("value"), F.lit(None).cast("string").alias("reason"))

    def none(reason: str) -> Column:
        return F.struct(F.lit(None).cast("string").alias("namespace"), F.lit(None).cast("string").alias("value"), F.lit(reason).alias("reason"))

    out = F.when(low.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$"), ref("deploy.commit_sha", low)).when(image.isNotNull(), ref("deploy.image", image))
    out = out.when((v == "") | v.rlike(r"[ \t\n\r]"), none("NOT_A_STABLE_IDENTIFIER")).when(low.rlike("^[0-9a-f]{7,39}$"), none("ABBREVIATED_SHA"))
    return out.when(low.rlike("^sha(256|512):"), none("BARE_DIGEST")).when(v.contains("/") & ~v.contains("@"), none("MUTABLE_TAG")).otherwise(ref("deploy.release", v))


def repository(value: Column) -> Column:
    """owner/repository in lower case; null without both or with blanks or further slashes."""
    low = F.lower(F.trim(value))
    owner, name = F.trim(F.split_part(low, F.lit("/"), F.lit(1))), F.trim(F.regexp_extract(low, r"^[^/]*/(.*)$", 1))
    whole = F.concat(owner, F.lit("/"), name)
    return F.when(whole.rlike(r"^[^\s/]+/[^\s/]+$"), whole)


def incident_channel(name: Column) -> Column:
    """severity, date, slug and skipped (why a channel's name declares no incident)."""
    low = F.lower(F.trim(name))
    part = lambda i: F.regexp_extract(low, CHANNEL, i)
    words = F.filter(F.split(part(3), "[-_]"), lambda w: w != "")
    drill = F.try_element_at(F.filter(words, lambda w: w.isin(*DRILLS)), F.lit(1))
    date = F.to_date(F.try_to_timestamp(part(2), F.lit("yyyy-MM-dd")))
    skipped = F.when(~low.rlike(CHANNEL), "no_match").when(date.isNull(), "bad_date").when(drill.isNotNull(), F.concat(F.lit("excluded "), drill))
    told = lambda c: F.when(skipped.isNull(), c)
    return F.struct(told(F.concat(F.lit("sev"), part(1))).alias("severity"), told(date).alias("date"), told(part(3)).alias("slug"), skipped.alias("skipped"))


def socket_connection(address: Column) -> Column:
    """project:region:instance of a database's socket path; null unless it has three parts without blanks."""
    rest = F.regexp_extract(F.trim(address), rf"^{SOCKETS}([^/]*)", 1)
    return F.when(rest.rlike(r"^[^:\s]+:[^:\s]+:[^:\s]+$"), rest)


def deprecated_at(header: Column) -> Column:
    """The instant of a Deprecation header: @ and whole seconds, or an HTTP date; null for anything else, as true is."""
    v = F.trim(header)
    seconds = F.when(v.rlike(r"^@\s*[+-]?\d+\s*$"), F.timestamp_seconds(F.regexp_extract(v, r"([+-]?\d+)", 1).try_cast("long")))
    return F.coalesce(seconds, http_date(v))


def http_date(value: Column) -> Column:
    """An HTTP date (Sun, 06 Nov 1994 08:49:37 GMT) as instant; null for anything else."""
    shaped = F.trim(value).rlike(r"^[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} GMT$")
    return F.when(shaped, F.try_to_timestamp(F.concat(F.substring(F.trim(value), 6, 20), F.lit(" +0000")), F.lit("dd MMM yyyy HH:mm:ss Z")))


def looks_like_person(value: Column) -> Column:
    out = F.lit(False)
    for pattern in PERSON:
        out |= value.rlike(pattern)
    return out


def excerpt(text: Column, pattern: str) -> Column:
    """What stands around a pattern's first match: EXCERPT characters, from LEAD before it, and … if more follows; null without a match."""
    found = F.regexp_extract(text, f"({pattern})", 1)
    start = F.greatest(F.lit(1), F.position(found, text) - LEAD)
    some = F.trim(F.substring(text, start, F.lit(EXCERPT)))
    return F.when(found != "", F.concat(some, F.when(start + EXCERPT - 1 < F.length(text), "…").otherwise("")))


def selector(attributes: Column, keys: list[str], metric: str | None = None) -> Column:
    """key="value" AND ... of a map's keys in the order given, without those it lacks; metric: the instrument, last."""
    quoted = lambda v: F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    parts = [F.when(F.map_contains_key(attributes, F.lit(k)), F.concat(F.lit(f"{k}="), quoted(F.element_at(attributes, F.lit(k))))) for k in keys]
    if metric is not None:
        parts.append(F.concat(F.lit("metric.name="), quoted(F.lit(metric))))
    return F.concat_ws(" AND ", *parts)


def selector_facts(text: Column, fields: list[str]) -> Column:
    """A struct of the values that a selector's equalities field="value" give, null for the fields that it doesn't name."""
    found = lambda f: F.nullif(F.regexp_extract(text, rf'(?:^|[\s(]){re.escape(f)}\s*=\s*"([^"]*)"', 1), F.lit(""))
    return F.struct(*(found(f).alias(f.replace(".", "_")) for f in fields))


def window_start(at: Column, seconds: int) -> Column:
    """The start of the epoch-aligned window of an instant."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(at) / seconds) * seconds)


class _Literal(str):
    """A number as it was written."""


_INSTANT = re.compile(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")


def _instant(text: str) -> str | None:
    """An RFC 3339 instant in UTC, its fraction without trailing zeros; None for any other text."""
    m = _INSTANT.match(text)
    if not m:
        return None
    try:
        at = datetime.fromisoformat(text[:19] + (m.group(2) if m.group(2) != "Z" else "+00:00")).astimezone(UTC)
    except ValueError:
        return None
    fraction = (m.group(1) or "").rstrip("0").rstrip(".")
    return f"{at:%Y-%m-%dT%H:%M:%S}{fraction}Z"


def canonical(value) -> str:
    """Canonical JSON: keys sorted, no blanks, numbers as written, instants in UTC."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, _Literal):
        return value
    if isinstance(value, str):
        return json.dumps(_instant(value) or value, ensure_ascii=False)
    return json.dumps(value)


def _parsed(text: str | None):
    try:
        return json.loads(text, parse_int=_Literal, parse_float=_Literal)
    except (TypeError, ValueError):
        return None


def canonical_json(text: Column) -> Column:
    """A JSON document in its canonical form; null for null and for what is no JSON."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None or (v := _parsed(t)) is None and t.strip() != "null" else canonical(v))

    return run(text)


_SEGMENT = re.compile(r"([^.\[\]]+)(?:\[([^\]]*)\])?")


def segments(path: str) -> list[tuple[str, str | None, str | None]]:
    """(field, selector's key, its value) of a path a.b[*].c[key=value]; key * takes every element. Selector values may have dots."""
    out, at, path = [], 0, path.strip()
    while at < len(path):
        if path[at] == ".":
            at += 1
            continue
        m = _SEGMENT.match(path, at)
        if not m:
            raise ValueError(f"{path}: a selector needs a field before it and ] after it")
        inner = m.group(2)
        if inner is None or inner == "*":
            out.append((m.group(1), inner, None))
        elif "=" in inner:
            key, _, value = inner.partition("=")
            out.append((m.group(1), key.strip(), value.strip()))
        else:
            raise ValueError(f"{path}: [{inner}] is neither * nor key=value")
        at = m.end()
    if not out:
        raise ValueError("an empty path addresses nothing")
    return out


def _text(value) -> str:
    return value if isinstance(value, str) else canonical(value)


def _walk(value, steps) -> list:
    found = [value]
    for name, key, wanted in steps:
        found = [v[name] for v in found if isinstance(v, dict) and name in v]
        if key is not None:
            found = [x for v in found if isinstance(v, list) for x in v if key == "*" or isinstance(x, dict) and key in x and _text(x[key]) == wanted]
    return found


def resolved(document, path: str) -> list:
    """What a path finds in a document, or else in the first of its fields, by name, where it finds anything."""
    steps = segments(path)
    if found := _walk(document, steps):
        return found
    for name in sorted(document) if isinstance(document, dict) else []:
        if isinstance(document[name], dict) and (found := _walk(document[name], steps)):
            return found
    return []


def json_path(text: Column, path: str) -> Column:
    """The values that a path finds in JSON documents, as an array of texts (canonical JSON but for plain strings)."""
    segments(path)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [_text(v) for v in resolved(_parsed(t), path)])

    return run(text)


def holds(got: Column, op: str, want: str) -> Column:
    """A published comparison of texts: contains and not_contains as strings; else by what is wanted, an instant, a number
    (to 1e-9) or a string, which only eq and ne compare. False where what was got is no such thing."""
    if op in ("contains", "not_contains"):
        return got.contains(want) if op == "contains" else ~got.contains(want)
    if _instant(want):
        x, y = F.try_to_timestamp(got), F.lit(want).cast("timestamp")
    elif re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", want):
        x, y = got.try_cast("double"), F.lit(float(want))
        if op in ("eq", "ne"):
            near = F.abs(x - y) < 1e-9
            return F.coalesce(near if op == "eq" else ~near, F.lit(False))
    elif op in ("eq", "ne"):
        x, y = got, F.lit(want)
    else:
        return F.lit(False)
    made = {"eq": x == y, "ne": x != y, "lt": x < y, "lte": x <= y, "gt": x > y, "gte": x >= y}
    if op not in made:
        raise ValueError(f"no comparison is named {op}")
    return F.coalesce(made[op], F.lit(False))


def split_text(text: str | None, most: int) -> list[str]:
    """Parts of at most `most` characters, cut at the last line end in a part's second half, else at the last blank there, else at the limit."""
    parts, rest = [], text or ""
    while len(rest) > most:
        cut = max(rest.rfind("\n", most // 2 + 1, most + 1), -1)
        if cut < 0:
            cut = rest.rfind(" ", most // 2 + 1, most + 1)
        cut = most if cut < 0 else cut
        parts.append(rest[:cut].strip())
        rest = rest[cut:].lstrip(" \n")
    return [p for p in [*parts, rest.strip()] if p]


def text_parts(text: Column, most: int = 1200) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, most))

    return run(text)


def without_fields(text: Column, names: list[str]) -> Column:
    """JSON documents without the fields of these names, at any depth: canonical JSON; null for what is no JSON."""
    gone = frozenset(names)

    def clean(value):
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items() if k not in gone}
        return [clean(v) for v in value] if isinstance(value, list) else value

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (v := _parsed(t)) is None else canonical(clean(v)))

    return run(text)


def posterior_distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two lists of numbers, six decimals."""
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))), F.lit(0.0), lambda x, y: x + y), 6)


def quantile(values: Column, q: float) -> Column:
    """Nearest-rank quantile of a list; null for an empty one."""
    own = F.array_sort(values)
    return F.try_element_at(own, F.greatest(F.lit(1), F.ceil(F.size(own) * F.lit(q)).cast("int")))

