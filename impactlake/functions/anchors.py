"""Anchor keys as Column functions: parsing, wildcards, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILD = "{*}"
#: Kinds of anchors (fixed values).
ANCHOR_TYPES = ["hook", "rest", "ajax", "script-handle", "js-module", "js-symbol", "js-global", "php-symbol", "php-file", "wp-admin-page", "wp-frontend", "wp-store", "shortcode", "block", "test"]


def is_wild(key: Column) -> Column:
    return F.contains(key, F.lit(WILD))


def anchor_type(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def wildcard_regex(key: Column) -> Column:
    """A regular expression for a key whose ``{*}`` stand for one or more characters but white space."""
    quoted = F.regexp_replace(key, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit(r"\{\*\}"), F.lit(r"[^\s]+")), F.lit("$"))


def literal_length(key: Column) -> Column:
    return F.length(F.replace(key, F.lit(WILD), F.lit("")))


def wildcard_breadth(key: Column) -> Column:
    """``wildcardBroad`` where a key has no literal path segment, else ``wildcardPrefixed``."""
    body = F.regexp_replace(F.regexp_replace(key, "^[^:]*:", ""), "^[^ ]* ", "")
    # each segment gets slashes of its own, so that wild ones can be taken out whole
    segments = F.concat(F.lit("/"), F.replace(body, F.lit("/"), F.lit("//")), F.lit("/"))
    return F.when(F.replace(segments, F.lit(f"/{WILD}/"), F.lit("")).rlike("[^/]"), "wildcardPrefixed").when(key.isNotNull(), "wildcardBroad").otherwise("wildcardPrefixed")


def partner_role(role: Column) -> Column:
    return F.when(role == "target", "subject").when(role == "subject", "target").otherwise(role)


def parse_anchor(raw: Column) -> Column:
    """struct<type, key, partial, error> of ``type:body``; bodies are normalised by type.

    Each step names the one before it once: a column that stands in several branches is computed in each.
    """
    at = F.instr(raw, F.lit(":"))
    kind, body = F.substr(raw, F.lit(1), at - 1), F.substr(raw, at + 1, F.length(raw))
    method = F.coalesce(F.nullif(F.upper(F.regexp_extract(body, r"^([A-Za-z]+)\s+/", 1)), F.lit("")), F.lit("GET"))
    route = F.regexp_replace(body, r"^(?:[A-Za-z]+\s+(?=/))?(?:/wp-json(?=/))?", "")
    route = F.regexp_replace(route, r"(?s)(?<=.)/\z", "")
    action, symbol = F.regexp_replace(body, "^wp_ajax_(?:nopriv_)?", ""), F.regexp_replace(body, r"^\\", "")
    clean = F.when(kind == "rest", F.concat(method, F.lit(" "), route)).when(kind == "ajax", action).when(kind == "php-symbol", symbol).otherwise(body)
    error = (
        F.when((at == 0) | raw.isNull(), "no type").when(~kind.isin(ANCHOR_TYPES), "unknown type").when(body == "", "empty body")
        .when((kind == "rest") & ~body.rlike(r"^(?:[A-Za-z]+\s+)?/"), "route must start with /").when(clean == "", "empty body")
    )
    key = F.when(error.isNull(), F.concat(kind, F.lit(":"), clean))
    return F.struct(F.when(error.isNull(), kind).alias("type"), key.alias("key"), F.coalesce(is_wild(key), F.lit(False)).alias("partial"), error.alias("error"))
