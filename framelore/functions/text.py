"""String and path expressions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Keys that never leave the house, as a pattern and as whole names; what counts as a local path.
PRIVATE_KEY = r"(?i)password|secret|token|api.?key|authorization|ai_adapter|base_url|source_file|source_sha256|annotation_path"
PRIVATE_NAMES = ["root", "fingerprint", "roots", "files"]
LOCAL_PATH = r"""(?U)(?<![\w:/])(?:/[\w.~-][^\s"'<>]*|[A-Za-z]:[\\/][^\s"'<>]*)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slug(value: Column, default: str = "project") -> Column:
    """Runs of other characters become one dash, outer dashes go, lower case, at most 48 characters."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", ""))
    return F.coalesce(F.nullif(F.left(bare, F.lit(48)), F.lit("")), F.lit(default))


def path_key(path: Column, size: int = 24) -> Column:
    """The leading hex digits of the path's digest."""
    return F.left(F.sha2(path, 256), F.lit(size))


def label_file(path: Column) -> Column:
    """The label file of a picture: its last folder called images becomes labels, the extension becomes .txt.

    The file name itself is never taken for that folder; without such a folder
    the label file lies beside the picture.
    """
    moved = F.regexp_replace(path, r"^(.*/|)images/(.*)$", "$1labels/$2")
    return F.concat(F.regexp_replace(moved, r"(?<=[^/])\.[^./]+$", ""), F.lit(".txt"))


def redact_text(value: Column) -> Column:
    """Absolute paths in a text become a placeholder; class names such as /m/01 are the caller's to keep out."""
    return F.regexp_replace(value, LOCAL_PATH, "[local-path]")


def redact_map(value: Column) -> Column:
    """A map<string,string> without private keys and with redacted texts."""
    kept = F.map_filter(value, lambda k, v: ~(k.rlike(PRIVATE_KEY) | k.isin(PRIVATE_NAMES)))
    return F.transform_values(kept, lambda k, v: redact_text(v))


def normalize_label(value: Column) -> Column:
    """Outer white space goes, inner runs become one blank."""
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def ascii_lower(value: Column) -> Column:
    """Only A to Z are folded, as the embedded index database does."""
    return F.translate(value, UPPER, LOWER)


def contains_literally(value: Column, query: str) -> Column:
    """Substring search without wildcards, blind to ASCII case."""
    return F.instr(ascii_lower(value), query.translate(str.maketrans(UPPER, LOWER))) > 0


def color_hash(value: Column, colors: int = 12) -> Column:
    """h = (h * 31 + code point) mod 2^32 over the text, then the palette index."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + c, F.lit(2**32))) % colors


def portable_path(value: Column) -> Column:
    """Relative and portable: no outer blanks, backslash, colon, control character, leading slash or "..", and more than "."."""
    parts = F.filter(F.split(value, "/"), lambda p: ~p.isin("", "."))
    return (
        value.rlike(r"(?U)\S")
        & ~value.rlike(r"(?U)^\s|\s$")
        & ~value.rlike(r"[\\:\x00-\x1f]")
        & ~value.startswith("/")
        & ~F.array_contains(parts, "..")
        & (F.size(parts) > 0)
    )


def base_url(value: Column) -> Column:
    """A model endpoint without trailing slashes; null unless http(s) with a host and without user, query or fragment."""
    bare = F.regexp_replace(F.trim(value), "/+$", "")
    return F.when(bare.rlike(r"^(?i:https?)://[^/?#@\s]+(/[^?#@\s]*)?$"), bare)


def model_object(text: Column) -> Column:
    """The JSON object in a model's answer: a fenced block, else from the first brace to the last; null if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    start, stop = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    bare = F.when((start > 0) & (stop > start), F.substring(text, start, stop - start + 1)).otherwise(F.trim(text))
    body = F.when(fenced != "", fenced).otherwise(bare)
    return F.when(F.try_parse_json(body).isNotNull() & body.startswith("{"), body)


def local_file_reference(value: Column) -> Column:
    """The path in a local-files reference (?d=...), else the value; null for a remote address."""
    d = F.regexp_extract(value, r"[?&]d=([^&#]*)", 1)
    return F.when(value.rlike(r"^/data/local-files/?\?"), F.try_url_decode(d)).when(value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.lit(None)).otherwise(value)


def quote_path(value: Column) -> Column:
    """Percent quoting that leaves slashes and blanks as %20."""
    return F.replace(F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))


def xml_safe(value: Column) -> Column:
    """Only characters that XML 1.0 allows."""
    return ~value.rlike(r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]")


def _canonical(body: str | None) -> str | None:
    """Fixed format: keys in order, ", " and ": " between, other letters escaped; None for what is no JSON or holds NaN."""
    try:
        return hashlib.sha256(json.dumps(json.loads(body), sort_keys=True, allow_nan=False).encode()).hexdigest()
    except (TypeError, ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def document_digest(bodies: pd.Series) -> pd.Series:
    """Digest of a JSON text that does not depend on the order of keys or blanks; null where there is none."""
    return bodies.map(_canonical)


def time_text(seconds: Column) -> Column:
    """MM:SS.mmm of a time; null, NaN and negative times are 00:00.000."""
    ms = F.rint(F.greatest(F.lit(0.0), F.coalesce(F.nanvl(seconds, F.lit(0.0)), F.lit(0.0))) * 1000).cast("bigint")
    return F.format_string("%02d:%06.3f", F.floor(ms / 60000), (ms % 60000) / 1000)
