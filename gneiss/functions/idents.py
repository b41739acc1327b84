"""Names, references and identities as column expressions; a refused value gives null, or a reason where it says so."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ARRANGEMENT = "torch.contiguous@1"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HANDLE = r"^([a-z0-9][a-z0-9-]*\.[a-z0-9][a-z0-9._-]*)@0*([1-9][0-9]{0,9})$"


def digest(content: Column) -> Column:
    """SHA-256 as lower hex."""
    return F.sha2(content.cast("binary"), 256)


def ref(hexadecimal: Column) -> Column:
    """A content reference."""
    return F.concat(F.lit("sha256:"), hexadecimal)


def is_ref(text: Column) -> Column:
    """Whether a text is a content reference; bare hex isn't."""
    return F.coalesce(text.rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def object_key(text: Column, prefix: str = "objects") -> Column:
    """The key under which an object is stored, by its reference; null for no reference."""
    h = F.substring(text, 8, 64)
    return F.when(is_ref(text), F.concat_ws("/", F.lit(prefix), F.lit("sha256"), F.substring(h, 1, 2), F.substring(h, 3, 2), h))


def ascii_fold(text: Column) -> Column:
    """A-Z to lower case, nothing else."""
    return F.translate(text, UPPER, LOWER)


def parse_handle(text: Column) -> Column:
    """struct(name, version) of ``producer.format@version``; null if it isn't one. A name has at most 64 bytes."""
    name, version = F.regexp_extract(text, HANDLE, 1), F.regexp_extract(text, HANDLE, 2).try_cast("long")
    good = text.rlike(HANDLE) & (F.octet_length(name) <= 64) & (version < (1 << 32))
    return F.when(good, F.struct(name.alias("name"), version.alias("version")))


def layout_text(topology: Column, quant: Column, arrangement: Column | None = None) -> Column:
    """The text of a stamp; the default arrangement is left out."""
    last = F.lit(None) if arrangement is None else F.when(arrangement != DEFAULT_ARRANGEMENT, arrangement)
    return F.concat_ws("+", topology, quant, last)


def parse_layout(text: Column) -> Column:
    """struct(topology, quant, arrangement) of a stamp's text; null if malformed or if it spells the default."""
    parts = F.split(text, r"\+")
    n, third = F.size(parts), F.get(parts, F.lit(2))
    good = n.isin(2, 3) & F.forall(parts, lambda p: parse_handle(p).isNotNull()) & (third.isNull() | (third != DEFAULT_ARRANGEMENT))
    return F.when(good, F.struct(F.get(parts, F.lit(0)).alias("topology"), F.get(parts, F.lit(1)).alias("quant"), F.coalesce(third, F.lit(DEFAULT_ARRANGEMENT)).alias("arrangement")))


def bridge(source: Column, target: Column) -> Column:
    """The name of the step between two arrangements."""
    return F.concat_ws(">", source, target)


def parse_bridge(text: Column) -> Column:
    """struct(source, target) of a bridge; null unless both are handles and differ."""
    p = F.split(text, ">")
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    return F.when((F.size(p) == 2) & parse_handle(a).isNotNull() & parse_handle(b).isNotNull() & (a != b), F.struct(a.alias("source"), b.alias("target")))


def path_refusal(path: Column) -> Column:
    """Why the looser path rule refuses a path; null if it doesn't: relative, no empty, ``.`` or ``..`` segment, no
    backslash, no control character."""
    segments = F.split(path, "/")
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(path.startswith("/"), "absolute")
        .when(F.contains(path, F.lit("\\")), "backslash")
        .when(path.rlike(r"[\x00-\x1f\x7f]"), "control")
        .when(F.exists(segments, lambda s: s == ""), "empty-segment")
        .when(F.exists(segments, lambda s: s.isin(".", "..")), "dot-segment")
    )


def is_nfc(text: Column) -> Column:
    """Whether a text is in composed normal form; no built-in tells."""

    def test(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.is_normalized("NFC", t))

    return F.pandas_udf(test, "boolean")(text)


WINDOWS = r"(?i)^(con|prn|aux|nul|com[0-9¹²³]|lpt[0-9¹²³])(\..*)?$"


def strict_path_refusal(path: Column, nfc: Column | None = None) -> Column:
    """Why the strict path rule refuses a path; null if it doesn't. ``nfc`` is ``is_nfc`` of the path, where wanted."""
    segments = F.split(path, "/")
    out = (
        F.when(path.isNull() | (path == ""), "empty")
        .when(F.octet_length(path) > 4096, "too-long")
        .when(path.startswith("/"), "absolute")
        .when(path.rlike(r"[\x00-\x1f\x7f-\x9f]"), "control")
        .when(path.rlike(r'[\\:*?"<>|]'), "reserved-character")
        .when(F.exists(segments, lambda s: s == ""), "empty-segment")
        .when(F.exists(segments, lambda s: s.isin(".", "..")), "dot-segment")
        .when(F.exists(segments, lambda s: F.octet_length(s) > 255), "segment-too-long")
        .when(F.exists(segments, lambda s: s.endswith(".") | s.endswith(" ")), "trailing-dot-or-space")
        .when(F.exists(segments, lambda s: s.rlike(WINDOWS)), "reserved-name")
    )
    return out if nfc is None else out.when(~nfc, "not-composed")
