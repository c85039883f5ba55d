"""Text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella import config as C


def norm_label(x: Column) -> Column:
    """Upper case without anything but A-Z and 0-9; null if nothing is left."""
    bare = F.regexp_replace(F.upper(x), "[^A-Z0-9]+", "")
    return F.when(bare != "", bare)


def clean_text(x: Column) -> Column:
    """Upper case, only A-Z 0-9 / : . + and -, so that a region is one token."""
    return F.regexp_replace(F.upper(F.trim(x)), r"[^A-Z0-9/:.+-]+", "")


def model_codes(x: Column) -> Column:
    """All substrings shaped like a model code, in order."""
    return F.regexp_extract_all(x, F.lit(C.MODEL_PATTERN), F.lit(0))


def acceptable_code(token: Column) -> Column:
    """Whether a token that has the shape is distinctive: no legend, long enough, letters and digits."""
    bare = F.regexp_replace(token, "[- ]", "")
    return ~bare.isin(*C.BUTTON_WORDS) & (F.length(bare) >= C.MODEL_MIN_LENGTH) & bare.rlike("[0-9]") & bare.rlike("[A-Z]")


def code_from_title(title: Column) -> Column:
    """The first code in the part of a title before the word for the device; null without that word."""
    head = F.when(title.rlike(f"(?iu){C.TITLE_STOP}"), F.upper(F.get(F.split(title, f"(?iu){C.TITLE_STOP}", 2), F.lit(0))))
    tokens = F.transform(F.split(head, r"[\s,;/]+"), lambda t: F.translate(F.regexp_replace(t, r"""^[.,;:()\[\]"']+|[.,;:()\[\]"']+$""", ""), "_", "-"))
    fits = lambda t: (F.length(t) >= 5) & t.rlike("^[A-Z0-9][A-Z0-9-]*[A-Z0-9]$") & (F.length(F.regexp_replace(t, "[^0-9]", "")) >= 2) & ~F.translate(t, "-", "").isin(*C.BUTTON_WORDS)
    return F.get(F.filter(tokens, fits), F.lit(0))


def record_stem(record_id: Column) -> Column:
    """The photo stem: the id without its last _digits; the whole id without such an end."""
    return F.when(record_id.rlike(r"_\d+$"), F.regexp_extract(record_id, r"^(.*)_(\d+)$", 1)).otherwise(record_id)


def crop_index(record_id: Column) -> Column:
    return F.when(record_id.rlike(r"_\d+$"), F.regexp_extract(record_id, r"^(.*)_(\d+)$", 2).cast("int")).otherwise(0)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def collapse_spaces(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"\s+", " ")


def reason_prefix(reason: Column) -> Column:
    """The part of a reason before its details: up to `:`, then up to ` (`."""
    return F.rtrim(F.get(F.split(F.get(F.split(reason, ":"), F.lit(0)), r"\("), F.lit(0)))
