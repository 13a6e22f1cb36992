"""Masking functions: Column in, Column out, no Python on the row path.

Nulls stay null. Digits are ASCII digits; lengths count characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "***REDACTED***"


def _text(c: Column) -> Column:
    return c.cast("string")


def _stars(n: Column, char: str = "*") -> Column:
    return F.repeat(F.lit(char), F.greatest(n, F.lit(0)).cast("int"))


def _keep_null(c: Column, masked: Column) -> Column:
    return F.when(c.isNotNull(), masked)


def mask_full(c: Column, value: str = REDACTED) -> Column:
    return _keep_null(c, F.lit(value))


def mask_null(c: Column, dtype: str = "string") -> Column:
    return F.lit(None).cast(dtype)


def mask_partial(c: Column) -> Column:
    """First and last two characters; values of up to four characters become ``****``."""
    s, n = _text(c), F.length(_text(c))
    return F.when(n <= 4, F.lit("****")).otherwise(
        F.concat(F.substring(s, 1, 2), _stars(n - 4), F.right(s, F.lit(2))))


def mask_last4(c: Column) -> Column:
    s, n = _text(c), F.length(_text(c))
    return F.when(n <= 4, s).otherwise(F.concat(_stars(n - 4), F.right(s, F.lit(4))))


def mask_first4(c: Column) -> Column:
    s, n = _text(c), F.length(_text(c))
    return F.when(n <= 4, s).otherwise(F.concat(F.substring(s, 1, 4), _stars(n - 4)))


def mask_email(c: Column) -> Column:
    """Two characters of the local part and the text between the first and second ``@``."""
    s = _text(c)
    parts = F.split(s, "@", -1)
    return F.when(s.contains("@"), F.concat(F.substring(parts[0], 1, 2), F.lit("***@"), parts[1])).otherwise(
        _keep_null(c, F.lit("***@***")))


def mask_phone(c: Column) -> Column:
    digits = F.regexp_replace(_text(c), "[^0-9]", "")
    return F.when(F.length(digits) > 3, F.concat(F.substring(digits, 1, 3), F.lit("-***-****"))).otherwise(
        _keep_null(c, F.lit("***-***-****")))


def mask_hash(c: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(_text(c), 256), 1, 16)


def mask_hash_full(c: Column, algorithm: str = "sha256", salt: str = "") -> Column:
    salted = F.concat(F.lit(salt), _text(c))
    if algorithm == "sha256":
        return F.sha2(salted, 256)
    if algorithm == "sha512":
        return F.sha2(salted, 512)
    if algorithm == "md5":
        return F.md5(salted)
    raise ValueError(f"unknown hash {algorithm!r}")


def mask_email_domain(c: Column, visible: int = 2) -> Column:
    """``jo****@***.com``: local start, four stars, domain reduced to its last label."""
    s = _text(c)
    tld = F.regexp_extract(s, r"\.([^.@]+)$", 1)
    return _keep_null(c, F.concat(F.substring(F.split(s, "@", -1)[0], 1, visible), F.lit("****@***."), tld))


def _mask_digits_keep_tail(c: Column, tail: int) -> Column:
    """Star every digit that has at least ``tail`` digits after it; separators stay."""
    return F.regexp_replace(_text(c), rf"[0-9](?=(?:[^0-9]*[0-9]){{{tail}}})", "*")


def mask_ssn(c: Column) -> Column:
    return _mask_digits_keep_tail(c, 4)


def mask_card(c: Column) -> Column:
    return _mask_digits_keep_tail(c, 4)


def mask_name(c: Column, visible: int = 1) -> Column:
    """Each word keeps its first characters: ``J*** D**``."""
    words = F.transform(F.split(_text(c), " ", -1),
                        lambda w: F.concat(F.substring(w, 1, visible), _stars(F.length(w) - visible)))
    return F.array_join(words, " ")


def mask_address(c: Column) -> Column:
    """``*** Main St, ***, ** *****``: street name kept; house number, city, state and zip starred."""
    parts = F.split(_text(c), ", ", -1)
    masked = F.transform(parts, lambda p, i: F.when(i == 0, F.regexp_replace(p, r"^\S+", "***"))
                         .when(i == F.size(parts) - 1, F.regexp_replace(p, r"\S", "*"))
                         .otherwise(F.lit("***")))
    return F.array_join(masked, ", ")


def mask_partial_opts(c: Column, char: str = "*", start: int = 0, end: int = 0, preserve_length: bool = True,
                      preserve_format: bool = False) -> Column:
    """Keep ``start`` leading and ``end`` trailing characters; values too short to hide anything are starred whole.

    ``preserve_format`` masks letters and digits only; without ``preserve_length`` the middle becomes four chars.
    """
    s, n = _text(c), F.length(_text(c))
    head = F.substring(s, 1, start) if start else F.lit("")
    tail = F.right(s, F.lit(end)) if end else F.lit("")
    middle = F.substring(s, F.lit(start + 1), F.greatest(n - F.lit(start + end), F.lit(0)))
    def hide(text: Column) -> Column:
        if preserve_format:
            return F.regexp_replace(text, "[A-Za-z0-9]", char)
        return _stars(F.length(text), char) if preserve_length else F.lit(char * 4)
    return F.when(n <= start + end, hide(s)).otherwise(F.concat(head, hide(middle), tail))


def replace_value(c: Column, value: str) -> Column:
    return _keep_null(c, F.lit(value))


def date_generalize(c: Column, level: str) -> Column:
    """First day of the year, month or decade."""
    d = c.cast("date")
    if level == "decade":
        return F.make_date((F.floor(F.year(d) / 10) * 10).cast("int"), F.lit(1), F.lit(1))
    if level not in ("year", "month"):
        raise ValueError(f"unknown level {level!r}")
    return F.trunc(d, level)


# fixed values: decimal places per rounding level
_ROUND_LEVELS = {"tens": -1, "hundreds": -2, "thousands": -3}


def number_round(c: Column, level: str) -> Column:
    return F.round(c, _ROUND_LEVELS[level])


def conditional_mask(c: Column, cond: Column | str, mask: Callable[[Column], Column]) -> Column:
    """Mask only where the row predicate holds; an unknown (null) predicate masks."""
    cond = F.expr(cond) if isinstance(cond, str) else cond
    return F.when(F.coalesce(cond, F.lit(True)), mask(c)).otherwise(c)


def encrypt(c: Column, key: Column) -> Column:
    """AES-GCM, base64 text; ``key`` is a 16, 24 or 32 byte column or literal."""
    return F.base64(F.aes_encrypt(_text(c), key))


def decrypt(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(c), key).cast("string")


def policy_email(c: Column) -> Column:
    """``***@{domain}``"""
    return F.concat(F.lit("***@"), F.substring_index(_text(c), "@", -1))


def policy_phone(c: Column) -> Column:
    return _keep_null(c, F.lit("***-****"))


def policy_ssn(c: Column) -> Column:
    return _keep_null(c, F.lit("***-**-****"))


MASKS: dict[str, Callable[[Column], Column]] = {
    "full": mask_full,
    "null": mask_null,
    "partial": mask_partial,
    "mask_last4": mask_last4,
    "mask_first4": mask_first4,
    "email": mask_email,
    "phone": mask_phone,
    "hash": mask_hash,
    "hash_sha256": mask_hash_full,
    "email_mask": mask_email_domain,
    "ssn_mask": mask_ssn,
    "credit_card_mask": mask_card,
    "name_mask": mask_name,
    "address_mask": mask_address,
    "partial_mask": mask_partial_opts,
    "full_redact": mask_full,
    # the access rules name this method differently
    "full_mask": mask_full,
}


def register_mask(name: str, fn: Callable[[Column], Column]) -> None:
    """Add a custom mask: a Column function, or an Arrow ``pandas_udf`` where plain expressions cannot do it."""
    MASKS[name] = fn


def mask_by_name(name: str) -> Callable[[Column], Column]:
    """Look a mask up; an unknown name is an error, never a pass-through."""
    if name not in MASKS:
        raise ValueError(f"unknown mask {name!r}")
    return MASKS[name]


def sql_mask(spark, name: str, args: str, body: str) -> Callable[..., Column]:
    """SQL-defined mask with extra columns: ``CREATE TEMPORARY FUNCTION name(args) RETURN body``."""
    if not name.isidentifier():
        raise ValueError(f"bad function name {name!r}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURN {body}")
    return lambda *cols: F.call_function(name, *cols)
