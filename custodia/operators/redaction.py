"""Rule resolution on the driver, one projection on the cluster."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.functions import masks
from custodia.functions.text import glob_to_regex

# fixed values: mask per column-name pattern, in the order they are tried
NAME_RULES = {
    "email": "email",
    "phone": "phone",
    "ssn": "full",
    "social_security": "full",
    "card_number": "mask_last4",
    "credit_card": "mask_last4",
    "password": "full",
    "secret": "full",
    "token": "full",
    "api_key": "full",
}

# fixed values: column regex -> action of the identifier policy, first match wins
IDENTIFIER_POLICY = [
    (r".*_id_hash$", "allow", None),
    (r"^(family_id|child_id|user_id|session_id)$", "mask", "hash_sha256"),
    (r"^(cost_|latency_|duration_|input_|output_|total_)", "allow", None),
    (r"^(language|region|model_|stage|source|year|month|day)", "allow", None),
]


@dataclass(frozen=True)
class Rule:
    """A mask for every column whose lower-case name contains ``pattern``."""

    pattern: str
    method: str
    reason: str = ""

    def covers(self, column: str) -> bool:
        return self.pattern.lower() in column.lower()


def build_rules(classifications: Mapping[str, Sequence[str]], roles: Sequence[str] = ()) -> list[Rule]:
    """Classification rules first, then the name rules.

    A name pattern decides the method even of a classified column. Admins keep classified columns in clear unless
    they are SECRET; the name rules apply to admins as well.
    """
    rules = []
    for column, labels in classifications.items():
        if "admin" in roles and "SECRET" not in labels:
            continue
        named = next((m for p, m in NAME_RULES.items() if p in column.lower()), None)
        method = named or ("full" if "SECRET" in labels else "partial")
        rules.append(Rule(column, method, "Classifications: " + ", ".join(labels)))
    taken = {r.pattern for r in rules}
    rules += [Rule(p, m, f"Field pattern: {p}") for p, m in NAME_RULES.items() if p not in taken]
    return rules


def rule_for(column: str, rules: Sequence[Rule]) -> Rule | None:
    return next((r for r in rules if r.covers(column)), None)


def redact(df: DataFrame, classifications: Mapping[str, Sequence[str]], roles: Sequence[str] = ()) -> DataFrame:
    """Masked copy of ``df``. Rules are matched once per column, so rows only pay for the expressions."""
    rules = build_rules(classifications, roles)
    out = []
    for name in df.columns:
        rule = rule_for(name, rules)
        out.append(masks.mask_by_name(rule.method)(F.col(name)).alias(name) if rule else F.col(name))
    return df.select(*out)


def redaction_report(df: DataFrame, classifications: Mapping[str, Sequence[str]],
                     roles: Sequence[str] = ()) -> DataFrame:
    """Masked values per ruled column with the rule applied; one aggregate over the table.

    Every non-null value of a ruled column counts, also where the mask leaves a short value as it is.
    """
    rules = build_rules(classifications, roles)
    ruled = [(c, r) for c in df.columns if (r := rule_for(c, rules))]
    counts = df.agg(F.count(F.lit(1)).alias("records_processed"),
                    F.array(*[F.struct(F.lit(c).alias("field"), F.count(c).alias("values_masked"),
                                       F.lit(r.method).alias("method"), F.lit(r.reason).alias("reason"))
                              for c, r in ruled]).alias("fields"))
    return counts.select("records_processed", F.inline("fields"))


# ---- nested documents -------------------------------------------------------------------------------------

PATH_REDACTED = "[REDACTED]"


def _path_matcher(patterns: Sequence[str]) -> Callable[[str], bool]:
    compiled = [re.compile(glob_to_regex(p)) for p in patterns]
    return lambda path: any(rx.match(path) for rx in compiled)


def _redact_node(col: Column, dtype: T.DataType, path: str, hit: Callable[[str], bool]) -> Column:
    if isinstance(dtype, T.StructType):
        fields = []
        for f in dtype.fields:
            child = f"{path}.{f.name}" if path else f.name
            value = col.getField(f.name)
            fields.append((F.lit(PATH_REDACTED) if hit(child) else _redact_node(value, f.dataType, child, hit)).alias(f.name))
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        if hit(f"{path}[]"):
            return F.transform(col, lambda _: F.lit(PATH_REDACTED))
        return F.transform(col, lambda x: _redact_node(x, dtype.elementType, f"{path}[]", hit))
    if isinstance(dtype, T.MapType):
        # map keys are data, so the path test becomes a regex over the key
        return _redact_map(col, dtype, F.lit(path), hit)
    return col


def _redact_map(col: Column, dtype: T.MapType, path: Column, hit: Callable[[str], bool]) -> Column:
    return F.transform_values(col, lambda k, v: _redact_keyed(v, dtype.valueType, F.concat(path, F.lit("."), k.cast("string")), hit))


def _redact_keyed(value: Column, dtype: T.DataType, path: Column, hit: Callable[[str], bool]) -> Column:
    """A value whose path is known per row only: its type must stay, so a match that is no string becomes null."""
    if isinstance(dtype, T.StructType):
        below = F.when(value.isNotNull(), F.struct(*[
            _redact_keyed(value.getField(f.name), f.dataType, F.concat(path, F.lit(f".{f.name}")), hit).alias(f.name) for f in dtype.fields]))
    elif isinstance(dtype, T.ArrayType):
        below = F.transform(value, lambda x: _redact_keyed(x, dtype.elementType, F.concat(path, F.lit("[]")), hit))
    elif isinstance(dtype, T.MapType):
        below = _redact_map(value, dtype, path, hit)
    else:
        below = value
    mark = F.lit(PATH_REDACTED) if isinstance(dtype, T.StringType) else F.lit(None)
    return F.when(_key_matches(path, hit.patterns), mark.cast(dtype)).otherwise(below)


def _key_matches(full: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | full.rlike(glob_to_regex(p))
    return out


def redact_paths(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Replace values at matching paths (``a.*.b``, ``list[]``) by ``[REDACTED]``; a star also spans dots.

    The schema is walked once on the driver. A path that matches replaces the whole value, so its type becomes
    string. Below map keys the path is known per row only and types stay: strings become the mark, other values null.
    List elements are addressed as ``list[]``.
    """
    hit = _path_matcher(patterns)
    hit.patterns = list(patterns)
    cols = []
    for f in df.schema.fields:
        if hit(f.name):
            cols.append(F.lit(PATH_REDACTED).alias(f.name))
        else:
            cols.append(_redact_node(F.col(f.name), f.dataType, f.name, hit).alias(f.name))
    return df.select(*cols)


# ---- policies ---------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class MaskPolicy:
    """Mask for the columns matching ``field`` (a glob), optionally limited by roles and a row predicate."""

    field: str
    mask: str | Callable[[Column], Column]
    priority: int = 0
    roles: tuple[str, ...] = ()
    exempt_roles: tuple[str, ...] = ()
    applies_when: str | None = None
    options: Mapping[str, object] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        fn = masks.mask_by_name(self.mask) if isinstance(self.mask, str) else self.mask
        masked = (lambda c: fn(c, **self.options)) if self.options else fn
        if self.applies_when:
            return masks.conditional_mask(F.col(name), self.applies_when, masked)
        return masked(F.col(name))


def scope_rules(rules: Sequence[MaskPolicy], roles: Sequence[str]) -> list[MaskPolicy]:
    """Rules that bind a user with these roles: listed roles only, exempt roles skipped."""
    have = set(roles)
    return [r for r in rules if (not r.roles or have & set(r.roles)) and not have & set(r.exempt_roles)]


def resolve_policies(columns: Sequence[str], policies: Sequence[MaskPolicy]) -> tuple[dict[str, MaskPolicy], list[str]]:
    """Policy per column (highest priority first, then as listed) and the patterns that match nothing."""
    ranked = sorted(policies, key=lambda p: -p.priority)
    chosen: dict[str, MaskPolicy] = {}
    missing = []
    for p in ranked:
        rx = re.compile(glob_to_regex(p.field), re.I)
        hits = [c for c in columns if rx.match(c)]
        if not hits:
            missing.append(p.field)
        for c in hits:
            chosen.setdefault(c, p)
    return chosen, missing


def apply_policies(df: DataFrame, policies: Sequence[MaskPolicy], roles: Sequence[str] = ()) -> DataFrame:
    chosen, _ = resolve_policies(df.columns, scope_rules(policies, roles))
    return df.select(*[chosen[c].column(c).alias(c) if c in chosen else F.col(c) for c in df.columns])


def policy_warnings(df: DataFrame, policies: Sequence[MaskPolicy]) -> DataFrame:
    """One row per policy that names a field the table does not have."""
    _, missing = resolve_policies(df.columns, policies)
    return df.sparkSession.createDataFrame([(m, "field not found") for m in missing], "field string, warning string")


def masking_summary(df: DataFrame, policies: Sequence[MaskPolicy], roles: Sequence[str] = ()) -> DataFrame:
    """Records total, modified and unchanged, values changed and fields masked, in one pass over ``df``."""
    chosen, _ = resolve_policies(df.columns, scope_rules(policies, roles))
    changed = [(~F.col(c).cast("string").eqNullSafe(p.column(c).cast("string"))).cast("int") for c, p in chosen.items()]
    values = sum(changed[1:], changed[0]) if changed else F.lit(0)
    return df.select(values.alias("__n")).agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(F.col("__n") > 0).alias("modified_records"),
        F.count_if(F.col("__n") == 0).alias("unchanged_records"), F.sum("__n").alias("values_masked"),
        F.lit(len(chosen)).alias("fields_masked"))


def data_hash(df: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint: row count and sum of row hashes."""
    return df.agg(F.count(F.lit(1)).alias("row_count"),
                  F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("content_hash"))


# fixed values: per column suffix, the mask and the roles that see the clear value
COLUMN_RESTRICTIONS = {
    "email": (masks.policy_email, ("compliance_officer", "admin")),
    "phone": (masks.policy_phone, ("compliance_officer", "admin")),
    "ssn": (masks.policy_ssn, ()),
}


def policy_masks(df: DataFrame, roles: Sequence[str]) -> DataFrame:
    return apply_policies(df, [MaskPolicy(c, fn, exempt_roles=tuple(open_to))
                               for c, (fn, open_to) in COLUMN_RESTRICTIONS.items()], roles)


def column_policy(df: DataFrame, rules: Sequence[tuple[str, str, str | None]] = tuple(IDENTIFIER_POLICY),
                  default: str = "allow") -> DataFrame:
    """Allow, mask or drop columns by the first matching regex; ``default`` decides about unmatched columns."""
    out = []
    for name in df.columns:
        action, method = next(((a, m) for rx, a, m in rules if re.match(rx, name)), (default, None))
        if action == "allow":
            out.append(F.col(name))
        elif action == "mask":
            out.append(masks.mask_by_name(method or "full")(F.col(name)).alias(name))
        elif action != "deny":
            raise ValueError(f"unknown action {action!r}")
    return df.select(*out)


def aggregate_only(df: DataFrame, restricted: Sequence[str], dims: Sequence[str],
                   aggs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Grouped result in which restricted columns occur inside aggregates only.

    MIN and MAX return single raw values, so they count as bare use.
    """
    from custodia.operators.aggregates import basic_aggs
    bare = [d for d in dims if d in restricted] + [
        c for fn, c in aggs.values() if c in restricted and fn in ("min", "max")]
    if bare:
        raise PermissionError(f"aggregate-only columns used bare: {sorted(set(bare))}")
    return basic_aggs(df, list(dims), dict(aggs))


def pseudonymize_ids(df: DataFrame, columns: Sequence[str] = ("family_id", "child_id", "user_id")) -> DataFrame:
    """Replace raw id columns by ``<name>_hash``."""
    present = [c for c in columns if c in df.columns]
    return df.select(*[masks.mask_hash(F.col(c)).alias(f"{c}_hash") if c in present else F.col(c) for c in df.columns])


# ---- reversible tokens ------------------------------------------------------------------------------------

def tokenize(df: DataFrame, column: str, secret: str) -> tuple[DataFrame, DataFrame]:
    """Tokenised table and its vault (token, value).

    Tokens are keyed hashes computed per row, so the table needs no join and no shuffle; only the vault is
    reduced to its distinct values.
    """
    inner = F.sha2(F.concat(F.lit(secret), F.lit(":"), F.col(column).cast("string")), 256)
    token = F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit(secret), inner), 256), 1, 32))
    vault = (df.where(F.col(column).isNotNull())
             .select(token.alias("token"), F.col(column).cast("string").alias("value")).distinct())
    return df.withColumn(column, token), vault


def token_collisions(vault: DataFrame) -> DataFrame:
    """Tokens that stand for more than one value (must be empty)."""
    return vault.groupBy("token").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def detokenize(df: DataFrame, column: str, vault: DataFrame) -> DataFrame:
    names = vault.select(F.col("token").alias(column), F.col("value").alias("__value"))
    return df.join(names, column, "left").withColumn(column, F.col("__value")).select(*df.columns)
