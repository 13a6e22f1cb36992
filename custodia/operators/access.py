"""Access review over whole request tables.

Policies are configuration: they are compiled into expressions on the driver, so a review is one narrow
projection without joins. Only grant tables, which are data, are joined. Everything fails closed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia import policies as P
from custodia.functions.text import lit_array, lit_map

SCHEME = "catalog://"


def normalize_uri(resource: Column) -> Column:
    """``catalog://`` form of a resource given with or without the scheme."""
    return F.when(resource.startswith(SCHEME), resource).otherwise(F.concat(F.lit(SCHEME), resource))


def matches_resource(resource: Column, patterns: Sequence[str]) -> Column:
    """Equal to a pattern, starting with a starred one, or equal after dropping the scheme."""
    out = F.lit(False)
    bare = F.replace(resource, F.lit(SCHEME), F.lit(""))
    for p in patterns:
        if p == "*":
            return F.lit(True)
        hit = (resource == p) | (bare == p)
        out = out | (resource.startswith(p[:-1]) if p.endswith("*") else hit)
    return out


def _policy_case(resource: Column, policies: Mapping[str, Mapping], value: Callable[[Mapping], Column], default: Column) -> Column:
    """CASE over resource policies: exact URI first, then patterns in their order."""
    out = None
    for exact in (True, False):
        for uri, policy in policies.items():
            cond = (resource == uri) if exact else matches_resource(resource, [uri])
            out = F.when(cond, value(policy)) if out is None else out.when(cond, value(policy))
    return default if out is None else out.otherwise(default)


def _role_grants(role: Column, action: Column, resource: Column, perms: Mapping[str, Mapping]) -> Column:
    out = F.lit(False)
    for name, p in perms.items():
        allowed = F.lit(True) if "*" in p["actions"] else action.isin(list(p["actions"]))
        out = out | ((role == name) & allowed & matches_resource(resource, p["resources"]))
    return out


def authorize_batch(requests: DataFrame, perms: Mapping[str, Mapping] = P.ROLE_PERMISSIONS,
                    policies: Mapping[str, Mapping] = P.RESOURCE_POLICIES, compat: bool = False) -> DataFrame:
    """Decide requests with columns ``roles`` (ordered array), ``action`` and ``resources`` (array).

    Per resource: one of the policy's required roles, then the first role in the user's order that grants the
    action on it. All resources must pass and the first refusal is reported. Constraints are those of the
    granting role overridden by the resource policy; a later resource overrides an earlier one.

    Resources are normalised to ``catalog://`` URIs first. ``compat`` skips that, so that a bare name slips past
    the policy of its URI; it exists for parity tests only. A null resource, action or list of resources is refused.
    """
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    action = F.col("action")

    def judge(raw: Column) -> Column:
        res = raw if compat else normalize_uri(raw)
        required = _policy_case(res, policies, lambda p: lit_array(p.get("required_roles", [])), empty)
        # an unknown overlap (a null among the roles) is none
        lacks = (F.size(required) > 0) & ~F.coalesce(F.arrays_overlap(required, F.col("roles")), F.lit(False))
        role = F.get(F.filter("roles", lambda r: _role_grants(r, action, res, perms)), F.lit(0))
        # a refusal is never null, whatever is null in the request
        named, asked = F.coalesce(raw, F.lit("null")), F.coalesce(action, F.lit("null"))
        return F.struct(
            F.when(raw.isNull() | lacks, F.concat(F.lit("User lacks required role for "), named)).when(
                role.isNull(), F.concat(F.lit("No role grants "), asked, F.lit(" access to "), named)).alias("denial"),
            role.alias("role"),
            _policy_case(res, policies, lambda p: F.lit("; ".join(p["row_filters"])) if p.get("row_filters") else none, none).alias("row_filter"),
            _policy_case(res, policies, lambda p: F.lit(",".join(f"{c}={m}" for c, m in p["column_masking"].items()))
                         if p.get("column_masking") else none, none).alias("masking"))

    out = requests.withColumn("__j", F.transform("resources", judge))
    refusals = F.filter(F.transform("__j", lambda j: j["denial"]), lambda d: d.isNotNull())
    max_rows = lit_map({r: p["max_rows"] for r, p in perms.items() if "max_rows" in p})
    exclude = lit_map({r: ",".join(p["exclude"]) for r, p in perms.items() if "exclude" in p})
    def last(values: Column) -> Column:
        return F.get(F.reverse(F.filter(values, lambda v: v.isNotNull())), F.lit(0))
    ok = F.coalesce(F.size(refusals) == 0, F.lit(False))
    roles = F.transform("__j", lambda j: j["role"])
    return out.select(
        *requests.columns, ok.alias("authorized"), F.get(refusals, F.lit(0)).alias("reason"),
        F.when(ok, F.array_distinct(roles)).alias("granted_by"),
        F.when(ok, last(F.transform(roles, lambda r: F.element_at(max_rows, r)))).alias("max_rows"),
        F.when(ok, last(F.transform(roles, lambda r: F.element_at(exclude, r)))).alias("excluded"),
        F.when(ok, last(F.transform("__j", lambda j: j["row_filter"]))).alias("row_filter"),
        F.when(ok, last(F.transform("__j", lambda j: j["masking"]))).alias("masking"))


def rbac_batch(requests: DataFrame, roles: Mapping[str, Mapping] = P.RBAC_ROLES, action: str = "action",
               table: str = "table_name") -> DataFrame:
    """Union of all roles of a request: action, then denied tables (deny beats allow), then allowed tables."""
    def having(key: str) -> Column:
        table_of = lit_map({r: list(c.get(key, [])) for r, c in roles.items()})
        return F.flatten(F.filter(F.transform("roles", lambda r: F.element_at(table_of, r)), lambda a: a.isNotNull()))
    act, tab = F.col(action), F.col(table)
    allowed = having("allowed_tables")
    reason = (F.when(~F.array_contains(having("permissions"), act), F.concat(F.lit("Action '"), act, F.lit("' not permitted")))
              .when(F.array_contains(having("denied_tables"), tab), F.concat(F.lit("Access to table '"), tab, F.lit("' denied")))
              .when(~F.array_contains(allowed, "*") & ~F.array_contains(allowed, tab),
                    F.concat(F.lit("Table '"), tab, F.lit("' not in allowed list"))))
    restricted = lit_map({r: ",".join(f"{c}={v}" for c, v in conf["column_restrictions"].items())
                          for r, conf in roles.items() if conf.get("column_restrictions")})
    columns = F.array_distinct(F.filter(F.transform("roles", lambda r: F.element_at(restricted, r)), lambda v: v.isNotNull()))
    return requests.withColumn("denial_reason", reason).withColumn("authorized", F.col("denial_reason").isNull()).withColumn(
        "column_restrictions", F.when(F.col("authorized"), F.array_join(columns, ",")))


def effective_permissions(users: DataFrame, resources: DataFrame, action: str = "read",
                          perms: Mapping[str, Mapping] = P.ROLE_PERMISSIONS,
                          policies: Mapping[str, Mapping] = P.RESOURCE_POLICIES) -> DataFrame:
    """Permission matrix of role sets and resources within a domain.

    Users with the same ordered roles have the same rights, so the matrix is built per distinct role set (a
    handful) instead of per user; ``n_users`` says how many it stands for.
    """
    sets = users.groupBy("domain", "roles").agg(F.count(F.lit(1)).alias("n_users"))
    pairs = resources.join(sets, "domain").withColumn("action", F.lit(action)).withColumn("resources", F.array("resource"))
    return authorize_batch(pairs, perms, policies).drop("resources", "action", "granted_by", "reason")


class PermissionClasses(NamedTuple):
    """``resources`` with class_id, ``users`` counted per role set, and ``matrix``: rights per class and role set."""

    resources: DataFrame
    users: DataFrame
    matrix: DataFrame


def resource_class(resource: Column, action: str, perms: Mapping[str, Mapping], policies: Mapping[str, Mapping]) -> Column:
    """What decides about a resource, as text: the number of its policy, and one bit per role that grants the action on it."""
    res = normalize_uri(resource)
    number = {uri: i for i, uri in enumerate(policies)}
    policy = _policy_case(res, {u: {"n": i} for u, i in number.items()}, lambda p: F.lit(str(p["n"])), F.lit("-"))
    bits = [F.when(_role_grants(F.lit(name), F.lit(action), res, perms), "1").otherwise("0") for name in perms]
    return F.when(res.isNotNull(), F.concat(policy, F.lit(":"), *bits))


def permission_classes(users: DataFrame, resources: DataFrame, action: str = "read",
                       perms: Mapping[str, Mapping] = P.ROLE_PERMISSIONS,
                       policies: Mapping[str, Mapping] = P.RESOURCE_POLICIES) -> PermissionClasses:
    """The matrix of ``effective_permissions``, told once per class of resources and set of roles.

    Resources of one class share their policy and the roles that grant the action, so any of them speaks for all.
    Role sets keep the user's order and lose what no rule names. The matrix holds those pairs that meet in a domain
    and is bounded by the configuration; ``resources`` keeps every column and row (a null resource has a null class
    and no row in the matrix), ``users`` has one row per domain and role set. A hot domain is counted before it
    is joined: one row per class, one per role set. ``expand_permissions`` gives the pairs back.
    """
    known = sorted(set(perms) | {r for p in policies.values() for r in p.get("required_roles", [])})
    role_set = F.array_distinct(F.filter("roles", lambda r: F.coalesce(r.isin(known), F.lit(False))))
    sets = users.withColumn("role_set", F.coalesce(role_set, F.array().cast("array<string>"))).groupBy("domain", "role_set").agg(
        F.count(F.lit(1)).alias("n_users"))
    classed = resources.withColumn("class_id", resource_class(F.col("resource"), action, perms, policies))
    here = classed.where("class_id IS NOT NULL").groupBy("domain", "class_id").agg(F.min("resource").alias("resource"))
    pairs = here.join(sets.select("domain", "role_set"), "domain").groupBy("class_id", "role_set").agg(F.min("resource").alias("example"))
    asked = pairs.withColumns({"roles": F.col("role_set"), "action": F.lit(action), "resources": F.array("example")})
    matrix = authorize_batch(asked, perms, policies).drop("roles", "action", "resources", "granted_by", "reason")
    return PermissionClasses(classed, sets, matrix)


def expand_permissions(classes: PermissionClasses) -> DataFrame:
    """Every resource with every role set of its domain; as large as that is."""
    pairs = classes.resources.join(classes.users, "domain")
    return pairs.join(classes.matrix.drop("example"), ["class_id", "role_set"])


def required_policies(requests: DataFrame, global_policies: Mapping[str, bool] = P.GLOBAL_POLICIES,
                      by_class: Mapping[str, Mapping[str, bool]] = P.CLASSIFICATION_POLICIES,
                      blocked: Sequence[str] = ()) -> DataFrame:
    """Missing global and classification policies, blocked classifications and the policies that count as applied.

    Requests carry the arrays ``applied`` and ``labels``.
    """
    def names(policies: Mapping[str, bool], required_only: bool) -> list[str]:
        return [n for n, req in policies.items() if req or not required_only]
    def of_labels(required_only: bool) -> Column:
        table = lit_map({k: names(v, required_only) for k, v in by_class.items()})
        found = F.filter(F.transform("labels", lambda x: F.element_at(table, x)), lambda a: a.isNotNull())
        return F.flatten(found)
    applied = F.col("applied")
    out = requests.withColumns({
        "missing_global": F.array_except(lit_array(names(global_policies, True)), applied),
        "missing_classification": F.array_except(of_labels(True), applied),
        "blocked": F.array_intersect("labels", lit_array(blocked)),
        "counted": F.array_intersect(F.concat(lit_array(names(global_policies, False)), of_labels(False)), applied)})
    return out.withColumn("valid", (F.size("missing_global") == 0) & (F.size("missing_classification") == 0) & (F.size("blocked") == 0))


@dataclass(frozen=True)
class Condition:
    id: str
    effect: str
    priority: int
    predicate: str


def abac_batch(requests: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Effect of the matching condition with the highest priority; deny wins a tie and is the default."""
    hits = F.array_compact(F.array(*[
        F.when(F.coalesce(F.expr(c.predicate), F.lit(False)),
               F.struct(F.lit(c.priority).alias("priority"), F.lit(1 if c.effect == "deny" else 0).alias("deny"),
                        F.lit(c.id).alias("id"))) for c in conditions]))
    best = F.array_max(hits)
    return requests.withColumn("__b", best).select(
        *requests.columns, F.when(F.col("__b.deny") == 0, "allow").otherwise("deny").alias("decision"),
        F.coalesce(F.col("__b.id"), F.lit("default")).alias("decided_by"))


def action_privilege(action: Column, provider: str) -> Column:
    mapping, _ = P.ACTION_PRIVILEGES[provider]
    return F.coalesce(F.element_at(lit_map(mapping), F.upper(action)), F.upper(action))


def action_privilege_map(requests: DataFrame, grants: DataFrame, provider: str) -> DataFrame:
    """ALLOW where the principal, or one of its groups, holds the privilege the action needs or the umbrella one.

    Requests carry ``principals`` (array). Grants shrink to one row per (principal, resource) before the join.
    """
    _, umbrella = P.ACTION_PRIVILEGES[provider]
    held = grants.groupBy("principal", "resource").agg(F.collect_set("privilege").alias("__held"))
    asked = requests.withColumn("required_privilege", action_privilege(F.col("action"), provider))
    rows = asked.select("request_id", "resource", "required_privilege", F.explode_outer("principals").alias("principal"))
    rows = rows.join(held, ["principal", "resource"], "left")
    has = F.array_contains("__held", F.col("required_privilege")) | F.array_contains("__held", umbrella)
    return rows.groupBy("request_id", "resource", "required_privilege").agg(
        F.when(F.max(F.coalesce(has, F.lit(False))), "ALLOW").otherwise("DENY").alias("decision"))


def active_grants(grants: DataFrame, as_of: Column) -> DataFrame:
    return grants.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
