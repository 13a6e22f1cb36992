"""Policy values used as defaults. Every operator also takes its policy as an argument."""

from __future__ import annotations

# fixed values: consent purposes granted without an explicit record
CONSENT_DEFAULTS = {"analytics": True, "marketing": False, "profiling": False, "third_party": False}

# fixed values: purposes a role may process data for
ROLE_PURPOSES = {
    "analyst": ["analytics"],
    "data_scientist": ["analytics", "profiling"],
    "compliance_officer": ["analytics", "profiling", "marketing"],
}

# fixed values: regions a role is limited to (empty list: no limit)
ROLE_GEO = {"analyst": ["EU"], "data_scientist": [], "compliance_officer": []}

# fixed values: transfer destinations and the mechanism that permits them
TRANSFER_MECHANISMS = {
    "EU": "internal",
    "EEA": "internal",
    "UK": "adequacy_decision",
    "US": "standard_contractual_clauses",
}

# fixed values: clearance levels, lowest first
CLEARANCES = ["public", "internal", "confidential", "restricted", "top_secret"]

# fixed values: role row filters, column restrictions and table permissions
RBAC_ROLES = {
    "analyst": {
        "permissions": ["SELECT"],
        "allowed_tables": ["revenue", "regions", "time_periods"],
        "denied_tables": ["customers"],
        "column_restrictions": {"revenue.amount": "AGGREGATE_ONLY"},
        "row_filters": {"regions.country": ["FR", "DE", "ES", "IT", "NL"]},
    },
    "data_engineer": {"permissions": ["SELECT", "INSERT", "UPDATE"], "allowed_tables": ["*"], "denied_tables": []},
    "admin": {"permissions": ["SELECT", "INSERT", "UPDATE", "DELETE", "ADMIN"], "allowed_tables": ["*"],
              "denied_tables": []},
    "compliance_officer": {"permissions": ["SELECT"], "allowed_tables": ["*"], "denied_tables": []},
}

# fixed values: role grants on resource URIs, with the constraints a grant carries
ROLE_PERMISSIONS = {
    "admin": {"actions": ["read", "write", "delete", "admin"], "resources": ["*"]},
    "analyst": {
        "actions": ["read"],
        "resources": ["catalog://*", "finance.revenue", "finance.customer_transactions"],
        "max_rows": 100_000,
        "exclude": ["SECRET"],
    },
    "engineer": {"actions": ["read", "write"], "resources": ["catalog://*"], "exclude": ["PII", "SECRET"]},
    "viewer": {"actions": ["read"], "resources": ["catalog://*"], "max_rows": 1_000,
               "exclude": ["PII", "SENSITIVE", "SECRET"]},
}

# fixed values: policies attached to resources
RESOURCE_POLICIES = {
    "catalog://finance.customer_transactions": {
        "classifications": ["PII", "SENSITIVE"],
        "required_roles": ["analyst", "admin"],
        "row_filters": ["country IN (${user.allowed_countries})"],
        "column_masking": {"card_number": "mask_last4", "ssn": "full_mask"},
    },
    "catalog://finance.revenue": {
        "classifications": ["INTERNAL"],
        "required_roles": ["analyst", "engineer", "admin"],
    },
    "catalog://hr.salaries": {"classifications": ["PII", "SECRET"], "required_roles": ["admin"]},
}

# fixed values: regions a viewer may see
VIEWER_REGIONS = ["europe", "latam"]

# fixed values: policies a request must have applied, in general and per data classification
GLOBAL_POLICIES = {"authentication": True, "authorization": True, "audit-logging": True, "data-retention": False}
CLASSIFICATION_POLICIES = {
    "PII": {"rgpd": True, "pii-masking": True},
    "SECRET": {"secret-handling": True},
    "CONFIDENTIAL": {"confidential-data": True},
}

# fixed values: trigger -> (action, severity)
ENFORCEMENT = {
    "unauthorized_pii_access": ("deny_and_alert", "high"),
    "missing_consent": ("deny_and_log", "medium"),
    "cross_border_violation": ("deny_and_alert", "high"),
    "retention_violation": ("warn_and_log", "low"),
}

# fixed values: action -> privilege per provider, and the privilege that implies all others
ACTION_PRIVILEGES = {
    "aws": ({"SELECT": "SELECT", "INSERT": "INSERT", "DELETE": "DELETE", "UPDATE": "ALTER", "DESCRIBE": "DESCRIBE",
             "DROP": "DROP", "ALTER": "ALTER", "CREATE": "CREATE_TABLE"}, "ALL"),
    "databricks": ({"SELECT": "SELECT", "INSERT": "MODIFY", "DELETE": "MODIFY", "UPDATE": "MODIFY",
                    "CREATE": "CREATE TABLE", "DROP": "OWNERSHIP", "DESCRIBE": "SELECT"}, "ALL PRIVILEGES"),
}

# fixed values: retention categories with their scope and ages; years are converted to months, None means never
RETENTION = {
    "legal_hold": {"tags": ["legal_hold", "litigation", "investigation"], "archive_months": 12,
                   "delete_months": None, "hold": True},
    "financial": {"tables": ["revenue", "transactions", "invoices", "payments", "expenses"],
                  "patterns": ["*_financial_*", "*_accounting_*"],
                  "archive_months": 24, "delete_months": 120, "hold": True},
    "customer": {"tables": ["customers", "customer_profiles", "customer_preferences"],
                 "patterns": ["customer_*", "*_customer_*"],
                 "archive_months": 24, "anonymize_months": 36, "delete_months": 60},
    "transactional": {"tables": ["audit_logs", "access_logs", "change_history"],
                      "patterns": ["*_log", "*_audit", "*_history"], "archive_months": 12, "delete_months": 36},
    "analytics": {"tables": ["metrics", "aggregations", "reports"],
                  "patterns": ["*_analytics_*", "*_metrics_*", "*_kpi_*"],
                  "archive_months": 24, "delete_months": 84},
    "temporary": {"patterns": ["temp_*", "cache_*", "staging_*", "tmp_*", "*_temp", "*_cache"],
                  "archive_days": 0, "delete_days": 30},
    "default": {"archive_months": 36, "delete_months": 84},
}

SOFT_DELETE_DAYS = 90
NOTIFY_DAYS = 30
