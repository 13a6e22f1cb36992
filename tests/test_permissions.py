"""Rights told per class of resources and set of roles."""

from pyspark.sql import functions as F

from custodia.operators import access

COLUMNS = ["domain", "resource", "role_set", "authorized", "max_rows", "excluded", "row_filter", "masking"]


def _tables(spark):
    users = spark.createDataFrame(
        [(d, r) for d in ("a", "b") for r in (["viewer"], ["viewer", "guest"], ["analyst", "viewer"], ["viewer", "analyst"], ["admin"], [None, "engineer"], [], None)],
        "domain string, roles array<string>")
    names = ["finance.customer_transactions", "catalog://finance.customer_transactions", "finance.revenue", "hr.salaries", "x.y", "catalog://x.z", "s3://elsewhere", None, ""]
    res = spark.createDataFrame([(d, i, n) for d in ("a", "b", "c") for i, n in enumerate(names)], "domain string, id int, resource string")
    return users, res


def test_expanded_classes_are_the_matrix(spark):
    users, res = _tables(spark)
    found = access.permission_classes(users, res)
    got = {tuple(map(str, r)) for r in access.expand_permissions(found).select(COLUMNS).collect()}
    plain = access.effective_permissions(users, res.where("resource IS NOT NULL"))
    known = F.array_distinct(F.filter("roles", lambda r: F.coalesce(r.isin("viewer", "analyst", "admin", "engineer"), F.lit(False))))
    want = {tuple(map(str, r)) for r in plain.withColumn("role_set", F.coalesce(known, F.array().cast("array<string>"))).select(COLUMNS).collect()}
    assert got == want
    # every row of the resources is there, a null one without a class
    assert found.resources.count() == 27 and found.resources.where("class_id IS NULL").count() == 3
    assert found.users.agg(F.sum("n_users")).first()[0] == 16


def test_output_grows_with_classes(spark):
    users = spark.range(300).selectExpr("'d' AS domain", "array(element_at(array('viewer', 'analyst', 'admin'), CAST(id % 3 + 1 AS INT))) AS roles")
    res = spark.range(5000).selectExpr("'d' AS domain", "concat('catalog://t', id) AS resource")
    found = access.permission_classes(users, res)
    assert found.matrix.count() == 3 and found.users.count() == 3 and found.resources.select("class_id").distinct().count() == 1
    assert found.matrix.where("authorized").count() == 3


def test_a_null_among_the_roles_opens_nothing(spark):
    row = spark.sql("SELECT array('engineer', CAST(NULL AS STRING)) AS roles, 'read' AS action, array('hr.salaries') AS resources")
    assert not access.authorize_batch(row).first()["authorized"]


def test_nulls_in_a_request_are_refused(spark):
    rows = spark.createDataFrame([(["admin"], "read", [None]), (["viewer"], None, ["x"]), (["admin"], "read", ["x", None]), (["admin"], "read", None),
                                  (None, "read", ["x"]), (["admin"], "read", ["x"])], "roles array<string>, action string, resources array<string>")
    assert [r["authorized"] for r in access.authorize_batch(rows).collect()] == [False] * 5 + [True]


def test_empty_tables(spark):
    users, res = _tables(spark)
    assert access.permission_classes(users.limit(0), res).matrix.count() == 0
    assert access.permission_classes(users, res.limit(0)).matrix.count() == 0
