from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evidlake import schemas
from evidlake.operators import lookup
from evidlake.scope import TenantScope

D = datetime


@pytest.fixture(scope="module")
def scope(spark):
    rows = {
        "commits": [(t, f"s{i}", "m", "n", None, D(2026, 2, 1), D(2026, 2, 1), "u", []) for t, i in (("t", 1), ("t", 2), ("other", 3))],
        "files_changed": [("t", "s1", p, "modified", 1, 2) for p in ("z", "a", "m")] + [("other", "s3", "x", "added", 1, 0)],
    }
    frames = {n: spark.createDataFrame(r, schemas.table_schema(n)) for n, r in rows.items()}
    return TenantScope("t", frames.__getitem__)


def test_points_and_files(spark, scope):
    assert [r.sha for r in lookup.point(scope, "commit", "s1").collect()] == ["s1"] and lookup.point(scope, "commit", "s3").collect() == []
    assert [r.path for r in lookup.files_of(scope, "s1").collect()] == ["a", "m", "z"] and lookup.files_of(scope, "s3").collect() == []
    keys = spark.createDataFrame([("s1",), ("s1",), ("s2",), ("s3",), (None,)], "key string")
    got = {r.key: (r.found, r.row and r.row.sha, r.files and [f.path for f in r.files]) for r in lookup.commits_with_files(scope.table("commits"), scope.table("files_changed"), keys).collect()}
    assert got == {"s1": (True, "s1", ["a", "m", "z"]), "s2": (True, "s2", []), "s3": (False, None, None)}


def test_tenants_and_keys(spark):
    tenants = spark.createDataFrame([("t", "one"), ("u", "two")], "tenant_id string, slug string")
    keys = spark.createDataFrame([("t", bytearray(b"a"), None), ("u", bytearray(b"b"), D(2026, 1, 1)), ("u", bytearray(b"c"), D(2026, 3, 1))], "tenant_id string, key_hash binary, revoked_at timestamp")
    assert [r.tenant_id for r in lookup.tenant_of(tenants, "two").collect()] == ["u"] and lookup.tenant_of(tenants, "three").collect() == []
    owner = lambda h: [r.slug for r in lookup.key_owner(keys, tenants, F.lit(h).cast("binary"), F.lit(D(2026, 2, 1))).collect()]
    assert [owner(h) for h in ("a", "b", "c", "d")] == [["one"], [], ["two"], []]


def test_pages_of_a_hot_artefact(spark):
    df = spark.createDataFrame([("hot", i % 250) for i in range(500)] + [("b", 7), (None, 1), ("b", None)], "artefact string, chunk_id int").repartition(5)
    got = {(r.artefact, r.page): list(r["keys"]) for r in lookup.key_pages(df, by=["artefact"], key="chunk_id", page=100).collect()}
    assert got == {("hot", 0): list(range(100)), ("hot", 1): list(range(100, 200)), ("hot", 2): list(range(200, 250)), ("b", 0): [7], (None, 0): [1]}
    with pytest.raises(ValueError):
        lookup.key_pages(df, by=["artefact"], key="chunk_id", page=0)
