import tempfile

import pytest

from tidemark.operators.lookup import upsert_latest
from tidemark.sinks.versioned import Conflict, VersionedTable

SCHEMA = "md5 string, seq bigint, n int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def stored(table):
    return sorted(map(tuple, table.read().collect()))


def test_versions(spark):
    table = VersionedTable(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), SCHEMA)
    assert table.version() == 0 and stored(table) == []
    assert table.replace(lambda old: upsert_latest(old, rows(spark, ("a", 1, 1), ("b", 1, 2)))) == 1
    # a run that ends between write and publication leaves the old version readable
    table.write(rows(spark, ("z", 9, 9)), 2)
    assert stored(table) == [("a", 1, 1), ("b", 1, 2)]
    assert table.replace(lambda old: upsert_latest(old, rows(spark, ("b", 2, 5), ("c", 1, 3)))) == 2
    assert stored(table) == [("a", 1, 1), ("b", 2, 5), ("c", 1, 3)]
    assert sorted(map(tuple, table.read(1).collect())) == [("a", 1, 1), ("b", 1, 2)]


def test_two_writers(spark):
    table = VersionedTable(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), SCHEMA)
    mine, other = (table.write(rows(spark, (name, 1, 1)), 1) for name in ("mine", "other"))
    table.publish(other)
    with pytest.raises(Conflict):
        table.publish(mine)
    assert stored(table) == [("other", 1, 1)]
    late = []

    def change(old):
        # another writer comes in between, once
        if not late:
            late.append(table.publish(table.write(upsert_latest(old, rows(spark, ("late", 1, 1))), table.version() + 1)))
        return upsert_latest(old, rows(spark, ("me", 1, 1)))

    assert table.replace(change) == 3
    assert [r[0] for r in stored(table)] == ["late", "me", "other"]
    with pytest.raises(Conflict):
        table.replace(lambda old: (table.publish(table.write(rows(spark), table.version() + 1)), rows(spark))[1], tries=1)
    gone = table.clean(keep=1)
    assert len(gone) >= 3 and stored(table) == []
    assert table.clean(keep=1) == []
