import os

import pytest

from quern.llm import common


class _Conf:
    def get(self, key, default):
        return default


class _Spark:
    conf = _Conf()

    class sparkContext:  # noqa: N801
        applicationId = "app-without-a-folder"  # noqa: N815
        master = "local[2]"


class _Cluster(_Spark):
    class sparkContext:  # noqa: N801
        applicationId = "app-on-a-cluster"  # noqa: N815
        master = "spark://host:7077"


def test_own_folder_only_where_none_is_set(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert common.shared_dir(_Spark) == common.shared_dir(_Spark) != common.shared_dir(spark)
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(_Cluster)


def test_tables_can_be_released(spark):
    table = common.materialize(spark.range(10), "mine")
    path = table.quern_path.removeprefix("file://")
    assert os.path.isdir(path) and table.count() == 10
    common.release(table)
    assert not os.path.exists(path)


def test_hot_keys_with_wide_rows(spark):
    left = common.materialize(spark.range(9000).selectExpr("id", "if(id < 6000, 0, id) AS k"))
    right = left.groupBy("k").agg({"id": "count"}).selectExpr("k", "`count(id)` AS w", "array_repeat(k, 3) AS payload")
    got = common.join_skewed(left, right, "k", "w", 9000, wide=True)
    assert got.count() == 9000 and got.where("payload[2] <> k OR (w <> 6000 AND k = 0)").count() == 0 and got.columns == ["k", "id", "w", "payload"]
