import os
from types import SimpleNamespace

import pytest

from topolark.llm import common


def cluster():
    """A session of a cluster without a shared folder."""
    none = SimpleNamespace(get=lambda *_: None)
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: none, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    return SimpleNamespace(conf=none, sparkContext=sc)


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster())


def test_scope_deletes_scratch_tables(spark):
    kept = common.Scratch(spark)
    outside = kept.write(spark.range(3))
    with common.scratch_scope(spark):
        inner = common.Scratch(spark)
        assert inner.write(spark.range(2)).count() == 2
        assert os.path.isdir(inner.root.removeprefix("file:"))
    assert not os.path.exists(inner.root.removeprefix("file:")) and outside.count() == 3
    kept.drop(outside)
    assert not os.path.exists(outside._scratch_path.removeprefix("file:"))


@pytest.mark.parametrize("columns", [["doc_id", "text", "row_"], ["text"]])
def test_text_beside_the_other_columns(spark, columns):
    df = spark.createDataFrame([tuple("abc"[: len(columns)])], columns)
    packed = common.beside_text(df)
    assert packed.columns == ["row_", "text"] and packed.select(*common.with_text(columns)).collect() == df.collect()
