import pytest

from evidlake.llm import shared

SF = "/root/testdata"


def test_parts_follow_the_size_of_the_files(spark):
    small, large = (spark.read.parquet(f"{SF}/{sf}/documents.parquet") for sf in ("sf0.01", "sf0.1"))
    assert 5 < shared.input_bytes(large) / shared.input_bytes(small) < 20
    assert shared.pieces(large, 1 << 20) > shared.pieces(small, 1 << 20) >= 8
    assert shared.pieces(small, 1 << 40) == 8


def test_a_cluster_needs_a_shared_folder():
    shared.check_local("local[8]")
    shared.check_local("local")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared.check_local(master)
