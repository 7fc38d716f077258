import pytest

from websift.llm import common


def test_slices_cover_every_row_once(spark):
    import pyarrow as pa

    texts = ["a" * n for n in (0, 5, 3, 50, 0, 1, 9, 10)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["i", "t"])
    parts = [p.column(0).to_pylist() for p in common.slices(batch, 1, size=10)]
    assert sum(parts, []) == list(range(9)) and all(len(p) == 1 or sum(len(texts[i] or "") for i in p) <= 10 for p in parts)


def test_shared_folder_must_be_given_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


@pytest.mark.parametrize("most", [1 << 28, 64])
def test_marks_miss_no_id(spark, most):
    rows = spark.createDataFrame([(i,) for i in range(4000)] + [(None,)], "n int")
    found = common.marked(rows, "n", spark.range(0, 4000, 8), "met", most).collect()
    assert len(found) == 4001 and all(r.met for r in found if r.n is not None and r.n % 8 == 0)
    assert most == 64 or sum(r.met for r in found) < 500 + 0.06 * 3500
    assert not any(r.met for r in common.marked(rows, "n", spark.range(0), "met").collect())
