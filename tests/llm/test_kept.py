"""What a worker remembers of one stage is gone in the next one."""

import pyarrow as pa
from gridgauge.llm import common, toxicity


def test_memory_of_one_operator_at_a_time():
    model = toxicity.Model((1, 2), (0.5, 0.5), (0.0, 1.0, 2.0))
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    held = []

    class Rows:
        def mapInArrow(self, run, schema):  # noqa: N802
            return list(run(iter([batch])))

    def asks():
        held.append(toxicity.prepared(model))
        return lambda b: b

    common.per_batch(Rows(), asks, "x long")
    common.per_batch(Rows(), asks, "x long")
    assert held[0] is held[1] and len(common._kept) == 1
    assert common.per_batch(Rows(), lambda: lambda b: b, "x long") == [batch] and not common._kept
