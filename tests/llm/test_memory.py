"""What the helpers of the pipeline leave in a Python worker, which Spark keeps for later tasks."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from axonloom.llm import simhash, textops

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
HELD = """
import random, re, sys
import pyarrow as pa
from axonloom.llm import decontaminate, simhash

def held():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", f.read())[1]) // 1024

def batches():
    draw = random.Random(5)
    for _ in range(2):
        texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(300)) for _ in range(10_000)]
        ids = pa.array(range(len(texts)), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["doc_id", "text_key", "text"])

helper = {
    "sketches": simhash._sketches(5),
    "sets": lambda given: simhash._sets(5)(b.select([2]) for b in given),
    "passages": lambda given: decontaminate._extract([pa.int64(), pa.int64()], 10, 5, [], bytes(1 << 19), False)(given),
}[sys.argv[1]]
for _ in batches():  # what making the texts leaves doesn't count
    pass
before = held()
for _ in helper(batches()):
    pass
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
@pytest.mark.parametrize("helper", ["sketches", "sets", "passages"])
def test_helpers_give_their_memory_back(helper):
    out = subprocess.run([sys.executable, "-c", HELD, helper], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) <= 32  # MB


def test_cut_batches_give_the_same_sketches_and_sets(monkeypatch):
    texts = [None, "", "a b", *(" ".join(f"w{i * j % 37}" for j in range(i)) for i in range(1, 60))]
    ids = pa.array([None, *range(1, len(texts))], pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["doc_id", "text_key", "text"])
    whole = [pa.Table.from_batches(list(f([b]))).to_pylist() for f, b in ((simhash._sketches(5), batch), (simhash._sets(5), batch.select([2])))]
    monkeypatch.setattr(simhash, "sliced", lambda column: textops.sliced(column, 100))
    for f, b, want in ((simhash._sketches(5), batch, whole[0]), (simhash._sets(5), batch.select([2]), whole[1])):
        parts = list(f([b]))
        assert len(parts) > 20 and pa.Table.from_batches(parts).to_pylist() == want
    assert [r["fp"] for r in whole[0]] == [r["fp"] for r in whole[1]] == [simhash._set_id(simhash.shingle_set(t.encode() if t else None, 5)) for t in texts]
    assert [r["size"] for r in whole[0]] == [len(np.unique(r["hashes"])) for r in whole[1]]
