import gc
import subprocess
import sys
import weakref

import public_tokenizers
import pyarrow as pa

from roomledger.llm import common, secrets, tokens, toxicity

PATHS = [public_tokenizers.path(f"{name}.json") for name in ("byte_bpe_50k", "word_bpe_49k")]


def test_a_worker_holds_one_encoder_at_a_time():
    first = tokens.encoder(PATHS[0])
    assert tokens.encoder(PATHS[0]) is first
    gone = weakref.ref(first)
    del first
    tokens.encoder(PATHS[1])
    gc.collect()
    assert gone() is None


def test_a_workers_caches_go_when_another_stage_begins(spark, make_docs):
    """One worker encodes, then judges texts: what it has cached for the first is not there during the second."""
    path = PATHS[0]
    machine = toxicity.train(["such a nice day", "you utter idiotface"] * 40, [0, 1] * 40)
    score = toxicity._scorer(spark, machine)

    def run(batches):
        for batch in batches:
            gone = weakref.ref(tokens.encoder(path))
            toxic = score(batch.column(1))[1]
            gc.collect()
            again = score(batch.column(1))[1]
            yield pa.record_batch([pa.array([gone() is None] * len(toxic)), pa.array(toxic), pa.array(again)], names=["gone", "a", "b"])

    common.ready_workers(spark)
    docs = make_docs(["you utter idiotface", "such a nice day", None]).select("doc_id", "text").coalesce(1)
    found = docs.mapInArrow(run, "gone boolean, a bigint, b bigint").collect()
    want = [int(machine.score(machine.features(machine.units([t])[0])) >= 0.5) for t in ("you utter idiotface", "such a nice day", "")]
    assert [tuple(r) for r in found] == [(True, w, w) for w in want]


SCATTERED = """
import numpy as np
from roomledger.llm import common

def mb():
    return int(next(line.split()[1] for line in open("/proc/self/status") if line.startswith("RssAnon"))) // 1024

first = mb()
held = [np.zeros(500, np.uint8) for _ in range(400_000)]
last = np.zeros(500, np.uint8)  # keeps the heap from shrinking at its end
full = mb() - first
del held
common.drop_held()
print(full, mb() - first)
"""


def test_memory_that_was_freed_goes_back_to_the_system():
    run = subprocess.run([sys.executable, "-c", SCATTERED], cwd=common.ROOT, capture_output=True, text=True, check=True)
    full, left = map(int, run.stdout.split())
    assert full > 150 and left < full / 2


def test_texts_reach_workers_in_small_batches(spark):
    session = spark.newSession()
    docs = session.createDataFrame([(i, "x" * 100_000) for i in range(150)], "doc_id bigint, text string").coalesce(1)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["size"])

    found = secrets.redacted(session, docs)
    sizes = [row["size"] for row in found.mapInArrow(run, "size bigint").collect()]
    assert sum(sizes) > 15_000_000 and max(sizes) <= common.BATCH_BYTES + 200_000


def test_a_sessions_own_limit_of_batches_stays(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    common.small_batches(session)
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("2m", "2097152b")
