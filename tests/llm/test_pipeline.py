"""Every pipeline stage on the smallest tables, against what it promises for its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import numpy as np

from sonaria.llm import mixing, toxicity
from sonaria.llm.simhash import fingerprint
from sonaria.session import materialise, table

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "passage_dedup", "mixing", "packing"]

    def step(name, docs):
        return materialise(stages[name](spark, docs, SF), name)

    clean = step("toxicity", docs)
    assert clean.schema == docs.schema
    scores = toxicity.score_documents(docs, table(spark, SF, "labels")).toPandas()
    assert sorted(clean.toPandas()["doc_id"]) == sorted(scores[scores["predicted"] == 0]["doc_id"])

    single = step("near_dedup", clean)
    before, kept = clean.toPandas(), single.toPandas()
    prints = np.array([fingerprint(t) for t in before["text"]], dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    smallest = before["doc_id"].to_numpy()
    while True:
        reached = np.array([smallest[row].min() for row in near])
        if (reached == smallest).all():
            break
        smallest = reached
    assert sorted(kept["doc_id"]) == sorted(set(smallest))

    cut = step("passage_dedup", single)
    assert cut.schema == docs.schema
    rows = cut.toPandas()
    seen = Counter()
    for text in rows["text"]:
        words = (text or "").lower().split()
        seen.update(tuple(words[i : i + 51]) for i in range(len(words) - 50))
    assert not seen or max(seen.values()) == 1
    lost = set(kept["doc_id"]) - set(rows["doc_id"])
    texts = kept.set_index("doc_id")["text"]
    assert all(len((texts[i] or "").split()) >= 50 for i in lost)

    mixed = step("mixing", cut)
    taken = mixing.mix(cut).toPandas()
    copies = {r.doc_id: r.taken // r.size for r in taken.itertuples() if r.taken}
    assert Counter(mixed.toPandas()["doc_id"]) == copies

    packed = stages["packing"](spark, mixed, SF).toPandas()
    assert set(packed["doc_id"]) == set(copies)
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert Counter(packed[packed["piece"] == 0]["doc_id"]) == copies


def test_run_gives_packed_pieces(spark):
    packed = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(packed.columns)
    assert packed.count() > 0
