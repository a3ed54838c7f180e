import random
from collections import Counter

import numpy as np

from siltstone.llm import mixing as M

DOCS = "doc_id long, text string, source string, sid int, size long, at string"


def rows():
    rnd = random.Random(7)
    made = [(i, " ".join(f"w{i}.{k}" for k in range(rnd.choice([0, 1, 5, 90, 700]))), f"s{min(i % 7, 4)}", 1, 2, "x") for i in range(260)]
    made += [(None, "same words here again", "s0", 1, 2, "x")] * 150 + [(5, None, None, 1, 2, "x"), (6, "null\tsource \n words", None, 1, 2, "x")]
    return made


def test_the_mix_is_made_of_what_is_taken(spark):
    docs = spark.createDataFrame(rows(), DOCS).repartition(3)
    rules = M.MixRules(block=16, shard_slots=24)
    mix = M.Mix(docs, rules, with_text=True)
    taken, blocks = mix.taken().toPandas(), mix.blocks().toPandas()
    assert len(taken) == 412 and (taken.taken <= 3 * taken["size"]).all()
    assert blocks.n_words.sum() == taken.taken.sum() and (blocks.text.map(lambda t: len(t.split())) == blocks.n_words).all()
    assert blocks.n_words.max() <= 16 and not blocks.duplicated(["source", "slot"]).any()
    # by brute force: the words of each document in the mix, repeats counted
    held = Counter(w.split(".")[0] for t in blocks.text for w in t.split())
    want = {f"w{int(r.doc_id)}": r.taken for r in taken[taken.doc_id.notna()].itertuples() if r.taken and r.source is not None and r.source == r.source}
    assert {k: v for k, v in held.items() if k[1:].isdigit()} == want
    per = blocks.groupby(blocks.source.fillna("-")).n_words.sum()
    target = taken.groupby(taken.source.fillna("-")).target.first()
    assert ((per - target).abs() <= 1).all() and abs(target.sum() - taken["size"].sum()) < 1e-6
    sizes = blocks.groupby("shard").size()
    assert (sizes[:-1] == 24).all() and len(sizes) > 10
    again = M.mix_blocks(docs, rules).toPandas()
    assert sorted(again.text) == sorted(blocks.text)


def test_a_slot_takes_the_permutations_block(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    mix = M.Mix(docs, M.MixRules(block=16, shard_slots=24))
    slots = mix.slots.toPandas()
    assert Counter(slots.sid) == Counter({i: p.slots for i, p in enumerate(mix.plans) if p.slots})
    for i, p in enumerate(mix.plans):
        own = slots[slots.sid == i].sort_values("slot")
        assert own.slot.tolist() == list(range(p.slots))
        for e, (a, c) in enumerate(p.steps):
            turn = own[own.slot // max(1, p.blocks) == e]
            assert turn.block.tolist() == [(a * (s % p.blocks) + c) % p.blocks for s in turn.slot]
    # a source's documents fill its stream without gaps
    for _, own in mix.documents.toPandas().query("size > 0").groupby("sid"):
        own = own.sort_values("at")
        assert own["at"].tolist() == (own["size"].cumsum() - own["size"]).tolist()


def test_draws_use_up_what_is_owed():
    owed = np.array([5, 0, 1000, 77])
    got = list(M.draws(owed, M.lengths(int(owed.sum()), 100), (1, 2)))
    assert (sum(got) == owed).all() and [int(x.sum()) for x in got] == [100] * 10 + [82]
    groups = M.draw_groups(owed.tolist(), M.MixRules(shard_slots=10))
    assert [g[1] for g in groups] == [10 * k for k in range(11)] and (np.sum([g[3] for g in groups], axis=0) == owed).all()


def test_many_sources_and_none(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 400}") for i in range(1200)], "doc_id long, text string, source string")  # targets of 4.5, 9 and 13.5 words
    rules = M.MixRules(broadcast_sources=10)
    assert M.mix_sources(docs, rules).toPandas().taken.sum() == 3729
    assert M.mix_blocks(docs.limit(0)).count() == 0 and M.mix_sources(docs.select("doc_id", "text", F_null(docs)).limit(5)).toPandas().taken.sum() == 15


def F_null(docs):
    from pyspark.sql import functions as F

    return F.lit(None).cast("string").alias("source")
