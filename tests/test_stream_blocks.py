"""Blocks kept up by a stream equal those of the whole table, and a batch writes only what it changed."""

import random

from loquent.operators import memory
from loquent.streaming import blocks

DDL = "chat_id bigint, seq bigint, role string, content string, version bigint"


def run(spark, folder, **more):
    stream = spark.readStream.schema(DDL).parquet(f"{folder}/in")
    query = blocks.keep(stream, f"{folder}/out", f"{folder}/cp", **more)
    assert query.awaitTermination(180)
    if query.exception():
        raise query.exception()
    return spark.read.schema(blocks.SCHEMA).parquet(f"{folder}/out")


def add(spark, folder, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def whole(spark, state, size):
    frame = spark.createDataFrame([(c, s, *x[1:]) for (c, s), x in state.items() if x[2] is not None], "chat_id bigint, seq bigint, role string, content string")
    return {(r.chat_id, r.block_idx): (r.seq_start, r.seq_end, r.n, r.seq_mid, r.text, r.content_hash) for r in memory.blocks(frame, size).collect()}


def held(changes):
    return {(r.chat_id, r.block_idx): (r.seq_start, r.seq_end, r.n, r.seq_mid, r.text, r.content_hash) for r in blocks.current(changes).collect()}


def test_batches_of_new_edited_deleted_and_late_messages(spark, tmp_path):
    rng = random.Random(8)
    folder, state, version, counts = str(tmp_path), {}, 0, []
    for batch in range(4):
        rows = []
        for chat in range(6) if batch == 0 else rng.sample(range(6), 3):
            for _ in range(rng.randrange(1, 14)):
                version += 1
                kind = rng.random()
                own = [s for c, s in state if c == chat]
                seq = rng.choice(own) if own and kind < 0.4 else rng.randrange(60) * 2 + (kind < 0.6)
                content = None if kind < 0.1 else rng.choice([f" text {version} ", "\n", "é" * 3])
                rows.append((chat, seq, rng.choice(["user", "assistant", "assistant", "system"]), content, version))
        rows.append((rows[0][0], rows[0][1], "user", "an older version", 0))
        rng.shuffle(rows)
        for c, s, role, content, v in rows:
            if (c, s) not in state or v >= state[c, s][0]:
                state[c, s] = (v, role, content)
        add(spark, folder, rows)
        changes = run(spark, folder, size=3)  # each run goes on from the checkpoint of the one before
        assert held(changes) == whole(spark, state, 3)
        counts.append(changes.count())
    assert blocks.current(changes).count() <= counts[-1]
    blocks.compacted(changes, f"{folder}/small")
    assert held(spark.read.parquet(f"{folder}/small")) == held(changes)


def test_a_batch_writes_in_proportion_to_what_it_touches(spark, tmp_path):
    folder = str(tmp_path)
    add(spark, folder, [(c, s, "user", f"{c}-{s}", 0) for c in range(5) for s in range(40)])
    before = run(spark, folder, size=4).count()
    assert before == 50
    add(spark, folder, [(2, 40, "user", "one more", 1), (3, 5, "user", "edited", 1), (4, 5, "user", "4-5", 1)])
    changes = run(spark, folder, size=4)
    new = {(r.chat_id, r.block_idx) for r in changes.filter("revision = 2").collect()}
    assert new == {(2, 10), (3, 1)}  # the third changed nothing

