import struct

import numpy as np

from gradloom.functions import vectors as V
from gradloom.operators import trajectory
from gradloom.operators.store import ChunkStore, batch_starts
from gradloom.sources import labels, midi, sequences, tables
from gradloom.streaming.step_cache import StepCache


def test_labels(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 10 as int) as label")
    for p in (0.0, 0.1, 1.0):
        got = labels.flip_labels(df, p, 10, 3).collect()
        assert sum(r.flipped for r in got) == int(p * 1000)
        assert all((r.new_label != r.label) == r.flipped and 0 <= r.new_label < 10 for r in got)
    assert {r.label for r in labels.keep_labels(df, {3: 0, 5: 1}).collect()} == {0, 1}


def test_sequences(spark):
    df = spark.createDataFrame([(1, list(range(1, 8))), (2, []), (3, [9])], "id int, tokens array<int>")
    got = {(r.id, r.block): (r.x, r.y) for r in sequences.blocks(df, 3).collect()}
    assert got == {(1, 0): ([1, 2, 3], [2, 3, 4]), (1, 1): ([4, 5, 6], [5, 6, 7]), (1, 2): ([7, 0, 0], [0, 0, 0]), (3, 0): ([9, 0, 0], [0, 0, 0])}
    got = {r.id: (r.x, r.y) for r in sequences.pad_or_cut(df, 4, 98, 99).collect()}
    assert got == {1: ([1, 2, 3, 4], [2, 3, 4, 5]), 2: ([99] * 4, [98, 99, 99, 99]), 3: ([9, 99, 99, 99], [98, 99, 99, 99])}
    assert [(r.id, r.at) for r in sequences.sliding_windows(df, 5, 2).collect()] == [(1, 0), (1, 2)]
    texts = spark.createDataFrame([(1, "hello"), (2, None)], "id int, text string")
    v = sequences.char_vocabulary(texts)
    assert [r.ch for r in v.orderBy("id").collect()] == ["e", "h", "l", "o"]
    enc = sequences.encode_chars(texts, v)
    assert [r.back for r in sequences.decode_chars(enc, v, out="back").orderBy("id").collect()] == ["hello", None]


def test_token_files(spark, tmp_path):
    path = str(tmp_path / "train.bin")
    with open(path, "wb") as f:
        f.write(struct.pack("<10H", *range(60000, 60010)))
    sequences.register(spark)
    got = spark.read.format("tokenfile").option("block", 4).option("partitionTokens", 4).load(path).orderBy("block").collect()
    assert [r.tokens for r in got] == [[60000, 60001, 60002, 60003], [60004, 60005, 60006, 60007], [60008, 60009]]


def test_midi_round_trip(spark):
    notes = [(60, 64, 0.0, 0.5), (64, 80, 0.25, 3.5), (60, 64, 1.0, 1.25)]
    assert sorted(midi.decode_events(midi.encode_notes(notes))) == sorted(notes)
    df = spark.createDataFrame([(1, notes), (2, None)], f"id int, notes array<{midi.NOTE}>")
    back = midi.decode_column(midi.encode_column(df), out="back").orderBy("id").collect()
    assert sorted(tuple(n) for n in back[0].back) == sorted(notes) and back[1].back is None


def test_store_and_checkpoints(spark, tmp_path):
    store = ChunkStore(str(tmp_path / "chunks"), 4)
    store.write(spark.range(20).selectExpr("id", "cast(id div 2 as int) as batch"))
    assert sorted(r.batch for r in store.read(spark, 3, 6).collect()) == [3, 3, 4, 4, 5, 5] and store.batch(spark, 9).count() == 2
    assert [(r.chunk, r.batches, r.rows) for r in store.chunks(spark).collect()] == [(0, 4, 8), (1, 4, 8), (2, 2, 4)]
    assert [tuple(r) for r in batch_starts(spark.createDataFrame([(0, 3), (1, 2)], "batch int, n int")).collect()] == [(0, 0, 3), (1, 3, 5)]
    c = tables.Checkpoints(str(tmp_path / "ckpt"))
    w = [{"fc1": np.arange(6.0).reshape(2, 3), "fc2": np.ones((1, 2))}, {"fc1": np.zeros((2, 3)), "fc2": np.ones((1, 2))}]
    c.save(spark, w)
    assert c.indices(spark) == [0, 1] and np.array_equal(c.load(spark, 0, "fc1")["fc1"], w[0]["fc1"])
    flat = tables.flatten_layers(w[0])
    assert all(np.array_equal(a, w[0][k]) for k, a in tables.unflatten_layers(flat, w[0]).items())
    assert tables.layer_numbers(["fc1.weight", "fc1.bias", "fc2.weight"]) == {"fc1.weight": 0, "fc1.bias": 0, "fc2.weight": 1}
    paths = spark.createDataFrame([("d/index_10",), ("d/index_2",), ("d/other",)], "path string")
    assert [r.number for r in tables.numbered_folders(paths).collect()] == [2, 10]


def test_streamed_steps_equal_appended(spark, tmp_path):
    rows = [(e, s, e * 10 + s * 2 + i, 0.4, [float(i + 1), float(s - e)]) for e in range(2) for s in range(2) for i in range(2)]
    schema = "epoch int, step int, id long, rate double, g array<double>"
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    stream = StepCache(str(tmp_path / "stream"))
    stream.write_stream(spark.readStream.schema(schema).parquet(source), str(tmp_path / "cp")).awaitTermination(60)
    direct = StepCache(str(tmp_path / "direct"))
    for e in range(2):
        for s in range(2):
            direct.append(spark.createDataFrame([(r[2], r[4]) for r in rows if r[:2] == (e, s)], "id long, g array<double>"), e, s, 0.4)
    key = lambda c: sorted((r.epoch, r.step, r.id, r.eta, tuple(r.g)) for r in c.read(spark).collect())
    assert key(stream) == key(direct)
    assert trajectory.trajectory_embeddings(direct.read(spark), 2).count() == 8
    direct.clear(spark)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, float("nan")], 1)], "a array<double>, b array<double>, y int")
    r = df.select(V.norm("a").alias("n"), V.normalize("a").alias("u"), V.nan_to_num("b").alias("z"), V.outer("a", "a").alias("o"), V.softmax("a").alias("p"), V.cross_entropy("a", "y").alias("ce"), V.smoothed_cross_entropy("a", "y", 0.1).alias("s"), V.matvec([[1, 1], [0, 2]], "a").alias("m"), V.one_hot("y", 3).alias("h")).first()
    p = np.exp([3.0, 4.0]) / np.exp([3.0, 4.0]).sum()
    assert r.n == 5 and r.u == [0.6, 0.8] and r.z == [1.0, 0.0] and r.o == [9.0, 12.0, 12.0, 16.0] and np.allclose(r.p, p)
    assert np.isclose(r.ce, -np.log(p[1])) and np.isclose(r.s, 0.9 * -np.log(p[1]) + 0.1 * -np.log(p).mean()) and r.m == [7.0, 8.0] and r.h == [0.0, 1.0, 0.0]
