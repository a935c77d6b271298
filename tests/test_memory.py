"""Node memory as a stream of batches, against a plain loop."""

import math
import random

import numpy as np
import pytest

from tallygraph.streaming import memory as Y

RNG = np.random.default_rng(4)
WIDTH, EDGE, CODE = 2, 1, 4
TAKEN = 2 * WIDTH + EDGE + CODE


def weights(gates, taken=TAKEN):
    return {"w_in": RNG.normal(size=(taken, gates * WIDTH)), "w_hid": RNG.normal(size=(WIDTH, gates * WIDTH)), "b_in": RNG.normal(size=gates * WIDTH), "b_hid": RNG.normal(size=gates * WIDTH)}


GRU, RNN = weights(3), weights(1, 3)
LAYERS = ((RNG.normal(size=(TAKEN, 5)), RNG.normal(size=5)), (RNG.normal(size=(5, 3)), RNG.normal(size=3)))


def make_batches(seed=2):
    r = random.Random(seed)
    t, out = 100, []
    for b in range(3):
        rows = []
        for i in range(r.randint(1, 12)):
            t += r.randint(0, 3)
            rows.append((b, 100 * b + i, t, r.randint(0, 6), r.randint(0, 6), None if r.random() < 0.1 else r.random()))
        out.append(rows)
    return out


def cell(model, x, h):
    for k, (w, b) in enumerate(model.layers):
        x = (np.maximum(x, 0) if k else x) @ w + b
    w = model.weights
    a, c = x @ w["w_in"] + w["b_in"], h @ w["w_hid"] + w["b_hid"]
    if model.cell == "rnn":
        return np.tanh(a + c)
    s = lambda v: 1 / (1 + np.exp(-v))
    r, z = s(a[:WIDTH] + c[:WIDTH]), s(a[WIDTH : 2 * WIDTH] + c[WIDTH : 2 * WIDTH])
    return (1 - z) * np.tanh(a[2 * WIDTH :] + r * c[2 * WIDTH :]) + z * h


class Loop:
    """Dictionaries of memories, times and message lists, one event after the other."""

    def __init__(self, model):
        self.model, self.mem, self.last, self.queue = model, {}, {}, {}

    def messages(self, batch):
        got = {0: {}, 1: {}}
        for side in (0, 1):
            for _, i, t, src, dst, amt in batch:
                own, other = (src, dst) if side == 0 else (dst, src)
                gap = t - self.last.get(own, 0)
                code = [math.cos(gap * 10.0 ** (-9 * k / (CODE - 1))) for k in range(CODE)]
                zero = np.zeros(WIDTH)
                got[side].setdefault(own, []).append((np.concatenate([self.mem.get(own, zero), self.mem.get(other, zero), [amt or 0.0], code]), t))
        return got

    def take(self, node, msgs, floor=0):
        x = msgs[-1][0] if self.model.aggregate == "last" else np.mean([m for m, _ in msgs], axis=0)
        self.mem[node] = cell(self.model, x, self.mem.get(node, np.zeros(WIDTH)))
        self.last[node] = max(msgs[-1][1], floor)

    def step(self, batch):
        nodes = {n for e in batch for n in e[3:5]}
        if not self.model.eager:
            for n in nodes:
                if self.queue.get(n):
                    self.take(n, self.queue.pop(n))
            for side in self.messages(batch).values():
                for n, msgs in side.items():
                    self.queue.setdefault(n, []).extend(msgs)
        else:
            sides, sent = self.messages(batch), {}
            for n, msgs in sides[0].items():
                self.take(n, msgs)
                sent[n] = msgs[-1][1]
            for n, msgs in sides[1].items():
                self.take(n, msgs, sent.get(n, 0))


def events(spark, rows):
    return spark.createDataFrame(rows, "batch long, row_id long, t long, src long, dst long, amt double")


def same(memory, loop):
    got = {r["node"]: (r["memory"], r["last_update"]) for r in memory.collect()}
    assert set(got) == set(loop.mem)
    for n, (h, u) in got.items():
        assert np.allclose(h, loop.mem[n], atol=1e-9) and u == loop.last[n]


@pytest.mark.parametrize("eager,aggregate,kind", [(False, "last", "gru"), (False, "mean", "rnn"), (True, "mean", "rnn")])
def test_batches_equal_a_plain_loop(spark, tmp_path, eager, aggregate, kind):
    model = Y.MemoryModel(WIDTH, ("amt",), CODE, aggregate, LAYERS if kind == "rnn" else (), kind, RNN if kind == "rnn" else GRU, eager=eager)
    state, loop = Y.NodeState(spark, str(tmp_path / "state")), Loop(model)
    assert state.versions() == [] and state.at()[0].count() == 0
    for b, batch in enumerate(make_batches()):
        assert state.apply(events(spark, batch).drop("batch"), b, model)
        loop.step(batch)
    memory, queue = state.at()
    same(memory, loop)
    waiting = {n: len(m) for n, m in loop.queue.items() if m}
    assert {r["node"]: r["count"] for r in queue.groupBy("node").count().collect()} == waiting
    for n, msgs in list(loop.queue.items()):
        loop.take(n, msgs)
    same(Y.seen_memory(memory, queue, model), loop)
    assert state.at()[0].count() == memory.count()  # seeing changes nothing


def test_large_batches_are_several_files(spark, tmp_path, monkeypatch):
    """Every batch takes as many files as the largest, and the replay gives the same."""
    monkeypatch.setattr(Y, "ROWS_A_FILE", 2)
    model, batches = Y.MemoryModel(WIDTH, ("amt",), CODE, weights=GRU), make_batches(5)
    batches[1] = batches[1][:1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stream = Y.stored_batches(events(spark, [r for b in batches for r in b]), str(tmp_path / "events"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = {b: list((tmp_path / "events" / f"batch={b}").glob("part-*")) for b in range(3)}
    assert len({len(x) for x in names.values()}) == 1 and len(names[0]) == -(-max(map(len, batches)) // 2)
    assert sum(spark.read.parquet(str(f)).count() > 0 for f in names[0]) > 1
    state, loop = Y.NodeState(spark, str(tmp_path / "state")), Loop(model)
    state.replay(stream, model)
    assert state.versions() == [0, 1, 2]
    for batch in batches:
        loop.step(batch)
    same(state.at()[0], loop)


def test_stream_restart_restore_and_order(spark, tmp_path):
    model, batches = Y.MemoryModel(WIDTH, ("amt",), CODE, weights=GRU), make_batches(5)
    rows = [r for b in batches for r in b]
    random.Random(1).shuffle(rows)
    stream = Y.stored_batches(events(spark, rows).repartition(3), str(tmp_path / "events"))
    state, loop = Y.NodeState(spark, str(tmp_path / "state")), Loop(model)
    state.replay(stream, model)
    assert state.versions() == [0, 1, 2]
    for batch in batches:
        loop.step(batch)
    same(state.at()[0], loop)
    state.replay(stream, model)  # nothing is left, nothing changes
    assert state.apply(events(spark, batches[2]).drop("batch"), 2, model) is False
    same(state.at()[0], loop)
    with pytest.raises(ValueError):
        state.apply(events(spark, batches[2]).drop("batch"), -1, model)
    with pytest.raises(ValueError):
        state.at(9)

    old = state.branch(1, str(tmp_path / "branch"))
    assert old.versions() == [1] and old.manifest(1)["parent"] == state.root
    for b in (2,):
        old.apply(events(spark, batches[b]).drop("batch"), b, model)
    for mine, theirs in zip(old.at(), state.at()):
        assert sorted(map(str, mine.collect())) == sorted(map(str, theirs.collect()))
    assert state.versions() == [0, 1, 2]


def test_a_batch_without_manifest_does_not_count(spark, tmp_path):
    model, batches = Y.MemoryModel(WIDTH, ("amt",), CODE, weights=GRU), make_batches(6)
    state, loop = Y.NodeState(spark, str(tmp_path / "state"), keep=2), Loop(model)
    state.apply(events(spark, batches[0]).drop("batch"), 0, model)
    loop.step(batches[0])
    state.put_memory(1, spark.createDataFrame([(77, [9.0, 9.0], 5)], Y.MEMORY))  # a run that stopped half way
    assert state.versions() == [0]
    for b in (1, 2):
        state.apply(events(spark, batches[b]).drop("batch"), b, model)
        loop.step(batches[b])
    same(state.at()[0], loop)
    assert state.versions() == [1, 2]


def test_memory_that_nodes_begin_with(spark, tmp_path):
    model, batches = Y.MemoryModel(WIDTH, ("amt",), CODE, weights=GRU, eager=True), make_batches(7)
    state, loop = Y.NodeState(spark, str(tmp_path / "state")), Loop(model)
    loop.mem, loop.last = {n: np.array([n / 7, -0.5]) for n in (0, 3, 99)}, {0: 5, 3: 0, 99: 7}
    state.start(spark.createDataFrame([(n, [float(v) for v in loop.mem[n]], loop.last[n]) for n in loop.mem], Y.MEMORY))
    state.apply(events(spark, batches[0]).drop("batch"), 0, model)
    loop.step(batches[0])
    same(state.at()[0], loop)
    assert state.versions() == [-1, 0] and state.at(-1)[0].count() == 3
    with pytest.raises(ValueError, match="already"):
        state.start()


def test_late_messages_and_wrong_weights(spark, tmp_path):
    model = Y.MemoryModel(WIDTH, ("amt",), CODE, weights=GRU, eager=True)
    state = Y.NodeState(spark, str(tmp_path / "state"))
    state.apply(events(spark, [(0, 1, 50, 1, 2, 1.0)]).drop("batch"), 0, model)
    with pytest.raises(Exception, match="before the last update"):
        state.apply(events(spark, [(1, 2, 40, 1, 3, 1.0)]).drop("batch"), 1, model)
    with pytest.raises(ValueError):
        Y.MemoryModel(WIDTH, (), CODE, weights=GRU)
    with pytest.raises(ValueError):
        Y.MemoryModel(WIDTH, aggregate="first", weights=GRU)


def test_time_gaps(spark):
    memory = spark.createDataFrame([(1, [0.0], 10), (2, [0.0], 30)], Y.MEMORY)
    stats = spark.createDataFrame([(5.0, 2.0, 4.0, 8.0)], "mean_src double, std_src double, mean_dst double, std_dst double")
    ev = spark.createDataFrame([(1, 50, 1, 2, 3)], "row_id long, t long, src long, dst long, neg_dst long")
    r = Y.time_gaps(ev, memory, stats).first()
    assert (r["gap_src"], r["gap_dst"], r["gap_neg"]) == ((40 - 5) / 2, (20 - 4) / 8, (50 - 4) / 8)
