import math
import os
import threading

import numpy as np
import pytest
from llm_helpers import SF, same_rows

from tidemark.llm import embeddings
from tidemark.llm.components import components
from tidemark.llm.embeddings import codes_of, near_vectors, plan_tables, possible, usable
from tidemark.session import FREE_SHUFFLES
from tidemark.llm.queries import QUERIES, SQL


def plain(rows, threshold=0.9):
    """n_links and component of every row by comparing all pairs."""
    good = [
        i for i, (_, v) in enumerate(rows)
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    ]
    near = {i: set() for i in range(len(rows))}
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    for i in good:
        for j in good:
            if i < j and len(unit[i]) == len(unit[j]) and (rows[i][1] == rows[j][1] or unit[i] @ unit[j] >= threshold):
                near[i].add(j)
                near[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=repr)


def collected(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def some_rows(count=150, size=24, seed=2):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        base = draw.standard_normal(size) if i % 3 or not rows else np.array(rows[draw.integers(len(rows))][1])
        noise = draw.choice([0.0, 0.02, 0.09, 0.13]) * draw.standard_normal(size)
        rows.append((i * 11 % count, (base + noise).tolist()))
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = some_rows() + [
        (500, None), (501, [0.0] * 24), (502, [float("nan")] * 24), (503, [None] * 24), (504, [math.inf] + [1.0] * 23),
        (505, []), (506, [1.0, 2.0]), (507, [1.0, 2.01]), (None, [1.0, 2.0]), (None, None), (500, [3.0, -1.0]), (500, [3.0, -1.0]),
    ]
    base = some_rows(1, 24, 9)[0][1]
    rows += [(600 + i, [x + 0.001 * i * (k % 5) for k, x in enumerate(base)]) for i in range(40)] + [(700 + i, base) for i in range(30)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, n_links INT")
    assert collected(near_vectors(frame)) == plain(rows)


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert near_vectors(frame).collect() == []
    assert frame.filter(usable("embedding")).count() == 0


def test_query_equals_sql(spark, reference):
    same_rows(QUERIES["op10_rotation_codes"](spark, SF), reference, SQL["op10_rotation_codes"])


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(1)
    a = draw.standard_normal((4000, 64))
    b = 0.6 * a + 0.8 * draw.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    turned, code, factor = codes_of(a)
    other, _, _ = codes_of(b)
    truth = (a * b).sum(axis=1)
    estimate = (code * other).sum(axis=1) / factor
    assert abs((estimate - truth).mean()) < 0.005
    near = a[:400] + 0.05 * draw.standard_normal((400, 64))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    reach = (a[:400] @ near.T) >= 0.9
    assert (possible(code[:400], factor[:400], codes_of(near)[0], 0.9) >= reach).all() and reach.sum() >= 300
    assert possible(code[:400], factor[:400], codes_of(near)[0], 0.9).mean() < 0.05


def test_tables_grow_slowly():
    assert plan_tables(500, 0.9, 0.999)[1] < plan_tables(10**6, 0.9, 0.999)[1] < 500


def test_components(spark):
    draw = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = components(spark.createDataFrame(edges, "a BIGINT, b BIGINT"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent} and len(got) == len(parent)
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT"), "a", "b").collect() == []


def test_negative_zeros_keep_their_links(spark):
    rows = [(5, [1.0, -0.0, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [1.0, -0.0, -0.0]), (8, [-0.0, 2.0, 0.0]), (9, [-0.0, 2.0, 0.01]), (10, [-0.0, 0.0, 0.0])]
    for kind in ("DOUBLE", "FLOAT"):
        frame = spark.createDataFrame(rows, f"vec_id BIGINT, embedding ARRAY<{kind}>")
        assert collected(near_vectors(frame)) == plain(rows)


@pytest.mark.parametrize("block", [1 << 18, 60])
def test_tables_inside_a_cell_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "DENSE", 8)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "PASS_BYTES", 0)
    rows = some_rows(400, 24, 4)
    base = some_rows(1, 24, 9)[0][1]
    rows += [(600 + i, [x + 0.001 * i * (k % 5) for k, x in enumerate(base)]) for i in range(90)]
    for kind in ("DOUBLE", "FLOAT"):
        rows = [(i, np.array(v, "f4" if kind == "FLOAT" else "f8").tolist()) for i, v in rows]
        frame = spark.createDataFrame(rows, f"vec_id BIGINT, embedding ARRAY<{kind}>")
        assert collected(near_vectors(frame)) == plain(rows)


def test_pairs_at_the_threshold_are_met():
    draw = np.random.default_rng(6)
    unit = draw.standard_normal((6000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    aside = draw.standard_normal((3000, 64))
    aside -= (aside * unit[:3000]).sum(axis=1, keepdims=True) * unit[:3000]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    raw = np.concatenate([unit, (0.9 + 1e-9) * unit[:3000] + math.sqrt(1 - 0.9**2) * aside])
    side = np.zeros(len(raw), np.int64)
    found = list(embeddings._near_pairs(raw, side, 0.9, 0.9999, 100, 8, 0, -1))
    pairs = sorted((min(a, b), max(a, b)) for x, y in found for a, b in zip(x.tolist(), y.tolist()))
    assert len(pairs) == len(set(pairs)) and set(pairs) <= {(i, 6000 + i) for i in range(3000)} and len(pairs) >= 2998
    side[6000:] = 1  # two blocks: the same pairs, all of them across
    across = embeddings._near_pairs(raw, side, 0.9, 0.9999, 100, 8, 0, -1)
    assert sorted((min(a, b), max(a, b)) for x, y in across for a, b in zip(x.tolist(), y.tolist())) == pairs


def test_cells_do_not_depend_on_the_batch():
    raw = np.random.default_rng(7).standard_normal((5000, 64)).astype("f4")
    unit = embeddings._unit(raw, embeddings._norms(raw))
    cells = embeddings.cells_of(unit, 50, 25)
    for k in (1, 3, 64, 1001):
        parts = [embeddings._unit(raw[i : i + k], embeddings._norms(raw[i : i + k])) for i in range(0, 2000, k)]
        assert (np.concatenate([embeddings.cells_of(p, 50, 9, 11) for p in parts]) == cells[: sum(map(len, parts)), 11:20]).all()


def test_cut_cells_are_dealt_within_the_bytes_of_a_pass():
    plans, weights = {64: (4, 7), 8: (2, 5)}, {64: 1 << 30, 8: 1 << 20}
    cut = {(64, 3, 5): (9, 1 << 28), (64, 3, 7): (4, 1 << 29), (8, 0, 2): (2, 1 << 19)}
    passes = embeddings._passes(7, plans, weights, cut)
    whole = [unit for each in passes for unit in each]
    assert sorted(whole) == sorted([(t, 0, o) for t in range(7) for o in (0, 1)] + [(3, d, 1) for d in range(1, 5)] + [(0, 1, 0)])
    assert max(sum(apart == 0 for _, apart, _ in each) for each in passes) == 1


def test_disk_does_not_grow_with_the_number_of_tables(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PASS_BYTES", 0, raising=False)
    unit = np.random.default_rng(8).standard_normal((6000, 64)).astype("f4")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/dealt"
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "vec_id BIGINT, embedding ARRAY<FLOAT>").write.parquet(path)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [f.getPath() for f in manager.localDirs()]

    def held():
        total = 0
        for folder in folders:
            for at, _, names in os.walk(folder):
                for name in names:
                    if name.startswith("shuffle_"):
                        try:
                            total += os.path.getsize(f"{at}/{name}")
                        except OSError:  # given up meanwhile
                            pass
        return total

    before, peak, over = held(), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            peak[0] = max(peak[0], held() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert near_vectors(spark.read.parquet(path)).filter("n_links > 0").count() == 0
    finally:
        over.set()
        watcher.join()
    assert peak[0] < 4 * unit.nbytes
    assert spark.conf.get(FREE_SHUFFLES) == "false"
