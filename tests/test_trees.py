"""Grown trees, pruning, out-of-bag votes and Shapley values against plain recursions and full enumeration."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from modelsift.functions.hashing import hash60
from modelsift.operators import contraction, growth, shapley
from modelsift.operators.contraction import Cut
from modelsift.operators.growth import TreeSpec
from modelsift.plans import ensemble
from modelsift.plans.ensemble import TreeEnsemble


def frame(spark, x, y):
    rows = [(float(v), str(i), [float(c) for c in r]) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "label double, row_id string, x array<double>").select("label", "row_id", array_to_vector("x").alias("features")).repartition(4).cache()


def table(n=400, width=5, seed=0, classes=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).round(1)
    x[:, -1] = rng.integers(0, 2, n)
    score = x[:, 0] + (x[:, 1] > 0.3) * x[:, 2] + 0.5 * x[:, -1] + rng.normal(scale=0.3, size=n)
    return x, np.digitize(score, np.linspace(-0.8, 0.8, classes - 1)).astype(float) if classes else score


def impurity(sums, criterion, classes):
    if not classes:
        return max(sums[2] / sums[0] - (sums[1] / sums[0]) ** 2, 0.0)
    p = np.array(sums) / sum(sums)
    return -(p[p > 0] * np.log2(p[p > 0])).sum() if criterion == "entropy" else 1 - (p * p).sum()


def plain(x, y, w, cuts, t, spec, classes, scale):
    """The tree by recursion: ``{id: (feature, threshold, rows, sums)}``."""
    bins = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], 1)
    out = {}

    def sums(at):
        if classes:
            return [scale[c] * w[at][y[at] == c].sum() for c in range(classes)]
        return [w[at].sum(), (w[at] * y[at]).sum(), (w[at] * y[at] ** 2).sum()]

    def weight(s):
        return sum(s) if classes else s[0]

    def go(node, at, depth):
        s, n = sums(at), len(at)
        out[node] = (None, None, n, s)
        if n < spec.min_split or n < 2 * spec.min_leaf or depth >= spec.max_depth or impurity(s, spec.criterion, classes) <= growth.PURE:
            return
        best = None
        width = x.shape[1]
        looked = growth.tried(np.array([t]), np.array([node]), np.array([spec.seed]), spec.tries, width)[0] if spec.tries and spec.tries < width else range(width)
        for f in looked:
            for b in range(len(cuts[f])):
                left, right = at[bins[at, f] <= b], at[bins[at, f] > b]
                if min(len(left), len(right)) < max(spec.min_leaf, 1):
                    continue
                ls, rs = sums(left), sums(right)
                loss = weight(ls) * impurity(ls, spec.criterion, classes) + weight(rs) * impurity(rs, spec.criterion, classes)
                if not classes:
                    loss = round(loss / (weight(s) * impurity(s, spec.criterion, classes)), 9)
                if best is None or loss < best[0]:
                    best = (loss, f, b, left, right)
        if best:
            out[node] = (int(best[1]), float(cuts[best[1]][best[2]]), n, s)
            go(2 * node, best[3], depth + 1)
            go(2 * node + 1, best[4], depth + 1)

    go(1, np.flatnonzero(w > 0), 0)
    return out


SPECS = [
    TreeSpec(max_depth=6), TreeSpec(min_leaf=7, max_depth=5), TreeSpec(min_split=40, max_depth=8), TreeSpec(max_depth=4, criterion="entropy"),
    TreeSpec(max_depth=5, tries=2, bag=True, seed=7), TreeSpec(min_leaf=3, min_split=11, max_depth=9, tries=2, bag=True, seed=7), TreeSpec(max_depth=0),
]


@pytest.mark.parametrize("classes,bins,at_once", [(3, 64, 1_000_000), (0, 64, 1_000_000), (2, 8, 9)])
def test_growth_equals_a_plain_grower(spark, monkeypatch, classes, bins, at_once):
    monkeypatch.setattr(growth, "NODES_AT_ONCE", at_once)
    x, y = table(seed=classes, classes=classes)
    df = frame(spark, x, y)
    scale = [1.0, 2.5, 0.5][:classes] if classes else None
    specs = [TreeSpec(**{**s.__dict__, "criterion": s.criterion if classes else "variance"}) for s in SPECS]
    grown = growth.grow(df, specs, classes, bins=bins, class_weights=scale)
    cuts = [np.array(c) for c in growth.bin_cuts(df, "features", bins)]
    assert [len(c) for c in cuts][-1] == 1 and max(map(len, cuts)) <= bins
    h = {r["row_id"]: r["h"] for r in df.select("row_id", hash60(["row_id"], 0).alias("h")).collect()}
    w = growth.bag_weights(np.array([h[str(i)] for i in range(len(y))]), specs)
    got: dict[int, dict] = {}
    for r in grown.nodes.collect():
        got.setdefault(r["tree"], {})[r["id"]] = r
    for t, s in enumerate(specs):
        want = plain(x, y, w[:, t], cuts, t, s, classes, scale)
        assert set(got[t]) == set(want)
        for i, (f, thr, n, sums) in want.items():
            r = got[t][i]
            assert (r["feature"], r["threshold"], r["n"]) == (f, thr, n) and r["sums"] == pytest.approx(sums)
            assert r["impurity"] == pytest.approx(impurity(sums, s.criterion, classes), abs=1e-9)
            assert (r["left"], r["right"], r["parent"]) == ((2 * i, 2 * i + 1) if f is not None else (-1, -1)) + (i // 2 if i > 1 else None,)
    # the forest's own out-of-bag votes: leaves of the trees whose bag lacks the row
    says = {}
    for t in got:
        for i in range(len(y)):
            if w[i, t] == 0:
                node = 1
                while got[t][node]["left"] > 0:
                    node = 2 * node + (x[i, got[t][node]["feature"]] > got[t][node]["threshold"])
                s = np.array(got[t][node]["sums"])
                says.setdefault(i, []).append(s / s.sum() if classes else s[1:2] / s[0])
    rows = growth.out_of_bag(grown).first()
    mean = {i: np.mean(v, 0) for i, v in says.items()}
    if classes:
        want_score = np.mean([np.argmax(v) == y[i] for i, v in mean.items()])
    else:
        seen = np.array(list(mean))
        want_score = 1 - np.mean([(y[i] - mean[i][0]) ** 2 for i in seen]) / np.var(y[seen])
    assert rows["rows"] == len(mean) and rows["oob_score"] == pytest.approx(want_score)
    grown.release()


def test_odd_inputs(spark):
    x = np.array([[1.0, np.nan], [2.0, 1.0], [3.0, np.nan], [4.0, 2.0], [5.0, 2.0]])
    df = frame(spark, x, [0, 0, 1, 1, 1])
    one = df.unionAll(df.limit(1).withColumn("label", F.lit(None).cast("double")))
    nodes = growth.grow(one, [TreeSpec()], 2).nodes.orderBy("id").collect()
    assert [(r["id"], r["feature"], r["threshold"], r["n"]) for r in nodes] == [(1, 0, 2.0, 5), (2, None, None, 2), (3, None, None, 3)]
    assert growth.grow(df.withColumn("label", F.lit(1.0)), [TreeSpec(), TreeSpec(bag=True)], 2).nodes.where("left >= 0").count() == 0
    assert growth.grow(df.where("false"), [TreeSpec()], 0).nodes.count() == 0
    again = growth.grow(df.unionAll(df), [TreeSpec(min_leaf=5)], 2).nodes.count()  # repeated rows count each
    assert again == 1 or again == 3


def test_bag_weights_agree_and_are_poisson(spark):
    ids = spark.range(4000).select(F.col("id").cast("string").alias("row_id"))
    df = ids.select(hash60(["row_id"], 0).alias("h")).select("h", growth.bag_weight(F.col("h"), 3, 42).alias("w")).collect()
    got = growth.bag_weights(np.array([r["h"] for r in df]), [TreeSpec(bag=True)] * 4)
    assert [r["w"] for r in df] == got[:, 3].tolist()
    assert abs(got.mean() - 1) < 0.05 and abs(got.var() - 1) < 0.1 and len(set(map(tuple, got.T.tolist()))) == 4


def subtrees(children, i):
    """All prunings of the subtree at ``i`` as sets of leaves."""
    out = [frozenset([i])]
    if i in children:
        out += [a | b for a, b in itertools.product(subtrees(children, 2 * i), subtrees(children, 2 * i + 1))]
    return out


def test_pruning_equals_enumeration(spark, monkeypatch):
    monkeypatch.setattr(contraction, "BAND", 2)
    x, y = table(300, 4, 3, 2)
    grown = growth.grow(frame(spark, x, y), [TreeSpec(max_depth=4, min_leaf=4), TreeSpec(max_depth=3)], 2)
    rows = {(r["tree"], r["id"]): r for r in grown.nodes.collect()}
    cuts = [Cut(t, None, 2, a) for t in (0, 1) for a in (0.0, 0.002, 0.01, 0.03, 1.0)] + [Cut(0, 2, 2, 0.0), Cut(0, None, 60, 0.004)]
    found: dict[int, dict] = {}
    for r in contraction.ends(grown.nodes, cuts).collect():
        found.setdefault(r["setting"], {})[r["leaf"]] = r["end"]
    for i, c in enumerate(cuts):
        inner = {k for (t, k), r in rows.items() if t == c.tree and r["left"] > 0 and (c.max_depth is None or r["depth"] < c.max_depth) and r["n"] >= c.min_split}
        total = rows[c.tree, 1]["weight"]
        cost = lambda leaves: sum(rows[c.tree, k]["impurity"] * rows[c.tree, k]["weight"] / total + c.ccp_alpha for k in leaves)  # noqa: B023, E731
        every = subtrees(inner, 1)
        best = min(map(cost, every))
        if c.ccp_alpha > 0:
            want = min((s for s in every if cost(s) <= best + 1e-12), key=len)
        else:
            want = max(every, key=len)
        assert set(found[i].values()) == want
        for leaf, end in found[i].items():
            assert any(leaf >> k == end for k in range(8))
    kept = contraction.pruned(grown.nodes.where("tree = 0"), contraction.ends(grown.nodes, [Cut(0, 2)])).collect()
    assert {r["id"] for r in kept if r["left"] < 0} == set(found[10].values()) and all(r["depth"] <= 2 for r in kept)
    assert all((r["feature"] is None) == (r["left"] < 0) for r in kept)


def expectation(nodes, x, known, i=1):
    """Path-dependent mean of a tree over the features outside ``known``."""
    r = nodes[i]
    if r["left"] < 0:
        s = np.array(r["sums"])
        return s / s.sum() if len(s) == 2 else s[1:2] / s[0]
    if r["feature"] in known:
        return expectation(nodes, x, known, 2 * i + int(not x[r["feature"]] <= r["threshold"]))
    return sum(nodes[c]["weight"] / r["weight"] * expectation(nodes, x, known, c) for c in (2 * i, 2 * i + 1))


@pytest.mark.parametrize("classes,width,pieces", [(2, 8, 1_000_000), (0, 6, 60)])
def test_shapley_values_equal_all_coalitions(spark, monkeypatch, classes, width, pieces):
    monkeypatch.setattr(shapley, "NODES_AT_ONCE", pieces)
    monkeypatch.setattr(shapley, "CELLS", 5_000)
    x, y = table(250, width, 11, classes)
    x[3, 0] = np.nan
    df = frame(spark, x, y)
    specs = [TreeSpec(max_depth=7, min_leaf=2, criterion="gini" if classes else "variance")] + [TreeSpec(max_depth=5, tries=3, bag=True, criterion="gini" if classes else "variance")] * 2
    grown = growth.grow(df, specs, classes)
    model = TreeEnsemble.of(grown.nodes, len(specs), classes)
    told, base = model.shapley(model.transform(df), width)
    trees: dict[int, dict] = {}
    for r in grown.nodes.collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r
    rows = {int(r["row_id"]): r for r in told.collect()}
    assert base == pytest.approx(np.mean([expectation(t, x[0], set()) for t in trees.values()], 0).tolist())
    for i in (0, 3, 17):
        worth = {s: np.mean([expectation(t, x[i], set(s)) for t in trees.values()], 0) for k in range(width + 1) for s in itertools.combinations(range(width), k)}
        for f in range(width):
            want = 0
            for s in worth:
                if f not in s:
                    share = math.factorial(len(s)) * math.factorial(width - 1 - len(s)) / math.factorial(width)
                    want = want + share * (worth[tuple(sorted((*s, f)))] - worth[s])
            assert [c[f] for c in rows[i]["shapley"]] == pytest.approx(np.asarray(want).tolist(), abs=1e-9)
    for r in rows.values():  # contributions sum to the prediction minus the base value
        whole = [b + sum(c) for b, c in zip(base, r["shapley"])]
        assert whole == pytest.approx(r["probability"].toArray().tolist() if classes else [r["prediction"]])
    sizes = {r["feature"]: r["importance"] for r in shapley.shapley_importance(told, [f"f{i}" for i in range(width)]).collect()}
    assert sizes["f0"] == pytest.approx(np.mean([abs(c[0]) for r in rows.values() for c in r["shapley"]]))


@pytest.mark.parametrize("at_once", [1_000_000, 7])
def test_ensemble_walks_saves_and_loads(spark, tmp_path, monkeypatch, at_once):
    for module in (growth, ensemble):
        monkeypatch.setattr(module, "NODES_AT_ONCE", at_once)
    x, y = table(200, 4, 5, 2)
    df = frame(spark, x, y)
    specs = [TreeSpec(max_depth=4, min_leaf=4), TreeSpec(max_depth=3, bag=True)]
    grown = growth.grow(df, specs, 2)
    model = TreeEnsemble.of(grown.nodes, 2, 2)
    got = {r["row_id"]: (r["prediction"], r["probability"].toArray().tolist()) for r in model.transform(df).collect()}
    trees: dict[int, dict] = {}
    for r in grown.nodes.collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r
    for i in range(len(y)):
        want = np.mean([expectation(t, x[i], set(range(4))) for t in trees.values()], 0)
        assert got[str(i)][1] == pytest.approx(want.tolist()) and got[str(i)][0] == float(np.argmax(want))
    model.write().overwrite().save(str(tmp_path / "m"))
    again = TreeEnsemble.load(str(tmp_path / "m")).transform(df).select("row_id", "prediction").collect()
    assert {r["row_id"]: r["prediction"] for r in again} == {k: v[0] for k, v in got.items()}
    assert model.transform(df.where("false")).count() == 0
    shares = {r["feature"]: r["importance"] for r in model.importances(list("abcd")).collect()}
    assert sum(shares.values()) == pytest.approx(1)
    assert Counter(r["tree"] for r in model.shape().collect()) == {0: 1, 1: 1}


@pytest.mark.parametrize("classes,small,at_once", [(3, 60, 1_000_000), (0, 60, 1_000_000), (2, 25, 9), (2, 0, 9)])
def test_subtrees_of_one_task_equal_those_of_passes(spark, monkeypatch, classes, small, at_once):
    x, y = table(seed=classes, classes=classes)
    df = frame(spark, x, y)
    specs = [TreeSpec(**{**s.__dict__, "criterion": s.criterion if classes else "variance"}) for s in SPECS]
    told = []
    for rows, nodes in ((100_000, 1_000_000), (small, at_once)):
        monkeypatch.setattr(growth, "SMALL", rows)
        monkeypatch.setattr(growth, "NODES_AT_ONCE", nodes)
        monkeypatch.setattr(growth, "CELLS_AT_ONCE", 50 if rows == small else 500_000)
        grown = growth.grow(df, specs, classes)
        told.append(({(r["tree"], r["id"]): (r["feature"], r["cut_bin"], r["n"]) for r in grown.nodes.collect()}, growth.out_of_bag(grown).first()["oob_score"]))
        grown.release()
    assert told[0][0] == told[1][0] and told[0][1] == pytest.approx(told[1][1])


def test_passes_follow_the_rows_not_the_depth(spark, monkeypatch):
    """A chain of 29 levels over few rows needs no pass a level."""
    made = []
    histograms = growth._histograms
    monkeypatch.setattr(growth, "_histograms", lambda *a: made.append(a) or histograms(*a))
    x = np.arange(30.0).reshape(-1, 1)
    nodes = growth.grow(frame(spark, x, 4.0 ** np.arange(30)), [TreeSpec(criterion="variance")], 0).nodes
    assert nodes.where("left < 0").count() == 30 and nodes.agg(F.max("depth")).first()[0] > 10 and not made


@pytest.mark.parametrize("out", [1, 2])
def test_listed_leaves_add_what_all_points_add(monkeypatch, out):
    """Leaves whose patterns are looked up, in time that does not follow the product of rows and points."""
    rng = np.random.default_rng(out)
    x = rng.normal(size=(300, 5)).round(1)
    x[::17, 2] = np.nan
    groups = []
    for m in (1, 2, 4):
        features = np.stack([rng.permutation(5)[:m] for _ in range(40)])
        low, high = rng.normal(-1, 1, (40, m)).round(1), rng.normal(1, 1, (40, m)).round(1)
        low[rng.random((40, m)) < 0.3], high[rng.random((40, m)) < 0.3] = -np.inf, np.inf
        groups.append((features, low, high, rng.uniform(0.1, 1, (40, m)), rng.normal(size=(40, out))))
    kept: dict = {}
    got = shapley.contributions(x, groups, out, kept)
    assert sorted(kept) == [0, 1, 2]
    monkeypatch.setattr(shapley, "CELLS", 0)
    monkeypatch.setattr(shapley, "_listed", lambda *a: False)
    assert got == pytest.approx(shapley.contributions(x, groups, out), abs=1e-12)


@pytest.mark.parametrize("classes,bag", [(3, True), (0, True), (2, False), (0, False)])
def test_rows_of_equal_bins_grow_as_cells(spark, monkeypatch, classes, bag):
    """Many rows of few cells need no pass, and a task gets the cells of a tree and not its rows."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (1_000, 2)).astype(float)
    x[::50, 1] = np.nan
    y = (x[:, 0] + rng.integers(0, 3, len(x))) % (classes or 7)
    df = frame(spark, x, y).repartition(2)
    spec = TreeSpec(max_depth=5, min_leaf=3, criterion="gini" if classes else "variance", tries=1 if bag else 0, bag=bag)
    told = []
    for small, values in ((100_000, 20), (60, 20), (60, 0)):  # one task by rows, one task by cells, passes
        made = []
        histograms = growth._histograms
        with monkeypatch.context() as m:
            m.setattr(growth, "SMALL", small)
            m.setattr(growth, "VALUES", values)
            m.setattr(growth, "_histograms", lambda *a: made.append(a) or histograms(*a))
            grown = growth.grow(df, [spec] * 3, classes)
            told.append({(r["tree"], r["id"]): (r["feature"], r["cut_bin"], r["n"]) for r in grown.nodes.collect()})
            state = grown.state.select("label", "h", "bins", "at")
            first = np.full(3, growth.CODES + growth.FEW, np.int64)
            dealt = state.mapInArrow(growth._dealt([spec] * 3, 2, classes, [], first), "tree int, id int, bins binary, n double, " + ", ".join(f"s{i} double" for i in range(classes or 3)))
            sizes = {r["tree"]: (r["cells"], r["rows"]) for r in dealt.groupBy("tree").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows")).collect()}
            assert all(cells <= 2 * 20 and rows > 550 for cells, rows in sizes.values()) and len(sizes) == 3
            assert bool(made) == (values == 0)
            grown.release()
    assert told[0] == told[1] == told[2]


def test_pruning_of_whole_trees_equals_bands(spark, monkeypatch):
    x, y = table(400, 4, 3, 2)
    grown = growth.grow(frame(spark, x, y), [TreeSpec(), TreeSpec(min_leaf=5, max_depth=9)], 2)
    cuts = [contraction.Cut(t, d, m, a) for t in (0, 1) for d, m, a in ((None, 2, 0.0), (4, 2, 0.001), (None, 30, 0.0), (None, 2, 0.005), (None, 2, 5.0))]
    told, written = [], []
    settled = contraction.settled
    monkeypatch.setattr(contraction, "settled", lambda d, kind: written.append(kind) or settled(d, kind))
    monkeypatch.setattr(contraction, "BAND", 2)
    for whole in (1_000_000, 0):
        monkeypatch.setattr(contraction, "WHOLE", whole)
        told.append({tuple(r) for r in contraction.ends(grown.nodes, cuts).select("setting", "tree", "leaf", "end").collect()})
        assert bool(written) == (whole == 0)
    assert told[0] == told[1] and len({e for _, _, _, e in told[0]}) > 10
    grown.release()


def test_rows_between_the_same_thresholds_are_walked_once(spark, monkeypatch):
    x, y = table(300, 3, 1, 2)
    grown = growth.grow(frame(spark, x, y), [TreeSpec(max_depth=2), TreeSpec(max_depth=2, bag=True)], 2)
    inner, leaves = TreeEnsemble.of(grown.nodes, 2, 2)._steps()
    walked, walk = [], ensemble._walked
    monkeypatch.setattr(ensemble, "_walked", lambda c, rows, at: walked.append(len(rows)) or walk(c, rows, at))
    rows = pa.array([*x.tolist(), *x.tolist()], pa.list_(pa.float64()))
    score = ensemble._whole(inner, leaves, 2, 2).func
    first, again = score(rows).to_pylist(), score(rows).to_pylist()
    assert first == again and first[: len(x)] == first[len(x):] and len(walked) == 1 and walked[0] <= 7 ** 3 and walked[0] < len(x)
    monkeypatch.setattr(ensemble, "KNOWN", 1)
    assert ensemble._whole(inner, leaves, 2, 2).func(rows).to_pylist() == first
    monkeypatch.setattr(ensemble, "NODES_AT_ONCE", 4)
    deep = grown.nodes.where("left >= 0").select("depth").distinct().count()
    assert 1 <= len(list(TreeEnsemble.of(grown.nodes, 2, 2)._steps()[0])) <= deep
