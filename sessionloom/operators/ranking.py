"""The second stage: a tree ranker, its scores, importances and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import materialise
from .candidates import FEATURES
from .running import running_sums

#: Gains of the labels 0 to 3.
GAINS = (0, 1, 3, 7)
#: Trees after which the candidates' scores are written again, so that a round passes over this many at most.
RESCORE = 8
#: Bins of a feature at most, so that a bin is a byte, and sessions whose candidates make one row of a packed table.
BINS, CHUNK = 256, 256
PACKED = "sizes binary, labels binary, bins binary, scores binary"


class Ranker:
    """LambdaMART: boosted regression trees on the gradients of NDCG over a session's candidates.

    A row per session holds its candidates, so the gradients of a round need no exchange; a session has at most as many as
    the candidate steps let through (two hundred or so). Features are cut into bins once; a level of a tree is one pass that sums
    gradients and curvatures by leaf, feature and bin. Leaves are Newton steps.
    """

    def __init__(self, trees: list[tuple[float, dict]]) -> None:
        #: (weight, root) of each tree; nodes as plain dicts.
        self.trees = trees

    @classmethod
    def fit(cls, frame: DataFrame, rounds: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 7, valid: DataFrame | None = None, patience: int = 40, min_leaf: int = 1) -> Ranker:
        """With valid rows, rounds end after `patience` without a better mean NDCG@20 there, and the best prefix stays. Nothing is drawn, so seed changes nothing."""
        raw = materialise(query_groups(frame).where(F.array_min("labels") < F.array_max("labels")), "ltr-groups")
        if raw.isEmpty():
            return cls([])  # nothing to tell apart
        cuts = _cuts(raw)
        groups = materialise(raw.mapInArrow(_packed(cuts), PACKED), "ltr-packed")
        held = materialise(query_groups(valid).mapInArrow(_packed(cuts), PACKED), "ltr-valid") if valid is not None else None
        trees: list[tuple[float, dict]] = []
        best, best_at, scored = -1.0, 0, 0
        for _ in range(rounds):
            if len(trees) - scored >= RESCORE:
                groups = materialise(groups.mapInArrow(_rescored(trees[scored:]), PACKED), "ltr-packed")
                held = materialise(held.mapInArrow(_rescored(trees[scored:]), PACKED), "ltr-valid") if held is not None else None
                scored = len(trees)
            # a tree passes over its rows once a level; lost blocks come again from the groups' table
            rows = groups.mapInArrow(_steps(trees[scored:]), "bins binary, gradient binary, curvature binary").persist()
            trees.append((rate, _grown(rows, cuts, depth, min_leaf)))
            rows.unpersist()
            if held is not None:
                ndcg = held.mapInArrow(_quality(trees[scored:]), "ndcg double").agg(F.avg("ndcg")).first()[0] or 0.0
                if ndcg > best:
                    best, best_at = ndcg, len(trees)
                elif len(trees) - best_at >= patience:
                    break
        return cls(trees[:best_at] if held is not None else trees)

    def score(self, frame: DataFrame) -> DataFrame:
        """frame with the score: Arrow batches through all trees, a vector operation per node."""
        import numpy as np
        import pandas as pd

        trees = self.trees

        def scored(features):
            x = features.to_numpy(float)
            return pd.Series(sum((w * tree_values(t, x) for w, t in trees), np.zeros(len(x))))

        scored.__annotations__ = {"features": pd.DataFrame, "return": pd.Series}
        columns = F.struct(*(F.col(f).cast("double").alias(f) for f in FEATURES))
        return frame.withColumn("score", F.pandas_udf(scored, "double")(columns))

    def importance(self, spark) -> DataFrame:
        """feature, importance: the total gain of its splits."""
        gains = [0.0] * len(FEATURES)

        def walk(n: dict) -> None:
            if "value" not in n:
                gains[n["feature"]] += n["gain"]
                walk(n["left"])
                walk(n["right"])

        for _, root in self.trees:
            walk(root)
        return spark.createDataFrame(list(zip(FEATURES, gains)), "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def explain(self, frame: DataFrame) -> DataFrame:
        """session_code, item, base, score, contributions (a double per feature that add up to score - base)."""
        import numpy as np
        import pyarrow as pa

        trees, features = self.trees, FEATURES

        def explained(batches):
            base = sum(w * expected(t) for w, t in trees)
            for batch in batches:
                x = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features]).T
                score = sum((w * tree_values(t, x) for w, t in trees), np.zeros(len(x)))
                phi = sum((w * tree_shap(t, x, len(features)) for w, t in trees), np.zeros(x.shape))
                contributions = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(features)), pa.array(np.ascontiguousarray(phi).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("session_code"), batch.column("item"), pa.array(np.full(len(x), base, float)), pa.array(score), contributions], names=["session_code", "item", "base", "score", "contributions"])

        return frame.select("session_code", "item", *FEATURES).mapInArrow(explained, "session_code long, item string, base double, score double, contributions array<double>")


def query_groups(frame: DataFrame) -> DataFrame:
    """labels and rows of features: a row per session, its candidates in the order of their items."""
    one = F.struct("item", F.col("label").cast("int").alias("label"), F.array(*(F.col(f).cast("double") for f in FEATURES)).alias("x"))
    grouped = frame.groupBy("session_code").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return grouped.select(F.transform("c", lambda c: c["label"]).alias("labels"), F.transform("c", lambda c: c["x"]).alias("xs"))


def tree_values(node: dict, x, cut: str = "threshold", leaf: str = "value"):
    """The values of one tree for the rows of x; cut "bin": for rows of bins."""
    import numpy as np

    out = np.empty(len(x))

    def walk(node: dict, rows) -> None:
        if "value" in node:
            out[rows] = node[leaf]
            return
        left = x[rows, node["feature"]] <= node[cut]
        walk(node["left"], rows[left])
        walk(node["right"], rows[~left])

    walk(node, np.arange(len(x)))
    return out


def lambdas(gains, scores):
    """Gradient and curvature of each row of one session: every pair of unequal gains pulls by the change of NDCG that swapping it makes."""
    import numpy as np

    rank = np.empty(len(scores), np.int64)
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
    discount = 1 / np.log2(rank + 2.0)
    ideal = (np.sort(gains)[::-1] / np.log2(np.arange(len(gains)) + 2.0)).sum()
    if ideal <= 0:
        return np.zeros(len(scores)), np.zeros(len(scores))
    up = np.flatnonzero(gains > gains.min())  # a row per candidate that is above another
    swap = np.maximum(gains[up, None] - gains, 0) * np.abs(discount[up, None] - discount) / ideal
    rho = 1 / (1 + np.exp(np.clip(scores[up, None] - scores, -50, 50)))
    pull = rho * swap
    bend = pull * (1 - rho)
    gradient, curvature = -pull.sum(0), bend.sum(0)
    gradient[up] += pull.sum(1)
    curvature[up] += bend.sum(1)
    return gradient, curvature


def ndcg(gains, scores, k: int = 20) -> float:
    import numpy as np

    discount = 1 / np.log2(np.arange(min(k, len(gains))) + 2.0)
    ideal = (np.sort(gains)[::-1][:k] * discount).sum()
    return float((gains[np.argsort(-scores, kind="stable")][:k] * discount).sum() / ideal) if ideal > 0 else 0.0


def _counted(batches):
    """feature, value, n: how often each feature has a value among up to CHUNK sessions."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            x = batch.column("xs").slice(at, CHUNK).flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            for f in range(len(FEATURES)):
                value, n = np.unique(x[:, f][~np.isnan(x[:, f])], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), f, np.int32)), pa.array(value), pa.array(n)], names=["feature", "value", "n"])


def _cuts(groups: DataFrame) -> list:
    """The upper ends of each feature's bins: all values where they are fewer than BINS, else the exact ends of even shares of all candidates."""
    import numpy as np

    counts = groups.select("xs").mapInArrow(_counted, "feature int, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "ltr-values")
    sizes = {r.feature: (r.k, r.n) for r in counts.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()}
    few = [f for f, (k, _) in sizes.items() if k < BINS]
    cuts = counts.where(F.col("feature").isin(few)).select("feature", "value")
    if len(few) < len(sizes):
        many = counts.where(~F.col("feature").isin(few))
        total = F.create_map(*(F.lit(v) for f, (_, n) in sizes.items() for v in (f, n)))
        share = F.floor((F.col("upto") - 1) * (BINS - 1) / total[F.col("feature")])
        cuts = cuts.union(running_sums(many, ["feature"], "value", {"n": "upto"}).groupBy("feature", share.alias("share")).agg(F.max("value").alias("value")).select("feature", "value"))
    ends: list = [[] for _ in FEATURES]
    for r in cuts.collect():
        ends[r.feature].append(r.value)
    return [np.array(sorted(e)) for e in ends]


def _row(**columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in columns.values()], names=list(columns))


def _packed(cuts):
    """Rows of sessions as rows of CHUNK sessions: their sizes, and their candidates' labels, bins (feature by feature) and scores of 0."""
    import numpy as np

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                labels, xs = part.column("labels"), part.column("xs")
                x = xs.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
                bins = np.stack([np.searchsorted(c, x[:, f]).astype(np.uint8) for f, c in enumerate(cuts)])
                yield _row(sizes=np.diff(labels.offsets.to_numpy()).astype(np.int32), labels=labels.flatten().to_numpy(zero_copy_only=False).astype(np.int8), bins=bins, scores=np.zeros(len(x)))

    return run


def _read(batches, **types):
    import numpy as np

    for batch in batches:
        for r in range(batch.num_rows):
            yield [np.frombuffer(batch.column(n)[r].as_buffer(), t) for n, t in types.items()]


def _scored(batches, trees):
    """sizes, labels, bins and scores of each row, the values of trees added to the scores."""
    for sizes, labels, bins, scores in _read(batches, sizes="i4", labels="i1", bins="u1", scores="f8"):
        bins = bins.reshape(len(FEATURES), -1)
        yield sizes, labels, bins, scores + sum(w * tree_values(t, bins.T, "bin") for w, t in trees)


def _sessions(sizes, labels, scores):
    """gains and scores of each session."""
    import numpy as np

    gains, ends = np.asarray(GAINS, float)[labels], np.cumsum(sizes)
    for a, b in zip(ends - sizes, ends):
        yield gains[a:b], scores[a:b]


def _rescored(trees):
    def run(batches):
        for sizes, labels, bins, scores in _scored(batches, trees):
            yield _row(sizes=sizes, labels=labels, bins=bins, scores=scores)

    return run


def _steps(trees):
    import numpy as np

    def run(batches):
        for sizes, labels, bins, scores in _scored(batches, trees):
            gradient, curvature = map(np.concatenate, zip(*(lambdas(*s) for s in _sessions(sizes, labels, scores))))
            use = curvature > 0
            yield _row(bins=bins[:, use], gradient=gradient[use], curvature=curvature[use])

    return run


def _quality(trees):
    import pyarrow as pa

    def run(batches):
        for sizes, labels, _, scores in _scored(batches, trees):
            yield pa.RecordBatch.from_arrays([pa.array([ndcg(*s) for s in _sessions(sizes, labels, scores)], pa.float64())], names=["ndcg"])

    return run


def _histogram(root: dict, leaves: int):
    """cell, n, h, g: rows, curvature and gradient of each open leaf, feature and bin, summed over a task's rows."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        sums = np.zeros((3, len(FEATURES), leaves * BINS))
        for bins, gradient, curvature in _read(batches, bins="u1", gradient="f8", curvature="f8"):
            bins = bins.reshape(len(FEATURES), -1)
            at = tree_values(root, bins.T, "bin", "at").astype(np.int64)
            use = np.flatnonzero(at >= 0)
            first, h, g = at[use] * BINS, curvature[use], gradient[use]
            for f in range(len(FEATURES)):
                cell = first + bins[f, use]
                for k, weight in enumerate((None, h, g)):
                    sums[k, f] += np.bincount(cell, weight, leaves * BINS)
        sums = sums.reshape(3, -1)
        cell = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(cell), *(pa.array(s[cell]) for s in sums)], names=["cell", "n", "h", "g"])

    return run


def _grown(rows: DataFrame, cuts: list, depth: int, min_leaf: int) -> dict:
    """A tree, level by level. A split lowers the weighted squared error of gradient / curvature the most; of equal ones, the first feature and bin."""
    import numpy as np

    root = {"value": 0.0, "n": 0.0, "at": 0}
    level = [root]
    for _ in range(depth):
        found = rows.mapInArrow(_histogram(root, len(level)), "cell long, n double, h double, g double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("g").alias("g")).toArrow()
        sums = np.zeros((3, len(FEATURES) * len(level) * BINS))
        sums[:, found["cell"].to_numpy()] = [found[c].to_numpy() for c in "nhg"]
        sums = sums.reshape(3, len(FEATURES), len(level), BINS)
        grown = []
        for k, node in enumerate(level):
            n, h, g = whole = sums[:, :, k].sum(2)[:, 0]
            if node is root:
                node |= {"value": float(g / h) if h > 0 else 0.0, "n": float(n)}
            node["at"] = -1
            left = np.cumsum(sums[:, :, k], 2)
            right = whole[:, None, None] - left
            may = (np.minimum(left[0], right[0]) >= max(1, min_leaf)) & (left[1] > 0) & (right[1] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(may, left[2] ** 2 / left[1] + right[2] ** 2 / right[1] - g**2 / h, 0.0)
            # sums of doubles differ in their last digits between runs
            if gain.max() <= 1e-9 * (g**2 / h if h > 0 else 0.0) + 1e-12:
                continue
            f, b = np.unravel_index(np.argmax(gain >= gain.max() * (1 - 1e-9)), gain.shape)
            sides = [{"value": float(s[2, f, b] / s[1, f, b]), "n": float(s[0, f, b]), "at": len(grown) + i} for i, s in enumerate((left, right))]
            del node["value"]
            node |= {"feature": int(f), "bin": int(b), "threshold": float(cuts[f][b]), "gain": float(gain[f, b]), "left": sides[0], "right": sides[1]}
            grown += sides
        if not grown:
            break
        level = grown
    return root


def expected(node: dict) -> float:
    if "value" in node:
        return node["value"]
    return (node["left"]["n"] * expected(node["left"]) + node["right"]["n"] * expected(node["right"])) / node["n"]


def tree_shap(root: dict, x, size: int):
    """Exact path-dependent Shapley values of one tree for the rows of x: a leaf is reached by a product over its path's features of a
    cover share (feature unknown) or 0 or 1 for the row (known), so each leaf's values come from the weights of subsets of that path alone,
    and only from which of its features the row agrees with: they are worked out once for each such pattern."""
    from math import factorial

    import numpy as np

    phi = np.zeros((size, len(x)))

    def leaf(value: float, path: dict) -> None:
        """path: feature -> (share if unknown, whether each row agrees)."""
        names, m = list(path), len(path)
        code = np.zeros(len(x), np.int64)
        for i, f in enumerate(names):
            code |= path[f][1].astype(np.int64) << i
        if 1 << m <= max(256, len(x)):
            kinds, at = np.arange(1 << m), code
        else:
            kinds, at = np.unique(code, return_inverse=True)
        ones = {f: (kinds >> i & 1).astype(float) for i, f in enumerate(names)}
        for f in names:
            # polynomials in the number of known features among the others, a row each
            weights = np.ones((len(kinds), 1))
            for g in names:
                if g != f:
                    grown = np.zeros((len(kinds), weights.shape[1] + 1))
                    grown[:, :-1] += weights * path[g][0]
                    grown[:, 1:] += weights * ones[g][:, None]
                    weights = grown
            shapley = weights @ np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
            phi[f] += (value * (ones[f] - path[f][0]) * shapley)[at]

    def walk(node: dict, path: dict) -> None:
        if "value" in node:
            leaf(node["value"], path)
            return
        f = node["feature"]
        goes_left = x[:, f] <= node["threshold"]
        for child, taken in ((node["left"], goes_left), (node["right"], ~goes_left)):
            share, agrees = path.get(f, (1.0, True))
            walk(child, path | {f: (share * child["n"] / node["n"], agrees & taken)})

    walk(root, {})
    return phi.T
