"""Baselines, ridge regression, truncated SVD and boosting over splits, targets and feature sets."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
#: Trees, depth and learning rate.
TREES = ((50, 2, 0.05), (50, 3, 0.05), (100, 2, 0.03))


def train_mean(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Validation and test rows with the mean target of their split's train rows as yhat; none for splits without train rows."""
    means = rows.where("role = 'train'").groupBy(*keys).agg(F.avg("y").alias("yhat"))
    return rows.where("role in ('validation', 'test')").join(means, keys)


def industry_mean(rows: DataFrame, keys: list[str], industry: str) -> DataFrame:
    """The same by industry, falling back to the global train mean where an industry has no train rows."""
    train = rows.where("role = 'train'")
    own = train.groupBy(*keys, industry).agg(F.avg("y").alias("_own"))
    every = train.groupBy(*keys).agg(F.avg("y").alias("_all"))
    out = rows.where("role in ('validation', 'test')").join(every, keys).join(own, [*keys, industry], "left")
    return out.withColumn("yhat", F.coalesce("_own", "_all")).drop("_own", "_all")


def select_features(features: DataFrame, roles: DataFrame, keys: list[str]) -> DataFrame:
    """Long features (keys, doc_id, name, value) of names that occur in train rows; others are unknown when fitting."""
    names = features.join(roles.where("role = 'train'").select(*keys, "doc_id"), [*keys, "doc_id"], "left_semi").select(*keys, "name").distinct()
    return features.join(names, [*keys, "name"], "left_semi")


def prediction_failures(rows: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """keys, doc_id, reason for rows that can't be predicted: no train rows, no train features, or no features of the row."""
    train = rows.where("role = 'train'")
    has_train = train.select(*keys).distinct().withColumn("_t", F.lit(True))
    has_f = train.join(features.select(*keys, "doc_id").distinct(), [*keys, "doc_id"], "left_semi").select(*keys).distinct().withColumn("_f", F.lit(True))
    own = features.select(*keys, "doc_id").distinct().withColumn("_o", F.lit(True))
    out = rows.where("role in ('validation', 'test')").join(has_train, keys, "left").join(has_f, keys, "left").join(own, [*keys, "doc_id"], "left")
    reason = F.when(F.col("_t").isNull(), "missing_train_rows").when(F.col("_f").isNull(), "missing_train_features").when(F.col("_o").isNull(), "missing_row_features")
    return out.withColumn("reason", reason).where("reason is not null").select(*keys, "doc_id", "reason")


def _rank_ic(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) < 2:
        return 0.0
    x, y = pd.Series(a).rank().to_numpy(), pd.Series(b).rank().to_numpy()
    sx, sy = x.std(), y.std()
    return float(((x - x.mean()) * (y - y.mean())).mean() / (sx * sy)) if sx > 0 and sy > 0 else 0.0


def _gram(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Partial sums of [1, x, y] outer products by group and role: a fixed number of values, whatever the rows."""
    for pdf in batches:
        out = []
        for key, g in pdf.groupby([*keys, "role"], sort=False):
            z = np.column_stack([np.ones(len(g)), np.stack(g["x"].to_numpy()), g["y"].to_numpy()])
            out.append((*key, (z.T @ z).ravel()))
        yield pd.DataFrame(out, columns=[*keys, "role", "s"])


def solve_ridge(gram: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients on raw features and intercept of ridge on features standardised by population deviation, from the Gram matrix."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    sd[sd < 1e-12] = 1.0
    a = cov[:-1, :-1] / np.outer(sd, sd) * n
    beta = np.linalg.solve(a + alpha * np.eye(len(sd)), cov[:-1, -1] / sd * n) / sd
    return beta, float(mean[-1] - mean[:-1] @ beta)


def ridge(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, doc_id, role, y, yhat, alpha for validation and test rows with features x ARRAY<DOUBLE> of one length per group.

    The penalty with the best rank correlation on validation rows wins (the first of equals). Validation predictions come from the train-only
    fit, test ones from a refit on train and validation. Fits need only Gram matrices, which are summed in parallel, so no group's rows
    are gathered; the validation predictions of all penalties are ranked in one shuffle.
    """
    from pyspark.sql import Window

    from signalpanel.functions.stats import average_rank, correlation

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    use = rows.where("x is not null and y is not null")
    parts = use.select(*keys, "role", "x", F.col("y").cast("double").alias("y")).mapInPandas(lambda b: _gram(b, keys), f"{kinds}, role string, s array<double>")
    sums = parts.select(*keys, "role", F.posexplode("s").alias("k", "v")).groupBy(*keys, "role", "k").agg(F.sum("v").alias("v")).groupBy(*keys, "role")
    grams = sums.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("s")).groupBy(*keys)
    grams = grams.agg(F.max(F.when(F.col("role") == "train", F.col("s"))).alias("train"), F.max(F.when(F.col("role") == "validation", F.col("s"))).alias("validation"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g in pdf.itertuples(index=False, name=None):
                key, (train, val) = g[: len(keys)], g[len(keys) :]
                if train is None:
                    continue
                d = int(round(len(train) ** 0.5))
                t = np.asarray(train).reshape(d, d)
                both = t + np.asarray(val).reshape(d, d) if val is not None else t
                for alpha in ALPHAS:
                    for role, m in (("validation", t), ("test", both)):
                        beta, c = solve_ridge(m, alpha)
                        out.append((*key, role, alpha, beta, c))
            yield pd.DataFrame(out, columns=[*keys, "role", "alpha", "beta", "c"])

    fits = grams.mapInPandas(fit, f"{kinds}, role string, alpha double, beta array<double>, c double")
    scored = use.where("role in ('validation', 'test')").join(fits, [*keys, "role"])
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    scored = scored.withColumn("yhat", F.round(F.col("c") + dot, 12)).drop("beta", "c", "x")
    val = scored.where("role = 'validation'")
    ranked = val.withColumns({"ry": average_rank("y", [*keys, "alpha"]), "rp": average_rank("yhat", [*keys, "alpha"])})
    ic = ranked.groupBy(*keys, "alpha").agg(F.round(correlation("ry", "rp"), 12).alias("ic"))
    best = ic.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ic"), "alpha"))).where("_r = 1").select(*keys, "alpha")
    fallback = scored.select(*keys).distinct().join(best, keys, "left").withColumn("alpha", F.coalesce("alpha", F.lit(ALPHAS[0])))
    return scored.join(fallback, [*keys, "alpha"]).select(*keys, "doc_id", "role", "y", "yhat", "alpha")


def boosted_trees(x: np.ndarray, y: np.ndarray, others: list[np.ndarray], trees: int, depth: int, rate: float, bins: int = 256) -> list[np.ndarray]:
    """Predictions for each matrix of ``others`` by squared-error boosting with histogram splits, as the reference's library defaults have it.

    The start is the mean target, the penalty on leaves 1, a child has one row at least; cuts are distinct values, or ``bins`` quantiles if there are more.
    """
    cuts = []
    for c in x.T:
        u = np.unique(c)
        u = u if len(u) <= bins else np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[:-1], method="lower"))
        cuts.append(u[1:])  # a row goes right at or above a cut
    coded = [np.stack([np.searchsorted(cut, c, side="right") for cut, c in zip(cuts, m.T)]) for m in (x, *others)]
    out = [np.full(m.shape[1], y.mean()) for m in coded]
    for _ in range(trees):
        g = out[0] - y
        nodes = [np.zeros(m.shape[1], dtype=np.int64) for m in coded]
        for level in range(depth):
            n_nodes = 1 << level
            best = np.full(n_nodes, 1e-6)
            feature, at = np.full(n_nodes, -1), np.zeros(n_nodes, dtype=np.int64)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                n = len(cut) + 1
                cell = nodes[0] * n + coded[0][f]
                gs = np.cumsum(np.bincount(cell, g, n_nodes * n).reshape(n_nodes, n), axis=1)
                hs = np.cumsum(np.bincount(cell, minlength=n_nodes * n).reshape(n_nodes, n), axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain[(hl < 1) | (ha - hl < 1)] = -np.inf
                j = gain.argmax(axis=1)
                top = gain[np.arange(n_nodes), j]
                better = top > best
                best[better], feature[better], at[better] = top[better], f, j[better]
            for k, m in enumerate(coded):
                f = feature[nodes[k]]
                right = (f >= 0) & (m[np.maximum(f, 0), np.arange(m.shape[1])] > at[nodes[k]])
                nodes[k] = nodes[k] * 2 + right
        leaf = -np.bincount(nodes[0], g, 1 << depth) / (np.bincount(nodes[0], minlength=1 << depth) + 1) * rate
        for k in range(len(coded)):
            out[k] = out[k] + leaf[nodes[k]]
    return out[1:]


def boosting(rows: DataFrame, keys: list[str], grid: tuple = TREES) -> DataFrame:
    """keys, doc_id, role, y, yhat, trees, depth, rate for validation and test rows with features x ARRAY<DOUBLE> of one length per group.

    The grid point with the best rank correlation on validation rows wins, the first of equals (on train rows if there are none). Validation predictions
    come from the train-only fit, test ones from a refit on train and validation. Missing features count as 0; groups without train rows have no
    result. One task fits a group, so it holds the group's rows.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    use = rows.where("x is not null and y is not null and role in ('train', 'validation', 'test')")
    use = use.select(*keys, "doc_id", "role", F.col("y").cast("double").alias("y"), F.transform("x", lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))).alias("x"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        part = {r: pdf[pdf["role"] == r] for r in ("train", "validation", "test")}
        m = {r: (np.stack(p["x"].to_numpy()) if len(p) else np.zeros((0, len(pdf["x"].iloc[0])))) for r, p in part.items()}
        y = {r: p["y"].to_numpy() for r, p in part.items()}
        cols = [*keys, "doc_id", "role", "y", "yhat", "trees", "depth", "rate"]
        if not len(part["train"]):
            return pd.DataFrame(columns=cols)
        on, best, chosen, val = "validation" if len(part["validation"]) else "train", -np.inf, grid[0], None
        for point in grid:
            yhat = boosted_trees(m["train"], y["train"], [m[on]], *point)[0]
            if (ic := _rank_ic(y[on], yhat)) > best:
                best, chosen, val = ic, point, yhat
        both = [np.concatenate([v["train"], v["validation"]]) for v in (m, y)]
        test = boosted_trees(*both, [m["test"]], *chosen)[0]
        out = pd.concat([part["validation"].assign(yhat=val if on == "validation" else np.zeros(0)), part["test"].assign(yhat=test)])
        return out.assign(trees=chosen[0], depth=chosen[1], rate=chosen[2])[cols]

    doc = rows.schema["doc_id"].dataType.simpleString()
    return use.groupBy(*keys).applyInPandas(fit, f"{kinds}, doc_id {doc}, role string, y double, yhat double, trees int, depth int, rate double")


def truncated_svd(entries: DataFrame, scope: list[str], doc: str, term: str, value: str, components: int, fit: str = "true", passes: int = 30, tolerance: float = 1e-3, depth: int = 6) -> DataFrame:
    """``svd_of_blocks`` of (doc, term, value) triplets; the condition ``fit`` says which rows the vectors are found on (train documents)."""
    e = entries.select(*scope, doc, F.expr(fit).alias("fit"), F.col(term).cast("int").alias("t"), F.col(value).cast("double").alias("v"))
    rows = e.groupBy(*scope, doc, "fit").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("_x"))
    blocks = rows.select(*scope, doc, "fit", F.col("_x.t").alias("t"), F.col("_x.v").alias("v")).mapInArrow(*document_blocks(entries.schema, scope, doc))
    return svd_of_blocks(blocks, scope, doc, components, passes, tolerance, depth)


def document_blocks(schema: StructType, scope: list[str], doc: str) -> tuple[Callable, str]:
    """A function of Arrow batches (scope, doc, fit, t, v), and the columns that it gives: scope, fit, d (documents), u (their terms), at (row * terms + column), v.

    A row is a small matrix: up to 128 documents of one scope and fit over the terms that they have. schema has the types of scope and doc.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.select([*scope, "fit"]).to_pandas().groupby([*scope, "fit"], sort=False, dropna=False).ngroup().to_numpy()
            lists = batch.column("t")
            ends, t, v = lists.offsets.to_numpy(), lists.values.to_numpy(), batch.column("v").values.to_numpy()
            first = batch.column("v").offsets[0].as_py() - ends[0]
            n, begin = np.diff(ends), ends[:-1]
            for g in range(keys.max(initial=-1) + 1):
                own = np.flatnonzero((keys == g) & (n > 0))
                total, at = np.concatenate([[0], np.cumsum(n[own])]), 0
                while at < len(own):  # entries are limited, too, for a dense block has documents x terms numbers
                    end = min(at + 128, max(at + 1, int(np.searchsorted(total, total[at] + 65_536, "right")) - 1), len(own))
                    part, k = own[at:end], n[own[at:end]]
                    x = np.arange(k.sum()) + np.repeat(begin[part] - (np.cumsum(k) - k), k)
                    u, col = np.unique(t[x], return_inverse=True)
                    cell = np.repeat(np.arange(len(part)), k) * len(u) + col
                    one = {c: batch.column(c).take(pa.array(part[:1])) for c in [*scope, "fit"]}
                    d = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), batch.column(doc).take(pa.array(part)))
                    us = pa.ListArray.from_arrays(pa.array([0, len(u)], pa.int32()), pa.array(u, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*one.values(), d, us, pa.array([cell.astype(np.int32).tobytes()]), pa.array([v[x + first].tobytes()])], [*one, "d", "u", "at", "v"])
                    at = end

    kinds = ", ".join(f"{k} {schema[k].dataType.simpleString()}" for k in scope)
    return pack, f"{kinds}, fit boolean, d array<{schema[doc].dataType.simpleString()}>, u array<int>, at binary, v binary"


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, terms and dense matrix of each row of blocks; entries of the same cell add up."""
    d, u = batch.column("d"), batch.column("u")
    for i in range(batch.num_rows):
        terms, n = u[i].values.to_numpy(), len(d[i])
        at, v = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("at", np.int32), ("v", np.float64)))
        yield i, terms, np.bincount(at, v, n * len(terms)).reshape(n, len(terms))


def _on_disk(x: np.ndarray) -> np.ndarray:
    """The same numbers in a file without a name, mapped; its pages needn't stay in memory."""
    with tempfile.TemporaryFile() as f:
        mapped = np.memmap(f, dtype=x.dtype, mode="w+", shape=x.shape)
        mapped[:] = x
    return np.asarray(mapped)


def svd_of_blocks(blocks: DataFrame, scope: list[str], doc: str, components: int, passes: int = 30, tolerance: float = 1e-3, depth: int = 6) -> DataFrame:
    """scope, doc, component, score: documents on the leading min(components, rows - 1, columns - 1) right singular vectors of the fit rows.

    blocks are those of ``document_blocks``; ``doc`` names the documents in the result. Vectors are found on those with ``fit``, and all are
    projected. Block Lanczos with ten spare vectors, full orthogonalisation, restarts and a fixed seed, scope by scope: a pass multiplies X'X by one
    terms-by-vectors block in parallel over documents; the last is when each eigenpair's residual is within ``tolerance`` of its own eigenvalue, or the
    pass number ``passes``. No term pairs are built and no task holds the documents; a task holds terms x (components + 10) numbers, the driver a few times that, and ``depth`` times in temporary files. Each vector's
    sign makes its largest loading positive. Components of documents without entries are absent. Runs jobs when called; blocks stay cached.
    """
    from pyspark import StorageLevel

    spark = blocks.sparkSession
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    train = blocks.where("fit")
    sizes = train.groupBy(*scope).agg(F.sum(F.size("d")).alias("n"), F.max(F.array_max("u")).alias("m")).collect()
    # terms that no fit row has must not count as columns
    columns = {tuple(r)[:-1]: r["c"] for r in train.select(*scope, F.explode("u").alias("t")).groupBy(*scope).agg(F.countDistinct("t").alias("c")).collect()}
    rng, block, todo, done = np.random.default_rng(0), 1000, {}, {}
    for r in sorted(sizes, key=lambda r: str(tuple(r))):
        key = tuple(r)[: len(scope)]
        k = max(0, min(components, r["n"] - 1, columns[key] - 1))
        if k:
            todo[key] = (k, r["m"] + 1)

    def multiplied(key: tuple, q: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(q)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, z = held.value, None
            for batch in batches:
                for _, u, x in _matrices(batch):
                    z = np.zeros_like(own) if z is None else z
                    z[u] += x.T @ (x @ own[u])
            for b in range(0 if z is None else -(-len(z) // block)):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([z[b * block : (b + 1) * block].tobytes()])], ["b", "z"])

        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            z = np.sum([np.frombuffer(x) for x in sorted(pdf["z"])], axis=0)
            return pdf.iloc[:1].assign(z=[z.tobytes()])

        own = train
        for c, x in zip(scope, key):
            own = own.where(F.col(c).eqNullSafe(F.lit(x)))
        # a task for each core: each sends terms x vectors numbers
        out = own.select("d", "u", "at", "v").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(partial, "b int, z binary").groupBy("b").applyInPandas(total, "b int, z binary")
        got = np.zeros_like(q)
        for r in out.toLocalIterator():
            got[r["b"] * block : (r["b"] + 1) * block] = np.frombuffer(r["z"]).reshape(-1, q.shape[1])
        held.destroy()
        return got

    for key, (k, m) in todo.items():
        basis = [_on_disk(np.linalg.qr(rng.standard_normal((m, min(k + 10, m))))[0])]
        width = basis[0].shape[1]
        proj = np.zeros((0, 0))  # the Gram matrix in the basis
        for i in range(passes):
            z = multiplied(key, basis[-1])
            spark.sparkContext._jvm.System.gc()  # a pass's shuffle files go once its plan is collected; they would pile up else
            h = np.concatenate([q.T @ z for q in basis])
            old = len(proj)
            grown = np.zeros((len(h), len(h)))
            grown[:old, :old], grown[:, old:], grown[old:, :] = proj, h, h.T
            proj = (grown + grown.T) / 2
            val, w = np.linalg.eigh(proj)
            val, w = val[::-1], w[:, ::-1]
            for _ in range(2):
                for q in basis:
                    z -= q @ (q.T @ z)
            left, sing, _ = np.linalg.svd(z, full_matrices=False)
            off = np.linalg.norm((left.T @ z) @ w[old:, :k], axis=0)
            left, z = left[:, sing > 1e-9 * val[0]], None
            for q in basis:
                left -= q @ (q.T @ left)
            if i == passes - 1 or not left.shape[1] or np.all(off <= tolerance * np.maximum(val[:k], 1e-9 * val[0])):
                break
            if len(basis) < depth:
                basis.append(_on_disk(np.linalg.qr(left)[0]))
                continue
            # the best vectors so far are kept, with what the last pass adds to them
            keep, ends = w[:, :width], np.cumsum([0, *[q.shape[1] for q in basis]])
            best = sum(q @ keep[x:y] for q, x, y in zip(basis, ends, ends[1:]))
            basis, proj = [_on_disk(best), _on_disk(np.linalg.qr(left)[0])], np.diag(val[:width])
        ends = np.cumsum([0, *[q.shape[1] for q in basis]])
        vec = sum(q @ w[x:y, :k] for q, x, y in zip(basis, ends, ends[1:]))
        done[key] = vec * np.sign(vec[np.argmax(np.abs(vec), axis=0), np.arange(k)])
    loads = spark.sparkContext.broadcast(done)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.select(scope).to_pylist()
            for i, u, x in _matrices(batch):
                v = loads.value.get(tuple(keys[i].values()))
                if v is None:
                    continue
                know = u < len(v)  # a term after the last fit term has no loading
                y = x[:, know] @ v[u[know]]
                d = batch.column("d")[i].values
                own = [pa.array([keys[i][c]] * len(d), batch.schema.field(c).type) for c in scope]
                yield pa.RecordBatch.from_arrays([*own, d, pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))], [*scope, doc, "y"])

    kinds = "".join(f"{k} {blocks.schema[k].dataType.simpleString()}, " for k in scope) + f"{doc} {blocks.schema['d'].dataType.elementType.simpleString()}"
    return blocks.select(*scope, "d", "u", "at", "v").mapInArrow(project, f"{kinds}, y array<double>").select(*scope, doc, F.posexplode("y").alias("component", "score"))


def model_manifest(assignments: DataFrame, keys: list[str], version: str, selection_metric: str) -> DataFrame:
    """keys, n_train, n_validation, n_test, selection_metric, version: rows by role, of those that pass the leakage check; a key without any passing row has zeros."""
    of = lambda role: F.count_if((F.col("role") == role) & (F.col("status") == "pass")).alias(f"n_{role}")
    return assignments.groupBy(*keys).agg(of("train"), of("validation"), of("test")).withColumns({"selection_metric": F.lit(selection_metric), "version": F.lit(version)})
