"""Permutation inference for the linear model at every node, with enhanced maps and family-wise corrected p-values.

Data and tested column are residualised once against the confounds; the statistic of a draw is then a few dot products for each node (Freedman and
Lane's scheme on residuals). Draws are rows of a range, dealt over tasks; draw b depends on the seed and b alone, so any split, and
continuing a stored null, gives the same numbers. What a task returns is a maximum for each draw and counts for each node.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.graph import Domain, NeuroError
from quillon.operators.resample import Scheme, resample_indices, sign_flips
from quillon.operators.tfce import INFERENCE, InvalidParams, Tail, TfceParams, Weighting, checked_broadcast, resolve_params, tfce_map

#: Bytes of residual data that are broadcast at most.
LARGEST = 2 << 30
#: A column whose residual is shorter than this share of it lies in the span of the others.
SPAN = 1e-10


class TooFewSubjects(NeuroError):
    """Fewer rows than the design needs."""


class DegenerateDesign(NeuroError):
    """A tested column in the span of the confounds."""


def row_sums(w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[column of w, column of y]: sums over the rows, in order, so that a column's bits don't depend on the columns beside it."""
    out = np.zeros((w.shape[1], y.shape[1]))
    for a, b in zip(w, y, strict=True):
        out += a[:, None] * b[None, :]
    return out


def _squares(y: np.ndarray) -> np.ndarray:
    total = np.zeros(y.shape[1])
    for row in y:
        total += row * row
    return total


def _residual(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    y = x.reshape(len(x), -1)
    for _ in range(2):
        for k, c in enumerate(row_sums(basis, y)):
            y = y - basis[:, k : k + 1] * c[None, :]
    return y.reshape(x.shape)


def nuisance_basis(confounds: np.ndarray | None, n: int, intercept: bool) -> np.ndarray:
    """[n, q]: orthonormal columns that span the confounds (and the constant); dependent ones are left out."""
    columns = ([np.ones(n)] if intercept else []) + (list(np.asarray(confounds, float).reshape(n, -1).T) if confounds is not None and np.size(confounds) else [])
    basis = np.zeros((n, 0))
    for c in columns:
        if not np.isfinite(c).all():
            raise InvalidParams("confounds must be finite")
        r = _residual(c, basis)
        if np.linalg.norm(r) > SPAN * np.linalg.norm(c):
            basis = np.column_stack((basis, r / np.linalg.norm(r)))
    return basis


@dataclass(frozen=True)
class PermOpts:
    params: TfceParams
    tail: Tail
    seed: int
    n_perm: int
    batch: int = 8


@dataclass(frozen=True)
class NullState:
    """A finished null: what it was computed for, sorted maxima and counts of each node."""

    seed: int
    maxima: np.ndarray
    exceed: np.ndarray
    tfce_obs: np.ndarray
    params: TfceParams
    tail: Tail
    n: int
    q: int
    engine: str = "ols"


@dataclass(frozen=True)
class TfceInference:
    """stat_obs, p_fwe and p_unc of each node, and the null."""

    stat_obs: np.ndarray
    p_fwe: np.ndarray
    p_unc: np.ndarray
    null: NullState

    @property
    def tfce_obs(self) -> np.ndarray:
        return self.null.tfce_obs

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(node, stat, tfce, p_fwe, p_unc)."""
        t = pa.table({"node": np.arange(len(self.stat_obs)), "stat": self.stat_obs, "tfce": self.tfce_obs, "p_fwe": self.p_fwe, "p_unc": self.p_unc})
        return spark.createDataFrame(t)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write as Parquet: a row of arrays, with the settings as JSON."""
        meta = {"seed": self.null.seed, "tail": self.null.tail.value, "n": self.null.n, "q": self.null.q, "engine": self.null.engine, "params": asdict(self.null.params) | {"weighting": self.null.params.weighting.value}}
        arrays = {"stat_obs": self.stat_obs, "p_fwe": self.p_fwe, "p_unc": self.p_unc, "maxima": self.null.maxima, "exceed": self.null.exceed.astype(float), "tfce_obs": self.null.tfce_obs}
        kinds = T.StructType([T.StructField("meta", T.StringType()), *(T.StructField(k, T.ArrayType(T.DoubleType())) for k in arrays)])
        spark.createDataFrame([(json.dumps(meta), *(v.tolist() for v in arrays.values()))], kinds).coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfceInference:
        df = spark.read.parquet(path)
        if not {"meta", "stat_obs", "maxima"} <= set(df.columns):
            raise ValueError(f"{path} isn't a stored result")
        r = df.first().asDict()
        m = json.loads(r["meta"])
        params = TfceParams(**(m["params"] | {"weighting": Weighting(m["params"]["weighting"])}))
        a = {k: np.array(v) for k, v in r.items() if k != "meta"}
        return cls(a["stat_obs"], a["p_fwe"], a["p_unc"], NullState(m["seed"], a["maxima"], a["exceed"].astype(np.int64), a["tfce_obs"], params, Tail(m["tail"]), m["n"], m["q"], m["engine"]))


def t_values(w: np.ndarray, residuals: np.ndarray, dof: int) -> np.ndarray:
    """The t statistic of each node (column of unit-length residuals) under a design [row, column]; sums run over the rows in order.

    What the design leaves is squared itself: 1 less the squares of the dot products would lose its digits where the fit is close.
    """
    dots, rss = row_sums(w, residuals), np.zeros(residuals.shape[1])
    for a, left in zip(w, residuals, strict=True):
        for k, d in zip(a, dots, strict=True):
            left = left - k * d
        rss += left * left
    with np.errstate(all="ignore"):
        return np.where(rss <= 4 * np.finfo(float).eps * dof, 0.0, dots[0] * np.sqrt(dof / rss))


class Design:
    """What draws do to the rows: the residual of the tested column, the basis of the confounds, and how draw b rearranges them. Without a tested column, signs are flipped."""

    def __init__(self, n: int, tested: np.ndarray | None, confounds: np.ndarray | None, opts: PermOpts) -> None:
        if not 1 <= opts.n_perm < 1 << 32 or opts.batch < 1:
            raise InvalidParams("n_perm and batch must be positive")
        basis = nuisance_basis(confounds, n, tested is not None)
        q = basis.shape[1]
        if n < q + 2:
            raise TooFewSubjects(f"needs {q + 2} rows, got {n}")
        x = np.ones(n) if tested is None else np.asarray(tested, float)
        if len(x) != n or not np.isfinite(x).all():
            raise NeuroError("the tested column must be finite and of the data's length")
        r = _residual(x, basis)
        if np.linalg.norm(r) <= SPAN * np.linalg.norm(x):
            raise DegenerateDesign("the tested column lies in the span of the confounds")
        self.n, self.q, self.dof, self.seed = n, q, n - q - 1, opts.seed
        self.columns = np.column_stack((r / np.linalg.norm(r), basis))
        self.flip = tested is None
        self.exact = self.flip and n < 64 and 1 << n <= opts.n_perm
        self.draws = 1 << n if self.exact else opts.n_perm

    def residuals(self, data: np.ndarray) -> np.ndarray:
        """[row, node] data less the confounds, of unit length; zero where nothing is left."""
        y = _residual(data.astype(float), self.columns[:, 1:])
        size, whole = np.sqrt(_squares(y)), np.sqrt(_squares(data))
        with np.errstate(all="ignore"):
            return np.where(size > SPAN * whole, y / size, 0.0)

    def rearranged(self, draw: int) -> np.ndarray:
        """The design of a draw; draw 0 is the observed one."""
        if not self.flip:
            return self.columns if draw == 0 else self.columns[resample_indices(Scheme.PERMUTATION, self.n, draw, self.seed).astype(np.int64)]
        if self.exact:
            signs = 1.0 - 2.0 * ((draw >> np.arange(self.n)) & 1)
        else:
            signs = np.ones(self.n) if draw == 0 else sign_flips(self.n, draw, self.seed)
        return self.columns * signs[:, None]


class PermProblem:
    """Everything that is fixed across draws, with the data as one matrix."""

    def __init__(self, domain: Domain, data: np.ndarray, tested: np.ndarray | None, confounds: np.ndarray | None, opts: PermOpts, extend: NullState | None = None) -> None:
        n, v = data.shape
        if v != domain.n:
            raise NeuroError(f"needs {domain.n} nodes, got {v}")
        if not np.isfinite(data).all():
            raise NeuroError("data must be finite")
        self.domain, self.opts, self.design = domain, opts, Design(n, tested, confounds, opts)
        self.n, self.q, self.draws, self.dof = n, self.design.q, self.design.draws, self.design.dof
        self.store = self.design.residuals(data)
        if self.design.exact and extend is not None:
            raise InvalidParams("an enumerated null can't be continued")
        self.stat_obs = self.stats([0])[0]
        self.tfce_obs = tfce_map(domain, self.stat_obs, opts.params, opts.tail)
        self.first = 0
        if extend is not None:
            same = (extend.seed, extend.params, extend.tail, extend.n, extend.q) == (opts.seed, opts.params, opts.tail, n, self.q) and np.array_equal(extend.tfce_obs, self.tfce_obs)
            if not same or len(extend.maxima) >= self.draws:
                raise InvalidParams("the stored null is of another test, or has as many draws")
            self.first = len(extend.maxima)
        self.extend = extend

    def stats(self, draws) -> np.ndarray:
        """t maps [draw, node]; a map's bits don't depend on the batch."""
        return np.array([t_values(self.design.rearranged(d), self.store, self.dof) for d in draws])

    def run(self, draws) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of some draws, and how often each node reaches its observed value."""
        two = self.opts.tail is Tail.TWO_SIDED
        observed = np.abs(self.tfce_obs) if two else self.tfce_obs
        maxima, exceed = [], np.zeros(self.domain.n, np.int64)
        draws = list(draws)
        for at in range(0, len(draws), self.opts.batch):
            m = np.stack([tfce_map(self.domain, s, self.opts.params, self.opts.tail) for s in self.stats(draws[at : at + self.opts.batch])])
            m = np.abs(m) if two else m
            maxima += np.maximum(0.0, m.max(1, initial=0.0)).tolist()
            exceed += (m >= observed).sum(0)
        return np.array(maxima), exceed

    def finalize(self, maxima: np.ndarray, exceed: np.ndarray) -> TfceInference:
        """p-values from all draws, those of a continued null included."""
        if self.extend is not None:
            maxima, exceed = np.concatenate((maxima, self.extend.maxima)), exceed + self.extend.exceed
        maxima = np.sort(maxima)
        observed = np.abs(self.tfce_obs) if self.opts.tail is Tail.TWO_SIDED else self.tfce_obs
        p_fwe = (len(maxima) - np.searchsorted(maxima, observed, "left")) / len(maxima)
        return TfceInference(self.stat_obs, p_fwe, exceed / len(maxima), NullState(self.opts.seed, maxima, exceed, self.tfce_obs, self.opts.params, self.opts.tail, self.n, self.q))


def run_draws(spark: SparkSession, problem: PermProblem, partitions: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Run the draws over tasks; each gives its maxima and counts, which are summed before they are collected."""
    if problem.store.nbytes > LARGEST:
        raise NeuroError(f"residual data of more than {LARGEST} bytes isn't broadcast")
    checked_broadcast(spark, problem.domain).unpersist()
    shared = spark.sparkContext.broadcast(problem)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            if ids:
                maxima, exceed = shared.value.run(ids)
                yield pa.RecordBatch.from_arrays([pa.array([maxima], pa.list_(pa.float64())), pa.array([exceed], pa.list_(pa.int64()))], ["maxima", "exceed"])

    parts = spark.range(problem.first, problem.draws, 1, partitions).mapInArrow(run, "maxima array<double>, exceed array<long>")
    # one pass: a row for each task, its maxima and its counts
    got = parts.collect()
    return np.concatenate([np.array(r["maxima"]) for r in got]), np.sum([np.array(r["exceed"], np.int64) for r in got], 0)


def stat_maps(spark: SparkSession, problem: PermProblem, partitions: int = 8) -> DataFrame:
    """(draw, node, stat): the t maps of the draws, without enhancement."""
    shared = spark.sparkContext.broadcast(problem)

    def run(batches):
        for b in batches:
            for d in b.column(0).to_pylist():
                s = shared.value.stats([d])[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), d)), pa.array(np.arange(len(s))), pa.array(s)], ["draw", "node", "stat"])

    return spark.range(problem.first, problem.draws, 1, partitions).mapInArrow(run, "draw long, node long, stat double")


def complete_rows(n: int, tested, confounds) -> np.ndarray:
    """Rows whose design has no NaN; infinities are an error. Rows left out give a warning."""
    import warnings

    keep = np.ones(n, bool)
    for name, c in (("tested", tested), ("confounds", confounds)):
        if c is None:
            continue
        c = np.asarray(c, float).reshape(n, -1)
        if np.isinf(c).any():
            raise ValueError(f"{name} holds an infinite value")
        keep &= ~np.isnan(c).any(1)
    if not keep.all():
        warnings.warn(f"{int((~keep).sum())} rows with missing values in the design are left out", stacklevel=2)
    return np.flatnonzero(keep)


def tfce_ols(data, domain: Domain, *, tested=None, confounds=None, params="exact", tail: Tail | str = Tail.TWO_SIDED, seed: int = 0, n_perm: int = 10_000, num_partitions: int | None = None, extend: NullState | None = None, spark: SparkSession | None = None) -> TfceInference:
    """Inference on the effect of a tested column (or, without one, on the mean by sign flips).

    data: an array [row, node], or a DataFrame (subject, node, value). A DataFrame of more than LARGEST bytes stays a table (see nulls.inference, which
    can also continue a stored null and gives its result as a table); here its maxima and p-values are collected.
    """
    settings = resolve_params(params, INFERENCE)
    tail = tail if isinstance(tail, Tail) else Tail(tail)
    if not (isinstance(seed, int) and 0 <= seed < 1 << 64) or not (isinstance(n_perm, int) and n_perm >= 1) or (num_partitions is not None and num_partitions < 1):
        raise InvalidParams("seed, n_perm and num_partitions must be whole numbers in range")
    if isinstance(data, DataFrame):
        spark = data.sparkSession
        if data.select("subject").distinct().count() * domain.n * 8 > LARGEST:
            if extend is not None:
                raise InvalidParams("a null of tables is continued by nulls.inference and its path")
            return _by_tables(data, domain, tested, confounds, PermOpts(settings, tail, seed, n_perm))
        data = matrix_of(data, domain.n)
    data = np.asarray(data, float)
    rows = complete_rows(len(data), tested, confounds)
    pick = lambda c: None if c is None else np.asarray(c, float)[rows]
    problem = PermProblem(domain, data[rows], pick(tested), pick(confounds), PermOpts(settings, tail, seed, n_perm), extend)
    spark = spark or SparkSession.getActiveSession()
    found = run_draws(spark, problem, num_partitions or spark.sparkContext.defaultParallelism) if spark is not None else problem.run(range(problem.first, problem.draws))
    return problem.finalize(*found)


def _by_tables(df: DataFrame, domain: Domain, tested, confounds, opts: PermOpts) -> TfceInference:
    """The result of tfce_ols from tables: a number for each node and draw."""
    from quillon.operators import nulls

    found, null = nulls.inference(df, domain, tested=tested, confounds=confounds, params=opts.params, tail=opts.tail, seed=opts.seed, n_perm=opts.n_perm)
    by_node = found.join(null.exceed(), "node").orderBy("node").toArrow()
    column = lambda c: by_node.column(c).to_numpy()
    maxima = null.maxima().orderBy("max").toArrow().column("max").to_numpy()
    of = json.loads(null.settings)
    return TfceInference(column("stat"), column("p_fwe"), column("p_unc"), NullState(opts.seed, maxima, column("exceed"), column("tfce"), opts.params, opts.tail, of["n"], of["q"]))


def matrix_of(df: DataFrame, n_nodes: int) -> np.ndarray:
    """[subject, node] of long rows (subject, node, value); subjects in order. Refused where it would pass LARGEST bytes."""
    n = df.select("subject").distinct().count()
    if n * n_nodes * 8 > LARGEST:
        raise NeuroError("too large for one matrix; use node-wise statistics (node_stats) instead")
    got = df.select("subject", F.col("node").cast("long").alias("node"), F.col("value").cast("double").alias("value")).toArrow()
    subjects, at = np.unique(got.column("subject").to_numpy(), return_inverse=True)
    out = np.full((len(subjects), n_nodes), np.nan)
    out[at, got.column("node").to_numpy()] = got.column("value").to_numpy()
    return out


def node_stats(df: DataFrame, tested: np.ndarray | None, confounds: np.ndarray | None) -> DataFrame:
    """(node, stat) of long rows (subject, node, value), subjects numbered from 0: the t statistic of each node, for any number of nodes.

    The design is small and goes to all tasks; each node's rows (one for each subject) meet in one group.
    """
    n = len(tested) if tested is not None else int(df.agg(F.max("subject")).first()[0]) + 1
    lone = Domain(1, np.zeros(0, np.int64), np.zeros(0, np.int64))
    base = PermProblem(lone, np.arange(n, dtype=float)[:, None] ** 2, tested, confounds, PermOpts(resolve_params("exact"), Tail.TWO_SIDED, 0, 1))
    shared = df.sparkSession.sparkContext.broadcast((base.design.columns, base.dof))

    def run(t: pa.Table) -> pa.Table:
        design, dof = shared.value
        y = np.full(len(design), np.nan)
        y[t.column("subject").to_numpy()] = t.column("value").to_numpy()
        r = _residual(y, design[:, 1:])
        size = np.linalg.norm(r)
        b = float(design[:, 0] @ r / size) if size > SPAN * np.linalg.norm(y) else 0.0
        rss = 1 - b * b
        stat = 0.0 if rss <= 4 * np.finfo(float).eps * dof else b * (dof / rss) ** 0.5
        return pa.table({"node": t.column("node").slice(0, 1), "stat": pa.array([stat])})

    ready = df.select(F.col("subject").cast("long").alias("subject"), F.col("node").cast("long").alias("node"), F.col("value").cast("double").alias("value"))
    return ready.groupBy("node").applyInArrow(run, "node long, stat double")
