"""Running many selectors and models as cells: several at a time, each within a time limit, each stored by itself, and only those not stored yet.

A cell is a name and a function that returns a table. Its Spark jobs are one job group; when its time is over the group is cancelled, and its later jobs too. Time in which its jobs only wait for cores that others hold does not count. A cell that fails or is late costs no other one: it is a row of the states with its error. Results are folders ``results/<name>``, replaced as a whole, so a repeated run leaves each cell once; a state is written after its result, so a run that dies leaves a cell either done or to be done.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import boosting, discretise, discriminant, evaluation, expression, penalised, perturbation, preparation, search, transforms
from helixmill.sources import stores

STATE = "cell string, state string, error string, seconds double"
DONE, FAILED, LATE = "done", "failed", "late"


def states(spark: SparkSession, path: str) -> DataFrame:
    """(cell, state, error, seconds): done, failed or late, of each cell that was tried."""
    if not stores.exists(spark, f"{path}/states"):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).json(f"{path}/states/*")


def run_cells(spark: SparkSession, cells: dict[str, Callable[[], DataFrame]], path: str, limit: float = 172_800, at_once: int = 4) -> DataFrame:
    """Run the cells that are not done under ``path`` and give all states. ``limit`` is in seconds a cell."""
    done = {r.cell for r in states(spark, path).where(F.col("state") == DONE).select("cell").collect()}  # a row a cell
    left = {name: make for name, make in cells.items() if name not in done}
    with ThreadPoolExecutor(at_once) as pool:
        for future in [pool.submit(_run, spark, name, make, path, limit) for name, make in left.items()]:
            future.result()
    return states(spark, path)


def _run(spark: SparkSession, name: str, make, path: str, limit: float) -> None:
    group, began, late = f"{path}/{name}/{uuid.uuid4().hex}", time.time(), threading.Event()
    context = spark.sparkContext
    context.setJobGroup(group, name, True)  # of this thread alone

    def stop() -> None:
        late.set()
        context._jsc.sc().cancelJobGroupAndFutureJobs(group)

    def watch() -> None:
        left, now = limit, time.time()
        while not over.wait(max(0.01, min(1.0, limit / 8, left))):
            was, now = now, time.time()
            if not _waits(context, group):
                left -= now - was
            if left <= 0:
                return stop()

    over = threading.Event()
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    state, error = DONE, None
    try:
        make().withColumn("cell", F.lit(name)).write.mode("overwrite").parquet(_at(path, "results", name))
    except Exception as e:  # whatever a cell's code raises is that cell's state
        state, error = (LATE, f"over {limit:g} s") if late.is_set() else (FAILED, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300])
    finally:
        over.set()
        watcher.join()
    context.setJobGroup(f"{group}/state", name, False)  # not the cancelled group
    row = spark.createDataFrame([(name, state, error, time.time() - began)], STATE)
    row.coalesce(1).write.mode("overwrite").json(_at(path, "states", name))


def _waits(context, group: str) -> bool:
    """Has the group stages to run, and no task that runs?"""
    tracker = context.statusTracker()
    jobs = set(tracker.getActiveJobsIds()) & set(tracker.getJobIdsForGroup(group))
    wanted = {s for j in jobs if (job := tracker.getJobInfo(j)) for s in job.stageIds} & set(tracker.getActiveStageIds())
    stages = [x for x in map(tracker.getStageInfo, wanted) if x]
    return bool(stages) and not any(x.numActiveTasks for x in stages)


def _at(path: str, kind: str, name: str) -> str:
    return f"{path}/{kind}/{quote(name, safe='').replace('%', '~')}"


def results(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all cells that are done, with their cell; None if there are none."""
    done = [r.cell for r in states(spark, path).where(F.col("state") == DONE).select("cell").collect()]
    if not done:
        return None
    return spark.read.parquet(*[_at(path, "results", c) for c in sorted(done)])


# selectors as cells


class Inputs:
    """What selectors start from, each worked out once, at the first need, and stored under ``path``: the training table, its significant features alone, and either balanced by SMOTE."""

    def __init__(self, train: DataFrame, path: str):
        self.train, self.path, self.lock = train, path, threading.Lock()

    def of(self, name: str, make) -> DataFrame:
        with self.lock:  # one selector prepares, the others wait
            return stores.scan_or_compute(self.train.sparkSession, f"{self.path}/inputs/{name}", make)

    def differential(self) -> DataFrame:
        return self.of("differential", lambda: expression.differential_expression(self.train))

    def significant(self) -> DataFrame:
        found = self.differential()
        return self.of("significant", lambda: preparation.whitelisted(self.train, expression.significant(found, "p_bh")))

    def balanced(self, long: DataFrame, name: str) -> DataFrame:
        def make():
            new = transforms.smote(long).select(F.concat_ws("-", "sample_id", "draw").alias("sample_id"), "class", "feature", "value")
            return long.select(F.col("sample_id").cast("string").alias("sample_id"), "class", "feature", "value").unionByName(new)

        return self.of(name, make)

    def variant(self, suffix: str) -> DataFrame:
        """"" the table, "SMOTE" balanced, "_sig" significant features, "SMOTE_sig" both."""
        long = self.significant() if suffix.endswith("_sig") else self.train
        return self.balanced(long, f"balanced{suffix[5:]}") if suffix.startswith("SMOTE") else long


VARIANTS = ("", "SMOTE", "_sig", "SMOTE_sig")


def _ordered(df: DataFrame, key) -> DataFrame:
    return preparation.top_features(df.withColumn("_s", key), "_s", 2**31 - 1).select("rank", "feature")


def selectors(k: int = 11) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Selectors by name: from a long table to (rank, feature). Folds are by a hash of the sample."""
    fold = F.pmod(F.xxhash64(F.col("sample_id").cast("string")), F.lit(10)).cast("int")
    top = lambda df, c: _ordered(df, F.round(c, 12)).where(F.col("rank") <= k)
    return {
        "all": lambda long: preparation.all_features(long).select("rank", "feature"),
        "cfs": lambda long: _ordered(discretise.best_first_cfs(long), F.col("su")),
        "fcfs": lambda long: discretise.forward_cfs_mdl(long).select("rank", "feature"),
        "CorrSF_MDL": lambda long: discretise.forward_cfs_mdl(long, k).select("rank", "feature"),
        "AUC_MDL": lambda long: discretise.auc_mdl(long, k).select("rank", "feature"),
        "SU_MDL": lambda long: top(discretise.su_mdl(long), "su"),
        "AUC": lambda long: top(evaluation.auc(long.select("feature", F.col("value").alias("score"), (F.col("class") == expression.CASE).cast("int").alias("label"))), "auc"),
        "bounce": lambda long: boosting.stability(long).select("rank", "feature"),
        "stepLDA": lambda long: _ordered(discriminant.step_lda(long).groupBy("feature").agg(F.max_by("action", "step").alias("a"), F.max("step").alias("s")).where("a = 'in'"), -F.col("s")),
        "GeneticAlgorithm": lambda long: search.genetic(long, fold % 5, 5).features(long.sparkSession),
        "SimulatedAnnealing": lambda long: search.annealing(long, fold % 5, 5).features(long.sparkSession),
        "SPSA": lambda long: perturbation.ranked(long, k).select("rank", "feature"),
        "LASSO": lambda long: penalised.cv_lasso(long, fold, 10, n_penalties=30, least=1e-2).select("rank", "feature"),
        "ElasticNet": lambda long: penalised.elastic_net(long, fold, 10, n_penalties=20, least=1e-2).select("rank", "feature"),
    }


def select(train: DataFrame, path: str, wanted: list[str] | None = None, k: int = 11, limit: float = 172_800, at_once: int = 3) -> DataFrame:
    """Run selectors as cells under ``path``: ``wanted`` names like cfs, cfsSMOTE, cfs_sig or cfsSMOTE_sig (None: every selector on every variant of its input). Gives the states; ``selected`` gives the features."""
    known, inputs = selectors(k), Inputs(train, path)
    every = {f"{name}{v}": (f, v) for name, f in known.items() for v in VARIANTS}
    if unknown := sorted(set(wanted or ()) - set(every)):
        raise ValueError(f"no such selector: {unknown}")
    cells = {name: (lambda f=f, v=v: f(inputs.variant(v))) for name, (f, v) in every.items() if wanted is None or name in wanted}
    return run_cells(train.sparkSession, cells, path, limit, at_once)


def selected(spark: SparkSession, path: str) -> DataFrame | None:
    """(method, rank, feature) of the selectors that are done."""
    found = results(spark, path)
    return None if found is None else found.select(F.col("cell").alias("method"), F.col("rank").cast("int").alias("rank"), "feature")
