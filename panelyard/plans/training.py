"""Walk-forward training of many targets over one stored panel.

Every target and fold is one fit.  Rows get their folds by one join on (target, date); a bounded sample of each fold's training rows goes to
that fit's task, and all fits run side by side as the groups of one job.  Test rows are scored where they lie, all of them.  The last stretch of a
fold's training dates tells when to stop; the final model of a target gets the median of its folds' best rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from panelyard.operators.boosting import Boosting, fit_groups, score_groups
from panelyard.operators.evaluation import pointwise
from panelyard.operators.folds import FoldSpec, fold_dates, inner_validation, recent_rows
from panelyard.session import stored

FIT_ROWS = 20_000  # rows given to one fit; test rows, priors and counts are whole
GRAINS = 1 << 52
Target = tuple[str, str, int, int]  # name, kind, horizon, classes


@dataclass(frozen=True)
class Study:
    """Out-of-fold rows (target, fold, ticker, date, y, p, prior), the fold models, and what the rows come from."""

    oof: DataFrame
    models: DataFrame
    marked: DataFrame
    features: tuple[str, ...]
    how: Boosting

    def of(self, target: str) -> DataFrame:
        return self.oof.where(F.col("target") == target).drop("target")


def labelled(panel: DataFrame, targets: Sequence[Target], features) -> DataFrame:
    """One row per target that has a label, with at least one feature present: target, k, y, ticker, date and the features."""
    labels = F.array(*[F.struct(F.lit(name).alias("target"), F.lit(k).alias("k"), F.col(f"label_{kind}_{h}d").cast("int").alias("y"))
                       for name, kind, h, k in targets])
    known = F.filter(labels, lambda one: one["y"].isNotNull())
    rows = panel.where(F.coalesce(*[F.col(c) for c in features]).isNotNull())
    return rows.select("ticker", "date", *features, F.explode(known).alias("label")).select("label.*", "ticker", "date", *features)


def study_folds(rows: DataFrame, targets: Sequence[Target], spec: FoldSpec) -> DataFrame:
    """(target, fold, date, role, part): the folds of each target over its own dates, purged by its horizon at least.

    ``part`` splits training dates into ``fit`` and ``valid``; dates between the two, and test dates, have none.
    """
    days = stored(rows.select("target", "date").distinct(), "days")
    out = []
    for name, _, horizon, _ in targets:
        own = days.where(F.col("target") == name)
        folds = fold_dates(own, replace(spec, purge=max(spec.purge, horizon)))
        parts = inner_validation(folds.where("role = 'train'"), spec.test_size, horizon)
        out.append(folds.join(parts, ["fold", "date"], "left").withColumn("target", F.lit(name)))
    return stored(reduce(DataFrame.unionByName, out), "folds")


def drawn(rows: DataFrame, group: list[str], fit_rows: int) -> DataFrame:
    """About ``fit_rows`` rows of every group by a hash of their key: the bound of one fit."""
    shares = rows.groupBy(*group).agg((F.lit(float(fit_rows)) / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64(F.lit("fit"), "ticker", "date"), F.lit(GRAINS)) / F.lit(float(GRAINS))
    return rows.join(F.broadcast(shares), group).where(place < F.col("share")).drop("share")  # one row per fit


def class_shares(train: DataFrame, group: list[str]) -> DataFrame:
    """prior and n_train of every group, from all training rows."""
    shares = F.array(*[F.avg((F.col("y") == c).cast("double")) for c in range(3)])
    return train.groupBy(*group, "k").agg(shares.alias("all"), F.count("*").alias("n_train")).select(
        *group, F.slice("all", 1, F.col("k")).alias("prior"), "n_train")


def walk_forward_all(panel: DataFrame, targets: Sequence[Target], features, spec: FoldSpec, how: Boosting = Boosting(),
                     fit_rows: int = FIT_ROWS) -> Study:
    """Fit every target and fold in one job, and score every test row."""
    if fit_rows < 1:
        raise ValueError("a fit needs at least one row")
    features = tuple(features)
    group = ["target", "fold"]
    rows = labelled(panel, targets, features)
    marked = rows.join(study_folds(rows, targets, spec), ["target", "date"])
    train = marked.where("role = 'train'")
    used = drawn(train.where("part IS NOT NULL"), group, fit_rows).withColumn("held_out", F.col("part") == "valid")
    models = stored(fit_groups(used, group, features, how), "models")
    test = marked.where("role = 'test'").select(*group, "ticker", "date", "y", *features)
    priors = class_shares(train, group)
    oof = score_groups(test, models, group, features).join(F.broadcast(priors), group)  # one row per fit
    return Study(stored(oof.select(*group, "ticker", "date", "y", "p", "prior", "n_train"), "oof"), models, marked, features, how)


def final_models(panel: DataFrame, study: Study, targets: Sequence[Target], fit_rows: int = FIT_ROWS) -> DataFrame:
    """One model per target from all labelled rows, with the median of its folds' best rounds."""
    rounds = study.models.groupBy("target").agg(F.ceil(F.median("best_round")).cast("int").alias("rounds"))
    rows = drawn(labelled(panel, targets, study.features), ["target"], fit_rows).join(F.broadcast(rounds), "target")  # one row per target
    return stored(fit_groups(rows.withColumn("held_out", F.lit(False)), ["target"], study.features, study.how, "rounds"), "final-models")


@dataclass
class Trial:
    """One set of parameters in a race: its skill in each finished fold, and after how many folds it was given up."""

    how: Boosting
    skills: list[float]
    given_up_after: int | None = None

    @property
    def mean(self) -> float:
        return sum(self.skills) / len(self.skills)


def hopeless(trial: Trial, leader: Trial, folds: int, slack: float) -> bool:
    """Whether ``trial`` stays behind ``leader`` even if it gains in every open fold its best gain so far, ``slack`` at least."""
    gains = [a - b for a, b in zip(trial.skills, leader.skills)]
    return sum(gains) + (folds - len(gains)) * max(max(gains), slack) < 0


def tune_race(panel: DataFrame, target: Target, features, spec: FoldSpec, trials: Sequence[Boosting], tail_rows: int, fit_rows: int = FIT_ROWS,
              slack: float = 0.005) -> DataFrame:
    """Trials over the last ``tail_rows`` rows, fold by fold, all open trials of a fold in one job.

    A trial that cannot reach the leader any more is given up.  Returns trial, its parameters, folds_done, mean_skill, given_up_after and place; the
    winner (place 1) has run all folds, and the lower number wins a tie.
    """
    features = list(features)
    rows = recent_rows(labelled(panel, [target], features), tail_rows)
    marked = rows.join(study_folds(rows, [target], spec), ["target", "date"])
    race = [Trial(how, []) for how in trials]
    group = ["trial", "fold"]
    for fold in range(spec.n_splits):
        open_ones = [i for i, t in enumerate(race) if t.given_up_after is None]
        numbers = F.explode(F.array(*[F.lit(i) for i in open_ones]))
        own = marked.where(F.col("fold") == fold)
        used = drawn(own.where("role = 'train' AND part IS NOT NULL"), ["fold"], fit_rows).withColumn("trial", numbers)
        models = stored(fit_groups(used.withColumn("held_out", F.col("part") == "valid"), group, features, list(trials)), "trials")
        test = own.where("role = 'test'").withColumn("trial", numbers).select(*group, "y", *features)
        priors = class_shares(own.where("role = 'train'"), ["fold"]).drop("n_train")
        scored = score_groups(test, models, group, features).join(F.broadcast(priors), "fold")  # one row
        for r in pointwise(scored, ["trial"]).select("trial", "brier_skill").collect():  # one row per trial
            race[r["trial"]].skills.append(r["brier_skill"] if r["brier_skill"] is not None else 0.0)
        leader = max((race[i] for i in open_ones), key=lambda t: t.mean)
        for i in open_ones:
            if fold + 1 < spec.n_splits and race[i] is not leader and hopeless(race[i], leader, spec.n_splits, slack):
                race[i].given_up_after = fold + 1
    order = sorted(range(len(race)), key=lambda i: (race[i].given_up_after is not None, -len(race[i].skills), -race[i].mean, i))
    table = [(i, t.how.rounds, t.how.depth, t.how.rate, t.how.l2, len(t.skills), t.mean, t.given_up_after, order.index(i) + 1) for i, t in enumerate(race)]
    return panel.sparkSession.createDataFrame(
        table, "trial INT, rounds INT, depth INT, rate DOUBLE, l2 DOUBLE, folds_done INT, mean_skill DOUBLE, given_up_after INT, place INT")
