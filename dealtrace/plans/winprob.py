"""Win probability of open deals: a random forest over account features.

A fitted model is stored as tables: the trees' nodes, a score for each deal and,
on demand, scores of closed deals by forests that have not seen them.  Reports
read those tables; nothing is fitted twice for them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scalars as S
from ..operators.lookup import lookup_join
from ..sources.scratch import keep
from .forest import SALT, Forest, fit_forest, fit_forests, load_forest, with_chance

# Columns of the model, named so that no deal column is in their way.
CODE = "_win_code"
CHANCE = "_win_chance"
FOLD = "_win_fold"
# Stored scores are whole numbers of this part, so that a histogram of them has a bound.
SCORE_STEPS = 1_000_000
FEATURES = [*V.WIN_CATEGORICAL, *V.WIN_BOOLEAN, *V.WIN_NUMERIC]


@dataclass(frozen=True)
class WinModel:
    encoder: StringIndexerModel | None
    forest: Forest | None
    features: tuple[str, ...]
    categorical: tuple[str, ...]

    def save(self, folder: str) -> str:
        """Write the codes, the forest and the feature names; :func:`load_win_model` reads them."""
        spark = SparkSession.active()
        names = [(list(self.features), list(self.categorical))]
        schema = "features array<string>, categorical array<string>"
        spark.createDataFrame(names, schema).write.mode("overwrite").parquet(f"{folder}/features")
        self.forest.save(spark, f"{folder}/forest")
        if self.encoder is not None:
            self.encoder.write().overwrite().save(f"{folder}/encoder")
        return folder


def load_win_model(spark: SparkSession, folder: str) -> WinModel:
    names = spark.read.parquet(f"{folder}/features").first()
    encoder = StringIndexerModel.load(f"{folder}/encoder") if names.categorical else None
    forest = load_forest(spark, f"{folder}/forest", len(names.features))
    return WinModel(encoder, forest, tuple(names.features), tuple(names.categorical))


def win_features(opps: DataFrame, master: DataFrame, wanted: Sequence[str] = FEATURES) -> DataFrame:
    """Deals with the account columns they lack, and the closed-deal label."""
    lacking = [c for c in wanted if c not in opps.columns and c in master.columns]
    joined = opps.join(master.select("account_id", *lacking), "account_id", "left")
    return joined.withColumns(
        {"is_closed_deal": S.is_closed_stage("stage"), "label": S.is_true("is_won").cast("double")}
    )


def _prepared(deals: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    return deals.withColumns(
        {
            **{c + CODE: S.or_unknown(F.col(c).cast("string")) for c in categorical},
            **{c + CODE: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric},
        }
    )


def _encoded(model: WinModel, deals: DataFrame) -> DataFrame:
    """Category texts to codes in alphabetical order.

    A text unseen in training takes the code of Unknown, or else the first one.
    """
    numeric = [f for f in model.features if f not in model.categorical]
    prepared = _prepared(deals, model.categorical, numeric)
    if model.encoder is None:
        return prepared
    indexed = model.encoder.transform(prepared)
    codes = {}
    for name, labels in zip(model.categorical, model.encoder.labelsArray):
        labels = list(labels)
        spare = labels.index(V.UNKNOWN) if V.UNKNOWN in labels else 0
        code = F.col(name + CODE + "_ix")
        codes[name + CODE] = F.when(code < len(labels), code).otherwise(F.lit(float(spare)))
    return indexed.withColumns(codes)


def _encoder(
    deals: DataFrame, categorical: Sequence[str], others: Sequence[str]
) -> tuple[WinModel, DataFrame]:
    """Category codes learned from closed deals, and those deals' features."""
    categorical = tuple(c for c in categorical if c in deals.columns)
    others = tuple(c for c in others if c in deals.columns)
    used = dict.fromkeys([*categorical, *others, "label"])
    # Read several times: written to the shared folder, not kept by executors.
    extra = [c for c in deals.columns if c == FOLD]
    salt = F.xxhash64(*(c for c in ("opp_id", *used) if c in deals.columns)).alias(SALT)
    closed = keep(deals.where("is_closed_deal").select(*used, *extra, salt), "win-features")
    encoder = None
    if categorical:
        encoder = StringIndexer(
            inputCols=[c + CODE for c in categorical],
            outputCols=[c + CODE + "_ix" for c in categorical],
            stringOrderType="alphabetAsc",
            handleInvalid="keep",
        ).fit(_prepared(closed, categorical, others))
    return WinModel(encoder, None, (*categorical, *others), categorical), closed


def _codes(model: WinModel) -> list[str]:
    return [f + CODE for f in model.features]


def _training(model: WinModel, closed: DataFrame) -> DataFrame:
    """Codes and labels of closed deals as a written table, dealt evenly over all cores."""
    extra = [c for c in closed.columns if c == FOLD]
    rows = _encoded(model, closed).select("label", SALT, *extra, *_codes(model))
    cores = closed.sparkSession.sparkContext.defaultParallelism
    return keep(rows.repartition(2 * cores).sortWithinPartitions(*extra) if extra else rows.repartition(2 * cores), "win-training")


def fit_win_model(
    deals: DataFrame,
    categorical: Sequence[str] = V.WIN_CATEGORICAL,
    others: Sequence[str] = (*V.WIN_BOOLEAN, *V.WIN_NUMERIC),
    trees: int = V.WIN_TREES,
    depth: int = V.WIN_DEPTH,
    min_leaf: int = V.WIN_MIN_LEAF,
    seed: int = V.WIN_SEED,
) -> WinModel:
    """Fit on closed deals; features that the frame lacks are left out.

    The driver holds the category names, the trees and a sample of set size that tells
    where bins begin.  Training visits the rows once a level, so they are written first.
    """
    model, closed = _encoder(deals, categorical, others)
    forest = fit_forest(_training(model, closed), _codes(model), trees, depth, min_leaf, seed)
    return WinModel(model.encoder, forest, model.features, model.categorical)


def score(model: WinModel, deals: DataFrame) -> DataFrame:
    """Deals with ``win_probability``, to nine digits whatever the order of the trees, and the 0.5 call."""
    encoded = _encoded(model, deals).select(*deals.columns, *_codes(model))
    scored = with_chance(model.forest, encoded, _codes(model), CHANCE)
    probability = F.round(CHANCE, 9)
    return scored.select(
        *deals.columns,
        probability.alias("win_probability"),
        (probability >= 0.5).alias("predicted_win"),
    )


def ranked(scored: DataFrame, which: str = "open") -> DataFrame:
    """Scored open deals, the likeliest first; closed ones with ``which="closed"``."""
    if which not in ("open", "closed"):
        raise ValueError(f"which must be 'open' or 'closed', not {which!r}")
    shown = ["opp_id", "account_name", "amount", "channel_category", "segment", "win_probability", "is_won"]
    chosen = F.col("is_closed_deal") if which == "closed" else ~F.col("is_closed_deal")
    return scored.where(chosen).select(*shown).orderBy(F.desc("win_probability"), "opp_id")


def score_open(model: WinModel, deals: DataFrame, which: str = "open") -> DataFrame:
    """Scores of open deals, the likeliest first; of closed ones with ``which="closed"``."""
    return ranked(score(model, deals), which)


def model_inputs(deals: DataFrame, categorical: Sequence[str], others: Sequence[str]) -> DataFrame:
    """What the forest gets: category codes and filled numbers, under the features' own names."""
    model, _ = _encoder(deals, categorical, others)
    encoded = _encoded(model, deals)
    return encoded.select("opp_id", *(F.col(f + CODE).alias(f) for f in model.features))


def stratified_folds(deals: DataFrame, folds: int = V.WIN_FOLDS, buckets: int = 1000) -> DataFrame:
    """Closed deals with a fold in which both labels have their share of all deals.

    Deals are dealt by a hash of their id into buckets; per label the buckets
    are counted and cut into equal stretches.  Nothing but the counts is ordered.
    """
    digest = F.md5(F.col("opp_id").cast("string").cast("binary"))
    bucket = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % buckets
    marked = deals.where("is_closed_deal").withColumn("_bucket", bucket)
    counts = marked.groupBy("label", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    label = Window.partitionBy("label")
    before = F.sum("n").over(label.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    fold = F.floor(F.coalesce(before, F.lit(0)) * folds / F.sum("n").over(label)).cast("int")
    cell = F.concat_ws("/", F.col("label").cast("string"), F.col("_bucket").cast("string"))
    cut = counts.select(cell.alias("_cell"), fold.alias(FOLD))
    return lookup_join(marked.withColumn("_cell", cell), cut, "_cell", "inner").drop("_cell", "_bucket")


def accuracy(scored: DataFrame) -> DataFrame:
    """Share of scored closed deals whose call is right, and how many there are."""
    right = (F.col("predicted_win").cast("double") == F.col("label")).cast("double")
    return scored.where("is_closed_deal").agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("deals"))


def training_accuracy(model: WinModel, deals: DataFrame) -> DataFrame:
    return accuracy(score(model, deals))


def feature_importance(model: WinModel, deals: DataFrame) -> DataFrame:
    """Feature and importance, largest first (as many rows as features)."""
    spark = deals.sparkSession
    importances = model.forest.importances()
    rows = [(name, float(v)) for name, v in zip(model.features, importances)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def forest_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per node of the forest that :meth:`WinModel.save` wrote to ``folder``.

    tree, node (0 is the root), place and name of the feature tested, threshold (values up
    to it go left), left, right, gain, n and won (training deals that reached it, as often
    as the tree drew them).  A leaf has no feature, threshold, children or gain.
    """
    features = spark.read.parquet(f"{folder}/features").select("features")
    nodes = spark.read.parquet(f"{folder}/forest")
    names = features.select(F.posexplode("features").alias("place", "feature"))
    return nodes.join(names, "place", "left")


def node_importance(nodes: DataFrame) -> DataFrame:
    """Feature and importance from the node table: what its splits gained, as shares of each tree, over all trees.

    Equal to :func:`feature_importance` for the features that some node tests.
    """
    gained = nodes.where("feature IS NOT NULL").groupBy("tree", "feature")
    gained = gained.agg(F.sum(F.col("gain") * F.col("n")).alias("gained"))
    # At most a row for each tree and feature; then a row for each feature.
    of_tree = F.sum("gained").over(Window.partitionBy("tree"))
    shares = gained.withColumn("of_tree", of_tree).where("of_tree > 0").groupBy("feature")
    shares = shares.agg(F.sum(F.col("gained") / F.col("of_tree")).alias("share"))
    trees = F.sum("share").over(Window.partitionBy())
    return shares.select("feature", (F.col("share") / trees).alias("importance")).orderBy(F.desc("importance"), "feature")


def store_win_model(deals: DataFrame, root: str, key: str, **fit) -> str:
    """Fit on the closed deals, and store the model and its tables in a folder of its own under ``root``.

    ``features``, ``forest``, ``encoder`` are the model; ``nodes`` its trees; ``deals`` what it was
    fitted to and scores; ``scores`` all deals with their chances; ``ready``, written last, has ``key`` (what the deals are) and the version.
    Versions sort by the time of their fit.  ``fit`` goes to :func:`fit_win_model`.
    """
    spark = deals.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = f"{root}/{version}"
    shown = ["opp_id", "account_name", "amount", "channel_category", "segment", "is_won", "is_closed_deal", "label"]
    wanted = [*shown, *fit.get("categorical", V.WIN_CATEGORICAL), *fit.get("others", [*V.WIN_BOOLEAN, *V.WIN_NUMERIC])]
    # Fitted to and scored: what makes the deals is done once.
    deals = deals.select(*(c for c in dict.fromkeys(wanted) if c in deals.columns))
    deals.write.parquet(f"{folder}/deals")
    deals = spark.read.schema(deals.schema).parquet(f"{folder}/deals")
    model = fit_win_model(deals, **fit)
    model.save(folder)
    mark = {"key": F.lit(key), "version": F.lit(version)}
    forest_nodes(spark, folder).withColumns(mark).coalesce(1).write.parquet(f"{folder}/nodes")
    scored = score(model, deals).select(*shown, "win_probability", "predicted_win")
    scored.withColumns(mark).write.parquet(f"{folder}/scores")
    spark.range(1).select(F.lit(key).alias("key"), F.lit(version).alias("version")).write.parquet(f"{folder}/ready")
    return folder


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a stored model, without the columns that mark its version."""
    return spark.read.parquet(f"{folder}/{name}").drop("key", "version")


def out_of_fold_scores(
    deals: DataFrame,
    categorical: Sequence[str] = V.WIN_CATEGORICAL,
    others: Sequence[str] = (*V.WIN_BOOLEAN, *V.WIN_NUMERIC),
    folds: int = V.WIN_FOLDS,
    trees: int = V.WIN_TREES,
    depth: int = V.WIN_DEPTH,
    min_leaf: int = V.WIN_MIN_LEAF,
    seed: int = V.WIN_SEED,
) -> DataFrame:
    """(fold, label, steps): each closed deal by a forest fitted without its fold; ``steps`` of a millionth."""
    model, closed = _encoder(stratified_folds(deals, folds), categorical, others)
    rows, codes = _training(model, closed), _codes(model)
    # All forests grow together, and all deals are scored at once.
    forests = fit_forests(rows, codes, trees, depth, min_leaf, seed, list(range(folds)), FOLD)
    parts = [with_chance(f, rows.where(F.col(FOLD) == fold), codes, CHANCE) for fold, f in enumerate(forests)]
    chance = F.round(F.col(CHANCE) * SCORE_STEPS).cast("bigint")
    scored = reduce(DataFrame.unionByName, parts).select(F.col(FOLD).alias("fold"), "label", chance.alias("steps"))
    return keep(scored, "win-fold")


def fold_auc(scores: DataFrame) -> DataFrame:
    """(fold, auc): the exact area under the ROC curve of stored scores; null for a fold with one label only.

    The chance that a won deal scores above a lost one, ties counting half.  Deals are
    counted by score first, so each fold orders at most as many rows as there are steps.
    """
    won = F.col("label") == 1
    counts = scores.groupBy("fold", "steps").agg(F.count_if(won).alias("won"), F.count_if(~won).alias("lost"))
    below = Window.partitionBy("fold").orderBy("steps").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("lost").over(below), F.lit(0)) + F.col("lost") / 2
    pairs = counts.withColumn("pairs", F.col("won") * ahead).groupBy("fold")
    sums = pairs.agg(F.sum("pairs").alias("p"), F.sum("won").alias("w"), F.sum("lost").alias("l"))
    return sums.select("fold", F.try_divide("p", F.col("w") * F.col("l")).alias("auc"))


def auc_summary(scores: DataFrame) -> DataFrame:
    """Mean and standard deviation (of all folds, not of a sample) of the folds' areas."""
    return fold_auc(scores).agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("deviation"))


def cross_validated_auc(deals: DataFrame, **fit) -> tuple[float, float]:
    """Mean and standard deviation of the exact area under the ROC curve over the stratified folds."""
    return tuple(auc_summary(out_of_fold_scores(deals, **fit)).first())


def win_histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    """Deals per equal-width probability bin; 1.0 falls in the last one."""
    bin_no = F.least(F.floor(F.col("win_probability") * bins), F.lit(bins - 1)).cast("bigint")
    return scored.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("deals"))
