"""Name locale: training rows by script, and a classifier on character n-grams with Spark's own pipeline."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..scratch import Scratch

ORDERS = (1, 2, 3)
#: Not names.
PLACEHOLDERS = ("unknown", "n/a", "nn", "unnamed", "неизвестно", "неизвестный")


def is_training_name(name):
    return F.coalesce((F.length(name) >= 2) & name.rlike(r"\p{L}") & ~F.lower(name).isin(*PLACEHOLDERS), F.lit(False))


def training_rows(persons: DataFrame) -> DataFrame:
    """name, name_type, gender and locale of persons (first, last, gender), each distinct row once."""
    rows = persons.select("gender", F.explode(F.array(F.struct(F.col("first").alias("name"), F.lit("first").alias("name_type")), F.struct(F.col("last").alias("name"), F.lit("last").alias("name_type")))).alias("e")).select("e.*", "gender")
    locale = F.when(names.is_ukrainian(F.col("name")), "uk").when(F.col("name").rlike(names.SCRIPTS["Cyrillic"]), "ru").when(F.col("name").rlike(names.SCRIPTS["Hebrew"]), "he").otherwise(names.latin_language(F.col("name")))
    return rows.where(is_training_name(F.col("name"))).withColumn("locale", locale).distinct()


def featurizers(buckets: int = 1 << 13) -> list:
    """Stages that learn nothing: grams, counts of a name's runs of characters. Single characters need fewer buckets than longer runs; an iteration's time grows with their number."""
    stages = [SQLTransformer(statement="SELECT *, lower(name) AS low FROM __THIS__"), RegexTokenizer(inputCol="low", outputCol="chars", pattern=".", gaps=False)]
    for n in ORDERS:
        stages += [NGram(n=n, inputCol="chars", outputCol=f"grams{n}"), HashingTF(numFeatures=min(buckets, 1 << (5 + 4 * n)), inputCol=f"grams{n}", outputCol=f"tf{n}")]
    return [*stages, VectorAssembler(inputCols=[f"tf{n}" for n in ORDERS], outputCol="grams")]


def learners() -> list:
    """Stages that learn from grams, name_type, gender and locale. A sum has no metadata: the index's place for unknown locales would else be one more class, whose first gradient depends on how rows are dealt."""
    return [
        StringIndexer(inputCols=["name_type", "gender"], outputCols=["type_index", "gender_index"], handleInvalid="keep"),
        StringIndexer(inputCol="locale", outputCol="locale_index", handleInvalid="keep"),
        SQLTransformer(statement="SELECT *, locale_index + 0.0D AS label FROM __THIS__"),
        VectorAssembler(inputCols=["grams", "type_index", "gender_index"], outputCol="features"),
        LogisticRegression(maxIter=30, regParam=0.001, tol=1e-4, family="multinomial"),
    ]


def train(rows: DataFrame, buckets: int = 1 << 13) -> PipelineModel:
    """rows: name, name_type, gender, locale."""
    return Pipeline(stages=[*featurizers(buckets), *learners()]).fit(rows)


def labels_of(model: PipelineModel) -> list[str]:
    """Locales in the model's own order."""
    return list(next(s for s in model.stages if isinstance(s, StringIndexerModel) and s.isSet("outputCol")).labels)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with predicted, confidence and scores (a map of every locale's probability); label names come from the indexer, in the model's own order."""
    labels = labels_of(model)
    blank = rows if "locale" in rows.columns else rows.withColumn("locale", F.lit(labels[0]))
    scored = model.transform(blank)
    at, all_ = F.col("prediction").cast("int"), vector_to_array("probability")
    names_ = F.array(*[F.lit(x) for x in labels])
    scores = F.map_from_arrays(names_, F.slice(all_, 1, len(labels)))
    return scored.select(*rows.columns, F.get(names_, at).alias("predicted"), F.get(all_, at).alias("confidence"), scores.alias("scores"))


def with_folds(rows: DataFrame, folds: int = 5) -> DataFrame:
    """Each row's fold, from its name, kind and gender alone: equal rows share a fold, reruns agree."""
    return rows.withColumn("fold", F.pmod(F.xxhash64("name", "name_type", "gender"), F.lit(folds)).cast("int"))


def metrics(predicted: DataFrame, *by: str) -> DataFrame:
    """n, micro_accuracy (share of right rows), macro_accuracy (mean over locales of each one's share) and log_loss of predict()'s rows, by those columns.

    A locale that the model doesn't know has probability 0, which counts as 1e-15.
    """
    sure = F.greatest(F.coalesce(F.try_element_at("scores", F.col("locale")), F.lit(0.0)), F.lit(1e-15))
    right = F.coalesce(F.col("predicted") == F.col("locale"), F.lit(False)).cast("double")
    each = predicted.groupBy(*by, "locale").agg(F.count("*").alias("n"), F.sum(right).alias("right"), F.sum(-F.log(sure)).alias("loss"))
    return each.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("micro_accuracy"), F.avg(F.col("right") / F.col("n")).alias("macro_accuracy"), (F.sum("loss") / F.sum("n")).alias("log_loss"))


def cross_validate(rows: DataFrame, folds: int = 5, scratch: Scratch | None = None, buckets: int = 1 << 13, at_once: int = 3) -> DataFrame:
    """fold and its metrics(), each fold predicted by a model trained on all others; the mean over folds is the estimate.

    Features are made and written once, as every model reads them, in as many files as keep all cores busy: millions of names are a table so small that Spark would train on it in one task.
    An iteration waits for the driver longer than for its tasks, so some models are trained at once; each of them holds its rows in the executors' memory.
    """
    spark = rows.sparkSession
    dealt = with_folds(rows, folds).repartition(2 * spark.sparkContext.defaultParallelism, "name", "name_type", "gender")
    made = PipelineModel(stages=featurizers(buckets)).transform(dealt).select("fold", "name_type", "gender", "locale", "grams")
    made = (scratch or Scratch(spark, "locale-folds")).keep(made, "rows")
    fit = inheritable_thread_target(spark)(lambda fold: Pipeline(stages=learners()).fit(made.where(F.col("fold") != fold)))
    with ThreadPoolExecutor(at_once) as pool:
        models = list(pool.map(fit, range(folds)))
    return reduce(DataFrame.unionByName, [metrics(predict(model, made.where(F.col("fold") == fold)), "fold") for fold, model in enumerate(models)])


def save(model: PipelineModel, path: str) -> None:
    """The pipeline with its list of locales, in shared storage."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
