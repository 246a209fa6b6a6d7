"""Training set, linear classifier, evaluation, mistakes and human corrections."""

from __future__ import annotations

import json
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.operators import evaluation, features
from exposight.operators.labels import label_at
from exposight.operators.rows import latest_per_key
from exposight.operators.split import stratified_split
from exposight.plans.mail import email_text
from exposight.session import materialise


def training_label() -> Column:
    """The human label where verified, else the machine label."""
    verified = F.coalesce(F.col("human_verified"), F.lit(False))
    return F.when(verified, F.col("human_label")).otherwise(F.col("label"))


def training_set(stored: DataFrame, filter_on: str = "label") -> DataFrame:
    """Stored rows with their ``training_label``, undecided ones left out.

    By default the machine label decides what is left out, so a corrected but
    ambiguous mail stays out; ``filter_on="training_label"`` keeps it.
    """
    if filter_on not in ("label", "training_label"):
        raise ValueError(f"unknown filter column: {filter_on}")
    labelled = stored.withColumn("training_label", training_label())
    return labelled.where(~F.col(filter_on).isin(fv.UNDECIDED_LABELS))


def training_rows_by_id(stored: DataFrame, ids: DataFrame, id_column: str = "email_id") -> DataFrame:
    """Stored rows of the asked ids, none filtered out, with their ``training_label``."""
    wanted = ids.select(F.col(id_column).alias("id"))
    return stored.join(wanted, "id", "left_semi").withColumn("training_label", training_label())


def training_row(stored: DataFrame, mail_id: int) -> DataFrame:
    return stored.where(F.col("id") == mail_id).withColumn("training_label", training_label())


def chosen_corrections(corrections: DataFrame, labels: list[str] = fv.LABELS) -> DataFrame:
    """``email_id, corrected_label``: latest valid choice per mail; numbers out of range are no choice."""
    named = corrections.withColumn("corrected_label", label_at(F.col("label_index"), labels))
    valid = named.where(F.col("corrected_label").isNotNull())
    return latest_per_key(valid, "email_id", "corrected_label", ["ts", "event_id"]).select("email_id", "corrected_label")


def apply_corrections(stored: DataFrame, corrections: DataFrame) -> DataFrame:
    """Stored rows with corrected labels set as verified human labels."""
    chosen = chosen_corrections(corrections).withColumnRenamed("email_id", "id")
    joined = stored.join(chosen, "id", "left")
    fixed = F.col("corrected_label").isNotNull()
    return joined.withColumns(
        {
            "human_label": F.coalesce("corrected_label", "human_label"),
            "human_verified": F.when(fixed, True).otherwise(F.col("human_verified")),
        }
    ).drop("corrected_label")


@dataclass
class MailClassifier:
    """TF-IDF features and one linear machine per label; the largest margin wins."""

    labels: list[str]
    text_model: PipelineModel
    machines: list[LinearSVCModel]

    @classmethod
    def fit(
        cls, train: DataFrame, text: str = "email_text", label: str = "training_label",
        penalty: float = fv.SVM_PENALTY, max_iter: int = fv.SVM_ITERATIONS,
    ) -> "MailClassifier":
        """Rows of class c weigh ``n / (k * n_c)`` in the machine that separates c from the rest.

        ``penalty`` is the factor C of the summed loss; the fitted objective averages the loss over the rows'
        weights, so its regularisation is one over C times their sum.
        """
        sizes = {r["label"]: r["n"] for r in train.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()}
        weights = {r["label"]: r["weight"] for r in evaluation.class_weights(train, label).collect()}
        labels = sorted(weights)
        text_model = features.tfidf_model(train, text)
        # Each fit passes over the vectors many times: write them once.
        vectors = materialise(text_model.transform(train.select(text, label)).select("features", label), "svm-vectors")

        def machine(name: str) -> LinearSVCModel:
            own = F.col(label) == name
            total = sizes[name] * weights[name] + sum(n for other, n in sizes.items() if other != name)
            rows = vectors.select(
                "features",
                own.cast("double").alias("target"),
                F.when(own, weights[name]).otherwise(1.0).alias("weight"),
            )
            svc = LinearSVC(
                featuresCol="features", labelCol="target", weightCol="weight", maxIter=max_iter,
                regParam=1 / (penalty * total), tol=1e-4, standardization=False,
            )
            return svc.fit(rows)

        # A fit is a long row of short jobs that leave most cores idle; fits of several labels run side by side.
        with ThreadPool(max(1, min(fv.SVM_FITS_AT_ONCE, len(labels)))) as pool:
            machines = pool.map(inheritable_thread_target(train.sparkSession)(machine), labels, chunksize=1)
        return cls(labels, text_model, machines)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``predicted``; ties go to the first label."""
        kept = rows.columns
        scored = self.text_model.transform(rows)
        margins = []
        for number, machine in enumerate(self.machines):
            machine = machine.copy()
            machine.setRawPredictionCol(f"_raw{number}").setPredictionCol(f"_own{number}")
            scored = machine.transform(scored)
            margins.append(vector_to_array(f"_raw{number}")[1])
        margin = F.array(*margins)
        best = (F.array_position(margin, F.array_max(margin)) - 1).cast("int")
        return scored.select(*kept, label_at(best, self.labels).alias("predicted"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.text_model.write().overwrite().save(f"{path}/text")
        for number, machine in enumerate(self.machines):
            machine.write().overwrite().save(f"{path}/machine-{number}")
        # Written last: a folder with this file is a complete model.
        spark.createDataFrame([(json.dumps(self.labels),)], "labels string").write.mode("overwrite").json(f"{path}/labels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "MailClassifier | None":
        """The saved model, ``None`` when there is none."""
        try:
            row = spark.read.schema("labels string").json(f"{path}/labels").first()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        labels = json.loads(row["labels"])
        machines = [LinearSVCModel.load(f"{path}/machine-{n}") for n in range(len(labels))]
        return cls(labels, PipelineModel.load(f"{path}/text"), machines)


def with_email_text(rows: DataFrame) -> DataFrame:
    """Rows whose text exists; a null part leaves nothing to learn from."""
    return rows.withColumn("email_text", email_text()).where(F.col("email_text").isNotNull())


def training_loop(
    stored: DataFrame, seed: int = fv.SPLIT_SEED, max_iter: int = fv.SVM_ITERATIONS
) -> tuple[MailClassifier, DataFrame, DataFrame, DataFrame]:
    """Read, split, fit, predict held-out rows: model, predictions, report, mistakes."""
    rows = with_email_text(training_set(stored)).select("id", "sender_email_domain", "email_text", "training_label")
    split = materialise(stratified_split(rows, "id", "training_label", seed), "training-split")
    model = MailClassifier.fit(split.where(~F.col("is_test")), max_iter=max_iter)
    predictions = model.predict(split.where("is_test")).select(
        F.col("id").alias("email_id"), F.col("training_label").alias("actual"), "predicted"
    )
    predictions = materialise(predictions, "predictions")
    report = evaluation.classification_report(predictions)
    return model, predictions, report, evaluation.mistakes(predictions, stored)


def report_rows(report: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Report as it is kept in the history: two decimals, half to even, and the time of the run."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss") if stamp is None else stamp
    metrics = ["precision", "recall", "f1_score"]
    return report.select("label", *[F.bround(m, 2).alias(m) for m in metrics], F.col("support").cast("double").alias("support"), stamp.alias("timestamp"))
