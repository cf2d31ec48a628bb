"""Model slots: fallback to the keyword scorer, MLlib classifiers standing in
for the two trained models, and a pluggable Arrow-batched scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.functions import scoring as S
from moodframe.functions.text import trim_ws
from moodframe.operators import features as FE
from moodframe.operators.partitioning import materialised
from moodframe.operators.predict import predict_keyword


def with_fallback(keyword_pred: DataFrame, model_probs: DataFrame, key: str, slot_name: str) -> DataFrame:
    """Row-level fallback: where the model gave no usable probabilities (no
    row, NULL, wrong values) use the keyword prediction, named
    '<slot> Fallback'; otherwise the model's argmax, named '<slot>'.

    ``model_probs`` is keyed by ``key`` with a ``probs`` array column.
    """
    mp = model_probs.select(key, S.prob_repair("probs").alias("_p"))
    j = keyword_pred.join(mp, key, "left")
    usable = F.col("_p").isNotNull() & F.forall("_p", lambda x: ~F.isnan(x) & (x >= 0.0))
    return j.select(
        "*",
        F.when(usable, S.argmax_from_probs("_p")).otherwise(F.col("emotion")).alias("_emotion"),
        F.when(usable, F.array_max("_p")).otherwise(F.col("confidence")).alias("_confidence"),
        F.when(usable, F.lit(slot_name)).otherwise(F.lit(f"{slot_name} Fallback")).alias("_model"),
        F.when(usable, F.col("_p")).otherwise(S.probs_from_tenths()).alias("probs"),
    ).drop("emotion", "confidence", "model", "_p").withColumnRenamed("_emotion", "emotion").withColumnRenamed(
        "_confidence", "confidence"
    ).withColumnRenamed("_model", "model")


# ---------------------------------------------------------------------------
# MLlib text classifiers in the two model slots
# ---------------------------------------------------------------------------

from pyspark.ml import Pipeline, PipelineModel  # noqa: E402
from pyspark.ml.classification import LogisticRegression  # noqa: E402
from pyspark.ml.evaluation import MulticlassClassificationEvaluator  # noqa: E402
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer, VectorAssembler  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit  # noqa: E402

from moodframe.functions.constants import EMOTIONS, MAX_SEQ_LEN, MODEL_A  # noqa: E402
from moodframe.operators import epochs as E  # noqa: E402


def _tokenizer(text_col: str, max_len: int) -> SQLTransformer:
    """``_tokens``: the first ``max_len`` words.  A text is split as far as they
    go; its beginning may be an empty word, its rest is the last part."""
    words = f"filter(split(`{text_col}`, '\\\\s+', {max_len + 2}), w -> w <> '')"
    return SQLTransformer(statement=f"SELECT *, slice({words}, 1, {max_len}) AS _tokens FROM __THIS__")


def as_ids(df: DataFrame, vocab: DataFrame, text_col: str = "clean_text", max_len: int = MAX_SEQ_LEN) -> DataFrame:
    """``df`` plus ``ids``: slot B's input, the text's first ``max_len`` word
    numbers, padded; words outside the encoder's vocabulary have the OOV number."""
    tokens = F.slice(F.coalesce(FE.tokenize(text_col), F.array().cast("array<string>")), 1, max_len)
    return df.withColumn("ids", FE.pad(FE.encoder(vocab)(tokens), max_len))


def fit_model_b(train: DataFrame, validation: DataFrame, classes: int = len(EMOTIONS), epochs: int = E.EPOCHS) -> E.SequenceModel:
    """Slot B: a linear model over the padded sequence (see ``as_ids``), trained
    epoch by epoch; the epoch with the least validation loss is kept."""
    return E.fit(train, validation, classes, epochs=epochs)


def fit_model_a(
    train: DataFrame, text_col: str = "text", label_col: str = "label", max_iter: int = 20, seed: int = 42, hashed_features: int = 1 << 15,
    max_len: int = MAX_SEQ_LEN,
):
    """Slot A: hashed unigrams + bigrams of the raw text's first ``max_len``
    words, logistic regression; the regularisation is chosen on a held-out part by weighted F1 (the metric
    used to keep the best model).  ``hashed_features`` is the width of each
    hash: raise it with the vocabulary.  Texts become features once, in a
    written table that every fit reads."""
    tok = _tokenizer(text_col, max_len)
    bigrams = NGram(n=2, inputCol="_tokens", outputCol="_bigrams")
    tf1 = HashingTF(inputCol="_tokens", outputCol="_tf1", numFeatures=hashed_features)
    tf2 = HashingTF(inputCol="_bigrams", outputCol="_tf2", numFeatures=hashed_features)
    asm = VectorAssembler(inputCols=["_tf1", "_tf2"], outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol=label_col, family="multinomial", maxIter=max_iter)
    read = Pipeline(stages=[tok, bigrams, tf1, tf2, asm]).fit(train)
    features = materialised(read.transform(train.select(text_col, label_col)).select(label_col, "_features"), "features")
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1]).build()
    ev = MulticlassClassificationEvaluator(labelCol=label_col, predictionCol="prediction", metricName="f1")
    tvs = TrainValidationSplit(estimator=lr, estimatorParamMaps=grid, evaluator=ev, trainRatio=0.8, seed=seed)
    return PipelineModel([*read.stages, tvs.fit(features).bestModel])


def model_probs(model: PipelineModel | E.SequenceModel, df: DataFrame, key: str, input_col: str) -> DataFrame:
    """(key, probs): a narrow map over the input."""
    if isinstance(model, E.SequenceModel):
        return E.probabilities(model, df, key, input_col)
    return model.transform(df.select(key, input_col)).select(key, vector_to_array("probability").alias("probs"))


def score_slot(
    model: PipelineModel | E.SequenceModel | None,
    texts: DataFrame,
    key: str,
    slot: str,
    text_col: str = "text",
    vocab: DataFrame | None = None,
) -> DataFrame:
    """(key, emotion, confidence, scores, cleaned_text, model) of every text.

    Slot A reads the raw text and reports it stripped; slot B reads the plainly
    cleaned text as word numbers of ``vocab`` and reports the cleaned text.  A
    model reads a text's first ``MAX_SEQ_LEN`` words, as its training did.
    Without a model, or where it gives nothing usable, the keyword scorer
    stands in under the name '<slot> Fallback'.
    """
    base = materialised(predict_keyword(texts, [key], text_col), "slot-keyword")
    shown = texts.select(key, trim_ws(text_col).alias("_shown")) if slot == MODEL_A else base.select(key, F.col("cleaned_text").alias("_shown"))
    if model is None:
        probs = base.select(key, F.lit(None).cast("array<double>").alias("probs"))
    elif slot == MODEL_A:
        probs = model_probs(model, texts, key, text_col)
    else:
        probs = model_probs(model, as_ids(base.select(key, "cleaned_text"), vocab, "cleaned_text"), key, "ids")
    out = with_fallback(base, probs, key, slot).join(shown, key)
    scores = F.map_from_arrays(F.array(*[F.lit(e) for e in EMOTIONS]), F.col("probs"))
    return out.select(key, "emotion", "confidence", scores.alias("scores"), F.col("_shown").alias("cleaned_text"), "model")


def predictions_for_eval(model: PipelineModel | E.SequenceModel, df: DataFrame, input_col: str, label_col: str = "label") -> DataFrame:
    """(actual, predicted) of labelled rows."""
    if isinstance(model, E.SequenceModel):
        probs = E.probabilities(model, df.select(F.col(label_col).alias("actual"), input_col), "actual", input_col)
        return probs.select(F.col("actual").cast("int").alias("actual"), (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("predicted"))
    out = model.transform(df.select(label_col, input_col))
    return out.select(F.col(label_col).cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted"))


def training_history(model: E.SequenceModel) -> DataFrame:
    """(epoch, train_loss, train_accuracy, validation_loss,
    validation_accuracy, is_best): the kept weights are the best epoch's."""
    return model.curve(SparkSession.getActiveSession())


# ---------------------------------------------------------------------------
# Pluggable Arrow-batched scorer
# ---------------------------------------------------------------------------

def score_with_pandas(df: DataFrame, scorer: str, key: str, text_col: str, n_labels: int = len(EMOTIONS)) -> DataFrame:
    """Apply an external text classifier with ``mapInPandas``.

    ``scorer`` names an importable factory, ``package.module:function``; it
    builds a callable ``list[str] -> 2-D array`` of probabilities, once per
    Python worker (``moodframe.operators.scorers`` keeps it between tasks).
    Where a batch raises, its texts are scored one by one, and only a text
    that raises alone gets NULL probabilities, which ``with_fallback`` turns
    into a keyword prediction: batch sizes change nothing.
    """
    from moodframe.operators.scorers import probabilities

    def run(batches):
        for pdf in batches:
            yield pdf[[key]].assign(probs=probabilities(scorer, pdf[text_col].fillna("").tolist()))

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, text_col).mapInPandas(run, f"{key} {key_type}, probs array<double>")


def model_status(slot_b_loaded: bool, slot_a_loaded: bool) -> str:
    """Status line of the scorer registry: 'BiLSTM, BERT' or with 'fallback'."""
    b = "BiLSTM" if slot_b_loaded else "BiLSTM fallback"
    a = "BERT" if slot_a_loaded else "BERT fallback"
    return f"{b}, {a}"
