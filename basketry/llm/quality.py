"""Quality classifier by co-training: a text-content view and a metadata view teach each other, then score all documents.

A document is acceptable if it is labelled ``quality`` 1 and not ``toxic``.  These are two targets, learned apart, so that
the few toxic rows are not lost among the many of low quality.  Both are learned on a bounded, documented sample
(``FIT_ROWS`` labelled rows, a quarter of them held back, and ``POOL_ROWS`` unlabelled ones, drawn by the hash of doc_id).

Quality: both views are logistic regressions.  In each round either view adds the pool documents that it is confident of,
as pseudo-labels, to the other view's training rows.
Toxicity: few words tell, each in few rows, so the text view sums the log-odds of the ``MARKS`` most telling distinct words
(hashed, without the signs around them); the metadata view is a logistic regression.  There are no pseudo-labels.

Each view is calibrated (Platt) on the rows held back, and the calibrated log-odds of the views are added, less the
prior's, as of views independent given the class.  The score is the probability of good quality times that of no toxicity.
A document is kept if its score reaches the threshold and its toxicity stays under a cut: on the rows held back, the one
with the greatest recall of toxic rows less the share of others lost, which is ``OTHERS_LOST`` at most (0.5 with fewer
than ``TOXIC_HELD`` toxic rows).  Scoring is one pass over
all documents.

Text view: the distinct words of the whole text, lower-cased, and binned shapes of it (runs of capitals and of symbols,
repeated words and lines, word length and count).
Metadata view: source, lang, and the size classes of ``n_chars``.

Null or empty text: no words, the shape ``empty``; null metadata is a category of its own.  A target without labels of both
classes cannot be learned and takes no part; without any target every score is null and every row is kept.  Labels of repeated ids count once (least
quality, most toxic); an empty table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import materialise, words
from basketry.session import scratch_path

FIT_ROWS, POOL_ROWS, ROUNDS, CONFIDENT = 24_000, 12_000, 2, 0.97
TARGETS = ("good", "toxic")
#: Share of other rows that the cut on toxicity may give up, and toxic rows held back from which it is chosen.
OTHERS_LOST, TOXIC_HELD = 0.03, 20
#: Buckets of words and number of words that count for toxicity, and steps of a weight of 1.
MARK_BINS, MARKS, MARK_STEPS = 1 << 17, 3, 10
DIMS = {"text": 1 << 15, "meta": 1 << 10}


def _bin(name: str, share: Column, steps: int = 10) -> Column:
    """One token for the bin of a share in 0 .. 1; the least bins are finer."""
    fine = F.when(share <= 0, F.lit("0")).when(share < 0.02, F.lit("s")).otherwise(F.floor(share * steps).cast("string"))
    return F.concat(F.lit(f"\t{name}="), fine)


def _mark(word: Column) -> Column:
    """The bucket of a word without the signs around it."""
    bare = F.regexp_replace(word, r"^[^\p{L}\p{M}]++|[^\p{L}\p{M}]++$", "")
    return F.pmod(F.xxhash64(bare), F.lit(MARK_BINS)).cast("int")


def text_tokens(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text_view``, the distinct words and the shape tokens (which hold a tab, as no word does), and ``marks``."""
    low, seen, lines = F.col("__low"), F.col("__seen"), F.col("__lines")
    text = F.coalesce("text", F.lit(""))
    n = F.greatest(F.size(low), F.lit(1))
    shapes = F.array(
        _bin("upper", F.regexp_count(text, F.lit(r"\p{Lu}{2,}")) / n),
        _bin("symbols", F.regexp_count(text, F.lit(r"[!#$%&*=?@^~]{2,}")) / n),
        _bin("again", 1 - F.size(seen) / n, 20),
        _bin("lines", 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))),
        F.concat(F.lit("\tlen="), F.floor(F.length(text) / n).cast("string")),
        F.concat(F.lit("\tcount="), F.floor(F.log2(n.cast("double"))).cast("string")),
        F.when(F.size(low) == 0, F.lit("\tempty")).otherwise(F.lit("\tfull")),
    )
    return (
        docs.withColumn("__low", words(F.lower("text")))
        .withColumn("__seen", F.array_distinct("__low"))
        .withColumn("__lines", F.split(text, "\n"))
        .withColumn("text_view", F.concat("__seen", shapes))
        .withColumn("marks", F.array_distinct(F.transform("__seen", _mark)))
        .drop("__low", "__seen", "__lines")
    )


def meta_tokens(docs: DataFrame) -> DataFrame:
    """``docs`` with ``meta_view``: tokens of source, lang and n_chars."""
    named = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\tnull")))
    size = F.floor(F.log2(F.greatest(F.col("n_chars").cast("double"), F.lit(0.0)) + 1) * 2).cast("string")
    return docs.withColumn(
        "meta_view",
        F.array(
            named("source"), named("lang"), F.concat(F.lit("size="), F.coalesce(size, F.lit("\tnull"))),
            F.concat_ws("/", named("source"), named("lang")),
        ),
    )


def _vectors(df: DataFrame) -> DataFrame:
    for view, dims in DIMS.items():
        tf = HashingTF(inputCol=f"{view}_view", outputCol=f"{view}_x", numFeatures=dims, binary=True)
        df = tf.transform(df).drop(f"{view}_view")
    return df


def _margin(model, df: DataFrame, target: str, view: str) -> DataFrame:
    """``df`` with ``{target}_{view}_z``, the view's log-odds of the target."""
    out = model.setFeaturesCol(f"{view}_x").setRawPredictionCol("__raw").setProbabilityCol("").setPredictionCol("")
    return out.transform(df).withColumn(f"{target}_{view}_z", vector_to_array("__raw")[1]).drop("__raw")


def _fit(rows: DataFrame, target: str, view: str):
    reg = {"text": 0.003, "meta": 0.01}[view]
    lr = LogisticRegression(featuresCol=f"{view}_x", labelCol=target, maxIter=15, regParam=reg, standardization=False)
    # FIT_ROWS and POOL_ROWS rows at most: few tasks, so that a step is one stage
    model = lr.fit(rows.select(f"{view}_x", target).coalesce(4))
    # a fitted model holds its training summary, and with it the session, which is sent to the tasks that apply the model and
    # cannot be once an Observation was used; a model that is read back holds its coefficients alone
    path = scratch_path(rows.sparkSession, "quality_model")
    model.write().save(path)
    return LogisticRegressionModel.load(path)


def _weigh(train: DataFrame) -> list[int]:
    """By bucket of words, its log-odds of a toxic row in steps; 0 for what speaks against it or is in less than 3 rows."""
    toxic, n = train.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    share = lambda c, of: F.log((c + 0.1) / (of + 0.2))
    counts = (
        train.select("toxic", F.explode("marks").alias("mark"))
        .groupBy("mark")
        .agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
        .filter("n >= 3")
        .select("mark", F.round(MARK_STEPS * (share(F.col("t"), toxic) - share(F.col("n") - F.col("t"), n - toxic))).alias("w"))
    )
    weights = [0] * MARK_BINS
    for r in counts.filter("w > 0").collect():  # MARK_BINS rows at most
        weights[r["mark"]] = int(r["w"])
    return weights


def _evidence(weights: list[int], df: DataFrame) -> DataFrame:
    """``df`` with ``toxic_text_z``, the sum of its ``MARKS`` greatest weights."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folded to one literal
    found = F.filter(F.transform("marks", lambda m: F.get(table, m)), lambda w: w > 0)
    top = F.slice(F.sort_array(found, asc=False), 1, MARKS)
    total = F.aggregate(top, F.lit(0), lambda acc, w: acc + w)
    return df.withColumn("toxic_text_z", total.cast("double") / MARK_STEPS)


def _logistic(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def _platt(y: np.ndarray, z: np.ndarray, start: tuple[float, float]) -> tuple[float, float]:
    """Slope and offset of a view's calibrated log-odds ``z``: Newton steps over the rows held back."""
    slope, offset = start
    for _ in range(10 if len(y) else 0):
        p = _logistic(z * slope + offset)
        w, e = p * (1 - p) + 1e-6, y - p
        g1, g0 = (e * z).sum() - 1e-2 * (slope - 1), e.sum()
        h11, h10, h00 = (w * z * z).sum() + 1e-2, (w * z).sum(), w.sum() + 1e-2
        det = h11 * h00 - h10 * h10
        if det <= 1e-12:
            break
        slope, offset = slope + (h00 * g1 - h10 * g0) / det, offset + (h11 * g0 - h10 * g1) / det
        slope = min(max(slope, 0.0), 5.0)
    return float(slope), float(offset)


def _drawn(df: DataFrame, rows: int, salt: str) -> DataFrame:
    """About ``rows`` rows at most, by a hash of doc_id."""
    n = df.count()
    share = min(1.0, rows / n) if n else 1.0
    return df.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(share * 1_000_000))


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    """By target: the two views' models, calibrations, the prior's log-odds, for ``toxic`` the cut; None without any target."""
    known = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(
            (F.min("quality") >= 1).cast("double").alias("good"),
            (F.coalesce(F.max("toxic"), F.lit(0)) >= 1).cast("double").alias("toxic"),
        )
    )
    known = materialise(known, "quality_labels")
    fit = _drawn(known, FIT_ROWS, "fit").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0)
    ids = docs.select("doc_id").filter("doc_id is not null")
    pool = _drawn(ids.join(known, "doc_id", "left_anti"), POOL_ROWS, "pool")
    none = F.lit(None).cast("double")
    pool = pool.select("doc_id", *(none.alias(t) for t in TARGETS), F.lit(False).alias("held")).distinct()
    drawn = F.broadcast(fit.union(pool))  # FIT_ROWS and POOL_ROWS rows
    sample = docs.select("doc_id", "text", "lang", "source", "n_chars").join(drawn, "doc_id")
    sample = materialise(_vectors(meta_tokens(text_tokens(sample))).drop("text").repartition(8), "quality_sample")
    learned = {"good": _co_train(sample), "toxic": _learn_toxic(sample)}
    return {t: found for t, found in learned.items() if found} or None


def _prior(train: DataFrame, target: str) -> float | None:
    """Log-odds of the target; None if the training rows are of one class."""
    mean, n = train.agg(F.avg(target), F.count(F.lit(1))).first()
    return math.log(mean / (1 - mean)) if n and mean not in (0.0, 1.0) else None


def _margins(models: dict, df: DataFrame, target: str) -> DataFrame:
    """``df`` with the log-odds of both views."""
    text = models["text"]
    df = _evidence(text, df) if target == "toxic" else _margin(text, df, target, "text")
    return _margin(models["meta"], df, target, "meta")


def _calibrated(models: dict, sample: DataFrame, target: str, prior: float) -> dict:
    held = _margins(models, sample.filter("held and " + target + " is not null"), target)
    # a quarter of FIT_ROWS rows of three numbers
    rows = np.array(held.select(target, f"{target}_text_z", f"{target}_meta_z").collect(), float).reshape(-1, 3)
    # evidence is far from calibrated: from slope 1 Newton's steps would overshoot, from the prior they do not
    start = (0.0, prior) if target == "toxic" else (1.0, 0.0)
    platt = {v: _platt(rows[:, 0], rows[:, 1 + i], start) for i, v in enumerate(("text", "meta"))}
    return {"models": models, "platt": platt, "prior": prior, "held": rows}


def _learn_toxic(sample: DataFrame) -> dict | None:
    """The views' models, calibrations, the prior's log-odds and the cut; None if the training rows are of one class."""
    train = sample.filter("toxic is not null and not held")
    prior = _prior(train, "toxic")
    if prior is None:
        return None
    models = {"text": _weigh(train), "meta": _fit(train, "toxic", "meta")}
    found = _calibrated(models, sample, "toxic", prior)
    return found | {"cut": _cut(found)}


def _co_train(sample: DataFrame) -> dict | None:
    """The views' models of quality, calibrations and the prior's log-odds; None if the training rows are of one class."""
    train, unlabelled = sample.filter("good is not null and not held"), sample.filter("good is null")
    prior = _prior(train, "good")
    if prior is None:
        return None
    rows = {"text": train, "meta": train}
    models = {}
    for turn in range(ROUNDS + 1):
        models = {view: _fit(rows[view], "good", view) for view in rows}
        if turn == ROUNDS:
            break
        seen = _margins(models, unlabelled, "good")
        for view, teacher in (("text", "meta"), ("meta", "text")):
            p = 1 / (1 + F.exp(-F.col(f"good_{teacher}_z")))
            sure = seen.filter((p >= CONFIDENT) | (p <= 1 - CONFIDENT)).withColumn("good", (p >= 0.5).cast("double"))
            rows[view] = train.unionByName(sure.select(train.columns))
    return _calibrated(models, sample, "good", prior)


def _probabilities(df: DataFrame, target: str, found: dict) -> DataFrame:
    """``df`` with the target's probability ``{target}_text``, ``{target}_meta`` and ``{target}_both`` for its log-odds."""
    logistic = lambda z: 1 / (1 + F.exp(-z))
    z = {}
    for view, (slope, offset) in found["platt"].items():
        z[view] = F.col(f"{target}_{view}_z") * slope + offset
    z["both"] = z["text"] + z["meta"] - F.lit(found["prior"])
    return df.withColumns({f"{target}_{k}": logistic(v) for k, v in z.items()}).drop(f"{target}_text_z", f"{target}_meta_z")


def _cut(found: dict) -> float:
    """The toxicity with the greatest recall of toxic rows less the share of others lost, on the rows held back.

    At most ``OTHERS_LOST`` of the others are given up, and fewer than ``TOXIC_HELD`` toxic rows decide nothing: 0.5.
    """
    rows, z = found["held"], 0.0
    for i, view in enumerate(("text", "meta")):
        slope, offset = found["platt"][view]
        z = z + rows[:, 1 + i] * slope + offset
    score, y = _logistic(z - found["prior"]), rows[:, 0]
    toxic, other = y.sum(), (1 - y).sum()
    if toxic < TOXIC_HELD:
        return 0.5
    steps = np.unique(score)[::-1]
    order = np.argsort(-score)
    upto = np.searchsorted(-score[order], -steps, "right")  # rows at or above each step
    caught, lost = np.append(0, np.cumsum(y[order]))[upto], np.append(0, np.cumsum(1 - y[order]))[upto]
    gain = np.where(lost <= OTHERS_LOST * other, caught / toxic - lost / max(other, 1.0), -1.0)
    best = int(gain.argmax())
    if gain[best] <= 0:
        return 0.5
    # halfway to the next lower score, so that no rounding decides
    return float((steps[best] + (steps[best + 1] if best + 1 < len(steps) else steps[best])) / 2)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``text_score``, ``meta_score``, ``score`` (probability of an acceptable document) and ``kept``."""
    learned = learn(docs, labels)
    none = F.lit(None).cast("double")
    if learned is None:
        return docs.withColumns({"text_score": none, "meta_score": none, "score": none, "kept": F.lit(True)})
    out = _vectors(meta_tokens(text_tokens(docs)))
    for target, found in learned.items():
        out = _margins(found["models"], out, target)
    out = out.drop("marks", *(f"{view}_x" for view in DIMS))
    # the count is a fence: a filter on the score is not pushed below it, which would build every feature many times
    out = out.observe("quality_scored", F.count(F.lit(1)).alias("rows"))
    for target, found in learned.items():
        out = _probabilities(out, target, found)
    good = lambda k: F.col(f"good_{k}") if "good" in learned else F.lit(1.0)
    clean = lambda k: 1 - F.col(f"toxic_{k}") if "toxic" in learned else F.lit(1.0)
    kept = F.col("score") >= threshold
    if "toxic" in learned:
        kept = kept & (F.col("toxic_both") < learned["toxic"]["cut"])
    return (
        out.withColumns({"text_score": good("text") * clean("text"), "meta_score": good("meta") * clean("meta")})
        .withColumn("score", good("both") * clean("both"))
        .withColumn("kept", kept)
        .drop(*(f"{t}_{k}" for t in learned for k in ("text", "meta", "both")))
    )


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier keeps."""
    return score_documents(docs, labels, threshold).filter("kept").select(*docs.columns)
