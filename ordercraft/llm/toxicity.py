"""Toxicity scores: gradient-boosted trees over dense text features.

The features are rates per word or character: hits of two lexicons (a short
fixed list and one learned from the training labels), hits close to a second
person, capitals, punctuation, and spellings that hide a word (digits or
signs inside words, stretched letters). A bounded sample of labelled rows is
cut by hash into eighths: the first four give the lexicon, the third to seventh
fit Spark ML's trees, and the last, which neither has seen, calibrates the raw
scores by isotonic regression. All documents are scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TMP, annotate, materialize

SAMPLE_ROWS = 20_000  # labelled rows (by hash) that the model is fitted on
LEXICON_SIZE = 200  # learned words
TREES, DEPTH = 20, 4

# Common English insults, and second-person words of the corpus
# languages.
INSULTS = ("idiot", "moron", "stupid", "trash", "scum", "clown", "loser", "pathetic", "worthless",
           "disgusting", "dumb", "fool", "garbage", "jerk", "liar", "filth", "vermin", "coward",
           "ugly", "hate", "shut", "kill", "die")
SECOND_PERSON = ("you", "your", "yours", "u", "ur", "yourself", "du", "dich", "dir", "dein", "deine",
                 "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "usted",
                 "ustedes", "ti", "tus", "su")
NEAR = 5  # words between a hit and a second-person word that count as close
# Letters that digits and signs stand for.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = ("insult_rate", "learned_rate", "learned_weight", "max_weight", "any_insult", "any_learned",
            "near_second_person", "second_person_rate", "hidden_insult_rate", "leet_rate",
            "stretched_rate", "capital_rate", "shouted_rate", "exclaim_rate", "question_rate",
            "sign_rate", "digit_rate", "distinct_share", "log_words", "hits")


def plain_words(text: str) -> list[str]:
    return [w.strip(".,;:!?\"'()[]{}*#%&$|-_") for w in text.lower().split()]


def features(text: str, lexicon: dict[str, float], insults=frozenset(INSULTS),
             second=frozenset(SECOND_PERSON)) -> list[float]:
    raw = text.split()
    words = plain_words(text)
    n = max(1, len(words))
    vocab = set(words)
    bad = {w for w in vocab if w in insults}
    learned = {w for w in vocab if w in lexicon}
    odd = [w for w in vocab if not w.isalpha() and any(c in LEET for c in w)]
    unveiled = {w for w in odd
                if "".join(LEET.get(c, c) for c in w if c.isalpha() or c in LEET) in insults}
    stretched = sum(1 for w in vocab if len(w) > 3 and any(
        w[i] == w[i + 1] == w[i + 2] for i in range(len(w) - 2)))
    hits_at = [i for i, w in enumerate(words) if w in bad or w in learned or w in unveiled] \
        if bad or learned or unveiled else []
    near = 0
    if hits_at:
        you = np.array([i for i, w in enumerate(words) if w in second])
        if len(you):
            h = np.array(hits_at)
            k = np.searchsorted(you, h)
            left = np.where(k > 0, h - you[np.maximum(k - 1, 0)], 1 << 30)
            right = np.where(k < len(you), you[np.minimum(k, len(you) - 1)] - h, 1 << 30)
            near = int((np.minimum(left, right) <= NEAR).sum())
    chars = max(1, len(text))
    upper = sum(map(str.isupper, text)) if text != text.lower() else 0
    shouted = sum(1 for w in raw if len(w) > 2 and w.isupper()) if upper > 3 else 0
    n_bad = sum(1 for i in hits_at if words[i] in bad)
    n_learned = sum(1 for i in hits_at if words[i] in learned)
    weights = [lexicon[w] for w in learned]
    signs = sum(text.count(c) for c in "#%&$*|@")
    return [n_bad / n, n_learned / n, sum(weights) / n, max(weights, default=0.0), float(bool(bad)),
            float(bool(learned)), near / n, sum(1 for w in words if w in second) / n,
            len(unveiled) / n, len(odd) / n, stretched / n, upper / chars, shouted / n,
            text.count("!") / chars, text.count("?") / chars, signs / chars,
            sum(map(text.count, "0123456789")) / chars, len(vocab) / n, float(np.log1p(len(words))),
            float(len(hits_at))]


def with_features(docs: DataFrame, lexicon: dict[str, float], text_col: str,
                  keep: list[str], out: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        lex = shared.value

        def work(text):
            rows = [features(t or "", lex) for t in text.to_pylist()]
            flat = np.array(rows, np.float64).reshape(-1)
            off = np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)
            return [pa.ListArray.from_arrays(pa.array(off), pa.array(flat))]
        return work

    return annotate(docs, text_col, make, "f array<double>", out, keep, chunk_bytes=2 << 20)


def learn_lexicon(sample: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """The words whose documents are most often toxic: smoothed log-odds of the
    document frequency, weighted by evidence. Bounded by ``size``."""
    words = sample.select("label", F.explode(F.array_distinct(F.split(F.regexp_replace(
        F.lower("text"), r"[.,;:!?\"'()\[\]{}*#%&$|\-_]", " "), r"\s+"))).alias("w")).where("w != ''")
    total = sample.agg(F.sum("label").alias("pos"), F.count("*").alias("n")).first()
    pos, neg = float(total["pos"] or 0), float((total["n"] or 0) - (total["pos"] or 0))
    df = words.groupBy("w").agg(F.sum("label").alias("p"), F.count("*").alias("n")).where("p >= 3")
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (neg + 1))
    top = df.withColumn("o", odds).where("o > 1").orderBy(
        (F.col("o") * F.sqrt("p")).desc(), "w").limit(size)
    return {r["w"]: float(r["o"]) for r in top.select("w", "o").collect()}


def score(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None,
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` (or ``keep``) with ``score``, the calibrated probability of the
    label, and ``predicted`` (1 from 0.5 on).

    ``train`` selects the documents to learn from; they need a label of 0 or 1
    (a null label or id is not used; of several labels of one id the highest
    counts, of several texts of one id the one with the smallest hash, so the
    sample is bounded in rows). Without both classes among them every score is
    their share of 1 (0.0 without any); a part of the sample without both is
    replaced by the whole. Null and empty texts are scored as texts without
    words. All rows are scored, repeated ones too. Columns called score or
    predicted, in any case, are replaced; others stay."""
    label = F.col(f"`{label_col}`")
    marks = labels.where(label.isin(0, 1) & F.col(f"`{id_col}`").isNotNull()) \
        .groupBy(F.col(f"`{id_col}`").alias(f"{TMP}id")).agg(F.max(label).cast("double").alias("label"))
    n = marks.count()
    share = min(1.0, sample_rows / n) if n else 1.0
    # the hash filters the documents before the join, so only sampled texts move
    chosen = docs.where(train).select(
        F.col(f"`{id_col}`").alias(f"{TMP}d"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.pmod(F.xxhash64(F.lit(11), F.col(f"`{id_col}`")), F.lit(1 << 30)).alias("h")) \
        .where(F.col("h") < int(share * (1 << 30)))
    chosen = chosen.groupBy(f"{TMP}d", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = materialize(chosen.join(marks, F.col(f"{TMP}d") == F.col(f"{TMP}id"))
                         .select("label", "text", "h"), "toxic-sample")
    size = sample.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    rows, positive = size["n"], size["p"] or 0.0
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    f = f"{TMP}f"
    if not 0 < positive < rows:
        out = docs.select(*[F.col(f"`{c}`") for c in names],
                          F.lit(float(positive / rows) if rows else 0.0).alias("score"))
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    eighth = F.pmod(F.col("h"), F.lit(8))
    parts = {r["p"]: (r["n"], r["s"]) for r in sample.groupBy(eighth.alias("p")).agg(
        F.count("*").alias("n"), F.sum("label").alias("s")).collect()}

    def part(*which):
        """Rows of these eighths; all rows if they lack a class."""
        got = [parts.get(i, (0, 0.0)) for i in which]
        both = 0 < sum(x[1] for x in got) < sum(x[0] for x in got)
        return eighth.isin(*which) if both else F.lit(True)

    lexicon = learn_lexicon(sample.where(part(0, 1, 2, 3)))
    data = with_features(sample, lexicon, "text", ["label", "h"], f) \
        .select("label", "h", array_to_vector(F.col(f"{f}.f")).alias("features"))
    data = materialize(data, "toxic-features")
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH,
                          stepSize=0.2, seed=5, minInstancesPerNode=5).fit(data.where(part(2, 3, 4, 5, 6)))
    margin = vector_to_array("rawPrediction")[1]
    unseen = model.transform(data.where(part(7))).select("label", margin.alias("m"))
    iso = IsotonicRegression(labelCol="label", featuresCol="m").fit(unseen)
    scored = with_features(docs, lexicon, text_col, names, f) \
        .select(*[F.col(f"`{c}`").alias(f"{TMP}c{i}") for i, c in enumerate(names)],
                array_to_vector(F.col(f"{f}.f")).alias("features"))
    scored = model.transform(scored).withColumn("m", margin)
    scored = iso.setPredictionCol("iso").transform(scored)
    # steps of the calibration are flat: the margin breaks ties inside a step
    value = F.least(F.greatest(0.998 * F.col("iso") + 0.002 / (1 + F.exp(-2 * F.col("m"))),
                               F.lit(0.0)), F.lit(1.0))
    return scored.select(*[F.col(f"{TMP}c{i}").alias(c) for i, c in enumerate(names)],
                         value.alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
