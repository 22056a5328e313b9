"""Scoring, training, calibration, evaluation and audit of the combining model."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.functions import stats
from reviewlens.operators.signals import FEATURES, INJECTION_KERNEL

# Acceptance criteria and the training schedule.
MIN_PRECISION, MIN_RECALL, MAX_ECE = 0.80, 0.50, 0.05
RATE, ITERATIONS, PENALTY = 0.1, 2000, 0.01
ARTIFACT_VERSION = 1
#: Rows that a model is fitted on at most.
FIT_ROWS = 100_000


@dataclass
class Model:
    """Logistic weights over flat features (column names), a calibration curve and quantile sketches for imputation."""

    intercept: float
    coefficients: dict[str, float]
    calibration: list[tuple[float, float]] = field(default_factory=list)
    sketches: dict[str, list[float]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"version": ARTIFACT_VERSION, **asdict(self)}, sort_keys=True, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> "Model":
        """Strict: finite numbers, sorted sketches and curve, a known version."""
        raw = json.loads(text)
        if raw.pop("version", None) != ARTIFACT_VERSION:
            raise ValueError("unknown model version")
        model = cls(float(raw["intercept"]), {k: float(v) for k, v in raw["coefficients"].items()}, [(float(x), float(y)) for x, y in raw["calibration"]], {k: [float(x) for x in v] for k, v in raw["sketches"].items()})
        numbers = [model.intercept, *model.coefficients.values(), *(v for p in model.calibration for v in p), *(v for s in model.sketches.values() for v in s)]
        if not all(map(math.isfinite, numbers)):
            raise ValueError("a number of the model is not finite")
        xs, ys = [p[0] for p in model.calibration], [p[1] for p in model.calibration]
        if xs != sorted(xs) or ys != sorted(ys) or any(not s or s != sorted(s) for s in model.sketches.values()):
            raise ValueError("calibration or sketch is not sorted")
        return model

    def probability(self, features: dict[str, float | None], fraction: float = 0.5) -> float | None:
        """What ``score`` gives a row with these features; None where it isn't ok."""
        if self.coefficients and all(features.get(n) is None for n in self.coefficients):
            return None
        z = self.intercept
        for name, weight in self.coefficients.items():
            value = features.get(name)
            if value is None:
                sketch = self.sketches.get(name)
                if not sketch:
                    return None
                value = float(np.interp(min(1.0, max(0.0, fraction)) * (len(sketch) - 1), range(len(sketch)), sketch))
            z += weight * value
        e = math.exp(-abs(z))
        raw = 1 / (1 + e) if z >= 0 else e / (1 + e)
        return float(np.interp(raw, *zip(*self.calibration, strict=True))) if self.calibration else raw

    def probabilities(self, features: dict[str, np.ndarray], fraction: np.ndarray) -> np.ndarray:
        """``probability`` of many rows; NaN stands for None."""
        z, seen = np.full(len(fraction), float(self.intercept)), np.zeros(len(fraction), bool)
        for name, weight in self.coefficients.items():
            value = features.get(name, np.full(len(fraction), np.nan))
            there, sketch = ~np.isnan(value), self.sketches.get(name)
            seen |= there
            spare = np.interp(np.clip(fraction, 0, 1) * (len(sketch) - 1), range(len(sketch)), sketch) if sketch else np.nan
            z = z + weight * np.where(there, value, spare)
        e = np.exp(-np.abs(z))
        raw = np.where(z >= 0, 1 / (1 + e), e / (1 + e))
        out = np.where(np.isnan(z), np.nan, np.interp(raw, *zip(*self.calibration, strict=True))) if self.calibration else raw
        return np.where(seen, out, np.nan) if self.coefficients else out

    def digest(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()[:8]


@dataclass
class Slots:
    """The two places for models: the graph slot needs a local one."""

    local: Model | None = None
    graph: Model | None = None

    def place(self, slot: str, model: Model) -> "Slots":
        if slot == "graph" and self.local is None:
            raise ValueError("a graph model needs a local model")
        return Slots(**{"local": self.local, "graph": self.graph, slot: model})


def absent_artifact(reason: str) -> str:
    """The artifact that says that there is no model."""
    return json.dumps({"artifactVersion": ARTIFACT_VERSION, "present": False, "reason": reason}, sort_keys=True)


def _body(model: Model, trained_at: float, acceptance: dict, priors: str) -> dict:
    curve = [{"x": x, "y": y} for x, y in model.calibration]
    return {"intercept": model.intercept, "coefficients": dict(sorted(model.coefficients.items())), "calibration": curve, "featureQuantiles": dict(sorted(model.sketches.items())), "trainedAt": trained_at, "acceptance": acceptance, "priors": {"digest": priors}}


def place_in_artifact(existing: str, slot: str, model: Model, trained_at: float, acceptance: dict, priors: str) -> str:
    """The artifact with a model in slot ``local`` or ``reviewerGraph``; the other slot stays, and a graph model needs a local one."""
    held = json.loads(existing)
    body = _body(model, trained_at, acceptance, priors)
    if slot == "local":
        out = {"artifactVersion": ARTIFACT_VERSION, "present": True, **body}
        if "reviewerGraph" in held:
            out["reviewerGraph"] = held["reviewerGraph"]
    elif slot != "reviewerGraph":
        raise ValueError(f"unknown slot {slot!r}")
    elif held.get("present") is not True:
        raise ValueError("a graph model needs a local model")
    else:
        out = {**held, "reviewerGraph": body}
    return json.dumps(out, indent=2, sort_keys=True) + "\n"


def read_artifact(text: str) -> Slots | None:
    """The models of an artifact; None if it says that there is none.  Raises for another version and for what isn't a whole model."""
    raw = json.loads(text)
    if raw.get("artifactVersion") != ARTIFACT_VERSION:
        raise ValueError(f"unknown artifact version {raw.get('artifactVersion')!r}")
    if raw.get("present") is not True:
        return None

    def model(body: dict) -> Model:
        plain = {"version": ARTIFACT_VERSION, "intercept": body["intercept"], "coefficients": body["coefficients"], "calibration": [(p["x"], p["y"]) for p in body["calibration"]], "sketches": body.get("featureQuantiles", {})}
        return Model.from_json(json.dumps(plain))

    try:
        return Slots(model(raw), model(raw["reviewerGraph"]) if raw.get("reviewerGraph") is not None else None)
    except (KeyError, TypeError) as e:
        raise ValueError(f"the artifact lacks {e}") from e


def artifact_priors(text: str) -> dict[str, str | None]:
    """Digest of the priors that each model of an artifact was trained under (None: it records none)."""
    raw = json.loads(text)
    if raw.get("present") is not True:
        return {}
    bodies = {"local": raw, "reviewerGraph": raw.get("reviewerGraph")}
    return {slot: (body.get("priors") or {}).get("digest") for slot, body in bodies.items() if isinstance(body, dict)}


def canonical_json(value) -> str:
    """JSON with sorted keys and no blanks, the same for equal values."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def document_digest(value) -> str:
    """The first eight hex digits of the SHA-256 of a document's canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:8]


def read_priors(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Priors (key, organic, kernel) and aliases (alias, target) of a document with ``categories`` and ``aliases``; raises for shapes that aren't five shares."""
    raw = json.loads(text)
    rows = []
    for key, entry in sorted(raw["categories"].items()):
        organic, kernel = entry["organicPrior"], entry.get("injectionKernel", list(INJECTION_KERNEL))
        if any(len(v) != 5 or min(v) < 0 or abs(sum(v) - 1) > 1e-6 for v in (organic, kernel)):
            raise ValueError(f"{key}: a shape must be five shares that add up to 1")
        rows.append((key, [float(x) for x in organic], [float(x) for x in kernel]))
    priors = spark.createDataFrame(rows, "key string, organic array<double>, kernel array<double>")
    return priors, spark.createDataFrame(sorted(raw.get("aliases", {}).items()), "alias string, target string")


def score(vectors: DataFrame, model: Model, fraction: float = 0.5) -> DataFrame:
    """Adds status (ok, missing-features, insufficient-data, not-enough-data), raw, probability and imputed (array of features).

    Missing features come from their sketch at ``fraction``; one without a sketch
    makes the row missing-features; a row without any feature is insufficient-data.
    """
    names = list(model.coefficients)
    absent = {n: F.col(n).isNull() for n in names}
    unsketched = [absent[n] for n in names if n not in model.sketches]
    value = {n: F.coalesce(n, stats.quantile_value(model.sketches[n], F.lit(fraction))) if n in model.sketches else F.col(n) for n in names}
    z = sum((F.lit(w) * value[n] for n, w in model.coefficients.items()), F.lit(float(model.intercept)))
    every = F.lit(bool(names))
    for n in names:
        every = every & absent[n]
    some = F.lit(False)
    for u in unsketched:
        some = some | u
    gate = F.coalesce("meets_minimum", F.lit(True)) if "meets_minimum" in vectors.columns else F.lit(True)
    out = vectors.withColumn("status", F.when(~gate, "not-enough-data").when(every, "insufficient-data").when(some, "missing-features").otherwise("ok"))
    raw = F.when(F.col("status") == "ok", stats.sigmoid(z))
    out = out.withColumn("raw", raw).withColumn("probability", F.when(F.col("raw").isNotNull(), stats.piecewise(model.calibration, F.col("raw"))))
    return out.withColumn("imputed", F.filter(F.array(*[F.when(absent[n], F.lit(n)) for n in names]), lambda x: x.isNotNull()))


def score_with_slots(vectors: DataFrame, slots: Slots) -> DataFrame:
    """The graph model where there is one and the listing's flagged share is known, else the local one."""
    if slots.local is None:
        return vectors.withColumns({"status": F.lit("no-model"), "raw": F.lit(None).cast("double"), "probability": F.lit(None).cast("double"), "imputed": F.array().cast("array<string>")})
    if slots.graph is None:
        return score(vectors, slots.local)
    known = F.col("flagged_review_share").isNotNull()
    return score(vectors.where(known), slots.graph).unionByName(score(vectors.where(~known), slots.local))


def signal_names(imputed: Column) -> Column:
    """Display names of the signals of feature columns, distinct, in order."""
    shown = {column: stats.SIGNALS[key.split(".")[0]] for key, column in FEATURES.items()}
    table = F.create_map(*[F.lit(x) for pair in shown.items() for x in pair])
    return F.array_distinct(F.transform(imputed, lambda c: F.try_element_at(table, c)))


def contributions(vectors: DataFrame, model: Model, key: str = "listing_id") -> DataFrame:
    """key, feature, value, coefficient, contribution, imputed, place (by size of contribution, largest first)."""
    parts = [
        F.struct(F.lit(n).alias("feature"), F.coalesce(F.col(n), F.lit(model.sketches.get(n, [0.0])[len(model.sketches.get(n, [0.0])) // 2])).alias("value"), F.lit(float(w)).alias("coefficient"), F.col(n).isNull().alias("imputed"))
        for n, w in model.coefficients.items()
    ]
    rows = vectors.select(key, F.explode(F.array(*parts)).alias("x")).select(key, "x.*").withColumn("contribution", F.col("value") * F.col("coefficient"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.abs("contribution").desc(), "feature")))


# -- training ------------------------------------------------------------------------


def split(examples: DataFrame, fraction: float, seed: int, key: str = "example_id") -> DataFrame:
    """Adds is_test: exactly round(n * fraction) rows, the first by a hash of seed and key."""
    n = examples.count()
    size = int(math.floor(n * fraction + 0.5))
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    ranked = examples.withColumn("_h", digest)
    if not size:
        return ranked.drop("_h").withColumn("is_test", F.lit(False))
    # the size-th smallest digest is the limit: found in the one bucket of digests that holds it
    per = ranked.groupBy(F.substring("_h", 1, 4).alias("p")).agg(F.count("*").alias("n"))
    before = 0
    for r in sorted(per.collect(), key=lambda r: r["p"]):  # 65,536 counts at most
        if before + r["n"] >= size:
            break
        before += r["n"]
    limit = ranked.where(F.substring("_h", 1, 4) == r["p"]).select("_h").orderBy("_h").limit(size - before).agg(F.max("_h")).first()[0]
    return ranked.withColumn("is_test", F.col("_h") <= F.lit(limit)).drop("_h")


def complete(examples: DataFrame, features: list[str]) -> tuple[DataFrame, int]:
    """Rows that know all of the features, and how many others there are."""
    kept = examples.na.drop(subset=features)
    return kept, examples.count() - kept.count()


def priors_document(fitted: DataFrame, generated_at: Column) -> DataFrame:
    """document: fitted priors that aren't thin, by category key (as many rows as there are categories)."""
    shape = F.array(*[F.col(f"h{k}") for k in range(1, 6)])
    rows = fitted.where("key IS NOT NULL AND NOT thin").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", F.struct(shape.alias("organicPrior"), "listings", "reviews"))))).alias("categories"))
    return rows.select(F.to_json(F.struct(generated_at.alias("generatedAt"), "categories")).alias("document"))


def fit_logistic(examples: DataFrame, features: list[str], label: str = "label", rate: float = RATE, iterations: int = ITERATIONS, penalty: float = PENALTY, most: int = FIT_ROWS) -> tuple[float, dict[str, float]]:
    """Full-batch gradient descent from zero with an L2 penalty on the weights; complete rows only.

    Labelled pages are few, and the fit is sequential: it takes place on the driver,
    on at most ``most`` rows, those with the smallest hashes.
    """
    rows = examples.na.drop(subset=features).select(*[F.col(f).cast("double") for f in features], F.col(label).cast("double").alias("_y"))
    data = rows.orderBy(F.xxhash64(*features, "_y"), *features, "_y").limit(most).toPandas()
    x, y = data[features].to_numpy(float), data["_y"].to_numpy(float)
    weights, bias = np.zeros(len(features)), 0.0
    for _ in range(iterations if len(y) else 0):
        z = x @ weights + bias
        e = np.exp(-np.abs(z))
        error = np.where(z >= 0, 1 / (1 + e), e / (1 + e)) - y
        weights = weights - rate * (x.T @ error / len(y) + penalty * weights)
        bias -= rate * float(error.mean())
    return bias, dict(zip(features, weights.tolist(), strict=True))


def isotonic(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Pool-adjacent-violators fit: one point for each distinct x, y never falling."""
    sums: dict[float, list[float]] = {}
    for x, y in points:
        s = sums.setdefault(x, [0.0, 0.0])
        s[0] += y
        s[1] += 1
    blocks: list[list] = []
    for x in sorted(sums):
        total, weight = sums[x]
        blocks.append([total, weight, [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            total, weight, xs = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += weight
            blocks[-1][2] += xs
    return [(x, b[0] / b[1]) for b in blocks for x in b[2]]


def isotonic_table(scored: DataFrame, x: str = "raw", y: str = "label", ranges: int = 1024) -> list[tuple[float, float]]:
    """``isotonic`` of a table: its corners, one point for each end of a pooled block.

    Values are averaged by distinct x and pooled within ranges of x, in which order
    is all that matters; the blocks of the ranges, and no points, reach the driver,
    where they are pooled across the ranges.
    """
    per = scored.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count("*").alias("n"))
    per = per.withColumn("r", F.greatest(F.lit(0), F.least(F.lit(ranges - 1), F.floor(F.col("x") * ranges).cast("int"))))

    def pool(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        blocks = _pooled(zip(rows["s"], rows["n"], rows["x"], rows["x"], strict=True))
        return pd.DataFrame(blocks, columns=["s", "n", "low", "high"])

    pooled = per.groupBy("r").applyInPandas(pool, "s double, n long, low double, high double").orderBy("low").collect()
    out = []
    for s, n, low, high in _pooled((r["s"], r["n"], r["low"], r["high"]) for r in pooled):
        out += [(low, s / n)] if low == high else [(low, s / n), (high, s / n)]
    return out


def _pooled(blocks: Iterable[tuple[float, int, float, float]]) -> list[tuple[float, int, float, float]]:
    """Adjacent blocks (sum, count, lowest x, highest x) merged until their means never fall."""
    out: list[tuple[float, int, float, float]] = []
    for s, n, low, high in blocks:
        while out and out[-1][0] / out[-1][1] > s / n:
            ps, pn, low, _ = out.pop()
            s, n = s + ps, n + pn
        out.append((s, n, low, high))
    return out


def quantile_sketches(examples: DataFrame, features: list[str], points: int = 11) -> DataFrame:
    """feature, sketch: exact linear-interpolated quantiles of the known values."""
    at = [i / (points - 1) for i in range(points)]
    row = examples.agg(*[F.percentile(F.col(f), at).alias(f) for f in features])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("sketch")) for f in features])).alias("x")).select("x.*")


def train(examples: DataFrame, features: list[str], seed: int = 0, label: str = "label") -> tuple[Model, DataFrame]:
    """Two splits (held-out, then calibration), a fit on the rest, calibration, sketches; and the scored held-out rows."""
    first = split(examples, 0.2, seed)
    development, held_out = first.where("NOT is_test").drop("is_test"), first.where("is_test").drop("is_test")
    second = split(development, 0.25, seed + 1)
    fit_rows, calibration_rows = second.where("NOT is_test").drop("is_test"), second.where("is_test").drop("is_test")
    bias, weights = fit_logistic(fit_rows, features, label)
    sketches = {r["feature"]: list(r["sketch"]) for r in quantile_sketches(fit_rows, features).collect() if r["sketch"]}
    plain = Model(bias, weights, [], sketches)
    curve = isotonic_table(score(calibration_rows.na.drop(subset=features), plain), "raw", label)
    model = Model(bias, weights, curve, sketches)
    return model, score(held_out, model)


# -- evaluation ----------------------------------------------------------------------


def confusion(scored: DataFrame, threshold: float, p: str = "probability", label: str = "label") -> DataFrame:
    """tp, fp, tn, fn at a threshold; whatever isn't one of the first three is fn."""
    yes, real = F.col(p) >= threshold, F.col(label)
    counts = scored.where(F.col(p).isNotNull()).agg(F.count_if(yes & (real == 1)).alias("tp"), F.count_if(yes & (real == 0)).alias("fp"), F.count_if(~yes & (real == 0)).alias("tn"), F.count("*").alias("n"))
    return counts.select("tp", "fp", "tn", (F.col("n") - F.col("tp") - F.col("fp") - F.col("tn")).alias("fn"))


def rates(counts: DataFrame) -> DataFrame:
    """precision, recall and f1, null where undefined."""
    over = lambda a, b: F.when(b > 0, a / b)
    out = counts.withColumns({"precision": over(F.col("tp"), F.col("tp") + F.col("fp")), "recall": over(F.col("tp"), F.col("tp") + F.col("fn"))})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both))


def pr_curve(scored: DataFrame, p: str = "probability", label: str = "label") -> DataFrame:
    """threshold, tp, fp, precision, recall at each distinct score.

    Scores are grouped first; the running totals come from ranges of scores, whose
    own totals (few rows) are added up, so that no task sorts all scores.
    """
    per = scored.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count("*").alias("n"))
    per = per.withColumn("bucket", F.floor(F.col("threshold") * 1024))
    whole = per.groupBy("bucket").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"))
    above = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("bucket", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("ap"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"))
    inside = Window.partitionBy("bucket").orderBy(F.col("threshold").desc())
    out = per.withColumns({"tp": F.sum("pos").over(inside), "m": F.sum("n").over(inside)}).join(whole, "bucket")
    out = out.select("threshold", (F.col("tp") + F.col("ap")).alias("tp"), (F.col("m") + F.col("an")).alias("m"))
    total = scored.where(F.col(p).isNotNull()).agg(F.count_if(F.col(label) == 1).alias("all_pos"))
    return out.crossJoin(F.broadcast(total)).select("threshold", "tp", (F.col("m") - F.col("tp")).alias("fp"), (F.col("tp") / F.col("m")).alias("precision"), F.when(F.col("all_pos") > 0, F.col("tp") / F.col("all_pos")).alias("recall"))


def operating_point(curve: DataFrame, recall: float = MIN_RECALL) -> DataFrame:
    """The threshold of the highest (precision, recall) with recall over the limit; the higher threshold of equals."""
    good = curve.where(F.col("recall") > recall)
    best = good.agg(F.max(F.struct("precision", "recall", "threshold")).alias("x")).where("x IS NOT NULL")
    return best.select("x.threshold", "x.precision", "x.recall")


def calibration_error(scored: DataFrame, bins: int = 10, p: str = "probability", label: str = "label") -> DataFrame:
    """n, ece: weighted mean gap of mean probability and share of positives over equal bins."""
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), (F.col(p) * bins).cast("int")))
    per = scored.where(F.col(p).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("share"))
    return per.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n")).alias("ece"))


def acceptance(scored: DataFrame, p: str = "probability", label: str = "label") -> DataFrame:
    """threshold, precision, recall, ece, n and problems (array; empty: accepted)."""
    point = operating_point(pr_curve(scored, p, label))
    ece = calibration_error(scored, 10, p, label)
    j = ece.join(point, F.lit(True), "left")
    problems = F.array_compact(
        F.array(
            F.when(F.col("threshold").isNull(), "no threshold reaches the recall"),
            F.when(F.col("precision") <= MIN_PRECISION, "precision is too low"),
            F.when(F.coalesce("ece", F.lit(0.0)) >= MAX_ECE, "calibration error is too high"),
            F.when(F.coalesce("n", F.lit(0)) == 0, "nothing could be evaluated"),
        )
    )
    return j.select("threshold", "precision", "recall", "ece", F.coalesce("n", F.lit(0)).alias("n"), problems.alias("problems"))


# -- labelling functions -------------------------------------------------------------


def votes(rows: DataFrame, functions: dict[str, Column], key: str) -> DataFrame:
    """key, lf, vote (1, 0 or -1 for abstain; anything else abstains)."""
    legal = lambda c: F.when(c.isin(0, 1), c).otherwise(-1).cast("int")
    wide = rows.select(key, *[legal(c).alias(n) for n, c in functions.items()])
    return wide.unpivot([key], list(functions), "lf", "vote")


def python_votes(rows: DataFrame, functions: dict[str, Callable[[dict], object]], key: str) -> DataFrame:
    """``votes`` of Python functions of a row; one that raises, or says anything but 0 and 1, abstains."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                for name, function in functions.items():
                    try:
                        vote = function(row)
                    except Exception:  # whatever a labelling function does wrong, it abstains
                        vote = -1
                    out.append((row[key], name, int(vote) if vote in (0, 1) else -1))
            yield pd.DataFrame(out, columns=[key, "lf", "vote"]).astype({"vote": "int32"})

    return rows.mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, lf string, vote int")


def vote_statistics(voted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """lf, coverage, overlap, conflict (shares of all rows) and accuracy where there is gold (key, label)."""
    per_row = voted.where("vote >= 0").groupBy(key).agg(F.count("*").alias("given"), F.min("vote").alias("low"), F.max("vote").alias("high"))
    j = voted.join(per_row, key, "left").join(gold.select(key, "label"), key, "left")
    cast = F.col("vote") >= 0
    known = cast & F.col("label").isNotNull()
    return j.groupBy("lf").agg(
        (F.count_if(cast) / F.count("*")).alias("coverage"),
        (F.count_if(cast & (F.col("given") > 1)) / F.count("*")).alias("overlap"),
        (F.count_if(cast & (F.col("low") < F.col("high"))) / F.count("*")).alias("conflict"),
        F.when(F.count_if(known) > 0, F.count_if(known & (F.col("vote") == F.col("label"))) / F.count_if(known)).alias("accuracy"),
    )


def majority(voted: DataFrame, key: str) -> DataFrame:
    """key, vote: the commoner of 1 and 0; -1 on a tie."""
    sums = voted.groupBy(key).agg(F.count_if(F.col("vote") == 1).alias("p"), F.count_if(F.col("vote") == 0).alias("n"))
    return sums.select(key, F.when(F.col("p") > F.col("n"), 1).when(F.col("n") > F.col("p"), 0).otherwise(-1).alias("vote"))


# -- priors --------------------------------------------------------------------------


def fit_priors(histograms: DataFrame, keys: DataFrame, min_listings: int = 5, min_reviews: int = 500) -> DataFrame:
    """key (null: overall), listings, reviews, h1..h5 (mean of the listings' histograms: one listing, one vote), thin.

    histograms: listing_id, n_ratings, h1..h5; keys: listing_id, keys (array).
    """
    exploded = keys.select("listing_id", F.explode("keys").alias("key")).distinct()
    rows = histograms.join(exploded, "listing_id").unionByName(histograms.withColumn("key", F.lit(None).cast("string")))
    per = rows.groupBy("key").agg(F.count("*").alias("listings"), F.sum("n_ratings").alias("reviews"), *[F.avg(f"h{k}").alias(f"h{k}") for k in range(1, 6)])
    return per.withColumn("thin", (F.col("listings") < min_listings) | (F.col("reviews") < min_reviews))


def resolve_priors(trails: DataFrame, priors: DataFrame, aliases: DataFrame, hops: int = 4) -> DataFrame:
    """listing_id, priors_key: the narrowest key of the trail that has priors, following aliases up to four times; null: the default.

    trails: listing_id, keys; priors: key; aliases: alias, target.
    """
    rows = trails.select("listing_id", F.posexplode("keys").alias("pos", "key"))
    for _ in range(hops):
        rows = rows.join(aliases, F.col("key") == F.col("alias"), "left").select("listing_id", "pos", F.coalesce("target", "key").alias("key"))
    hit = rows.join(priors.select("key").distinct(), "key").groupBy("listing_id").agg(F.min_by("key", "pos").alias("priors_key"))
    return trails.select("listing_id").join(hit, "listing_id", "left")
