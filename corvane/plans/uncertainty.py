"""Uncertainty scores, calibration, outside detection, selective prediction: their queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions import uncertainty as U
from corvane.operators import statistics as S
from corvane.plans.evaluation import rounded, sql_auroc
from corvane.session import table, written

# fixed values: factors of the corruptions by severity
NOISE = (0.04, 0.06, 0.08, 0.09, 0.10)
BLUR = (0.4, 0.6, 0.7, 0.8, 1.0)
CONTRAST = (0.75, 0.5, 0.4, 0.3, 0.15)
BRIGHTNESS = (0.05, 0.1, 0.15, 0.2, 0.3)
PIXELATE = (0.95, 0.9, 0.85, 0.75, 0.65)
CORRUPTIONS = {"gaussian_noise": NOISE, "gaussian_blur": BLUR, "contrast": CONTRAST, "brightness": BRIGHTNESS, "pixelate": PIXELATE}
PRIMARY = {"softmax": "msp", "ensemble": "mutual_information", "edl": "vacuity"}


def _sm(x: str) -> str:
    return f"list_transform({x}, lambda v: exp(v - list_max({x})) / list_sum(list_transform({x}, lambda u: exp(u - list_max({x})))))"


_ENTROPY = lambda p: f"(-list_sum(list_transform({p}, lambda v: greatest(least(v, 1.0), 1e-12) * ln(greatest(least(v, 1.0), 1e-12)))))"
# logits: six slices of ten dimensions, five times as wide; mean of the slices for the ensemble
BASE = f"""WITH v AS (SELECT vec_id, label, label >= 5 AS ood, CASE WHEN label >= 8 THEN 'far' WHEN label >= 5 THEN 'near' ELSE 'id' END AS part, list_transform(embedding, lambda x: 5 * x::DOUBLE) AS e FROM embeddings),
sl AS (SELECT vec_id, label, ood, part, list_transform(range(0, 6), lambda i: e[10 * i + 1:10 * i + 10]) AS logits FROM v),
sm AS (SELECT vec_id, label, ood, part, list_transform(logits, lambda x: {_sm('x')}) AS samples, list_transform(logits[1], lambda x: ln(1 + exp(x)) + 1) AS alpha FROM sl),
p AS (SELECT vec_id, label, ood, part, 'softmax' AS method, samples[1] AS probs, samples, alpha FROM sm UNION ALL SELECT vec_id, label, ood, part, 'ensemble', list_transform(range(1, 11), lambda k: list_sum(list_transform(samples, lambda s: s[k])) / 6), samples, alpha FROM sm UNION ALL SELECT vec_id, label, ood, part, 'edl', list_transform(alpha, lambda a: a / list_sum(alpha)), samples, alpha FROM sm),
q AS (SELECT vec_id, label, ood, part, method, probs, 1 - list_max(probs) AS msp, {_ENTROPY('probs')} AS entropy, CASE WHEN method = 'ensemble' THEN {_ENTROPY('probs')} - list_sum(list_transform(samples, lambda s: {_ENTROPY('s')})) / 6 END AS mutual_information, CASE WHEN method = 'edl' THEN len(alpha) / list_sum(alpha) END AS vacuity, list_position(probs, list_max(probs)) - 1 = label AS correct FROM p)"""


def predictions(spark, sf_dir):
    """method, vec_id, label, ood, part, probs, msp, entropy, mutual_information, vacuity, correct.

    Vectors stand in for network outputs: six slices of ten logits are six samples; labels from 5 are outside.
    """
    wide = F.transform("embedding", lambda x: x.cast("double") * 5)
    slices = F.array(*[F.slice("_e", 10 * i + 1, 10) for i in range(6)])
    part = F.when(F.col("label") >= 8, "far").when(F.col("label") >= 5, "near").otherwise("id")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("label") >= 5).alias("ood"), part.alias("part"), wide.alias("_e"))
    rows = rows.withColumn("_s", F.transform(slices, U.softmax)).withColumn("_a", U.dirichlet_alpha(F.slice("_e", 1, 10))).drop("_e")
    none = F.lit(None).cast("double")
    kinds = {
        "softmax": (F.get("_s", F.lit(0)), none, none),
        "ensemble": (U.mean_probs(F.col("_s")), U.mutual_information(F.col("_s")), none),
        "edl": (U.dirichlet_mean(F.col("_a")), none, U.vacuity(F.col("_a"))),
    }
    three = F.array(*[F.struct(F.lit(m).alias("method"), p.alias("probs"), mi.alias("mutual_information"), v.alias("vacuity")) for m, (p, mi, v) in kinds.items()])
    out = rows.select("vec_id", "label", "ood", "part", F.inline(three))
    return out.withColumn("msp", U.msp(F.col("probs"))).withColumn("entropy", U.entropy(F.col("probs"))).withColumn("correct", U.argmax(F.col("probs")) == F.col("label"))


def _score(key: str, method: str, name: str):
    @query(key, f"{BASE} SELECT vec_id, round({name}, 9) AS {name} FROM q WHERE method = '{method}'")
    def run(spark, sf_dir):
        return rounded(predictions(spark, sf_dir).where(F.col("method") == method).select("vec_id", name), [name])

    return run


for _key, _method in (("msp", "softmax"), ("entropy", "softmax"), ("mutual_information", "ensemble"), ("vacuity", "edl")):
    _score(_key, _method, _key)


def _scores_from(key: str, method: str, names: list[str]):
    cut = ", ".join(f"round({n}, 9) AS {n}" for n in names)

    @query(key, f"{BASE} SELECT vec_id, round(probs[1], 9) AS first_prob, {cut} FROM q WHERE method = '{method}'")
    def run(spark, sf_dir):
        rows = predictions(spark, sf_dir).where(F.col("method") == method)
        return rounded(rows.select("vec_id", F.get("probs", F.lit(0)).alias("first_prob"), *names), ["first_prob", *names])

    return run


_scores_from("scores_from_probs", "softmax", ["msp", "entropy"])
_scores_from("scores_from_samples", "ensemble", ["msp", "entropy", "mutual_information"])
_scores_from("scores_from_alpha", "edl", ["msp", "entropy", "vacuity"])


@query("softmax", f"{BASE} SELECT vec_id, round(list_sum(probs), 9) AS total, round(probs[3], 9) AS third FROM q WHERE method = 'softmax'")
def softmax(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("method = 'softmax'")
    return rounded(rows.select("vec_id", U.total(F.col("probs")).alias("total"), F.get("probs", F.lit(2)).alias("third")), ["total", "third"])


@query("dirichlet_alpha", f"{BASE} SELECT vec_id, round(list_sum(alpha), 9) AS strength FROM sm")
def dirichlet_alpha(spark, sf_dir):
    alpha = U.dirichlet_alpha(F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 5))
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", U.total(alpha).alias("strength")), ["strength"])


_EDGES = "[" + ", ".join(repr(i / 15) for i in range(1, 15)) + "]"
_BIN = f"len(list_filter({_EDGES}, lambda e: list_max(probs) > e))"
_ONE = "CASE WHEN k - 1 = label THEN 1 ELSE 0 END"
_BRIER = "list_sum(list_transform(probs, lambda v, k: (v - CASE WHEN k - 1 = label THEN 1 ELSE 0 END) ** 2))"
_NLL = "-ln(greatest(least(probs[label + 1], 1.0), 1e-12))"


def calibration(rows, by):
    """by, accuracy, nll, ece, brier."""
    conf, label = F.array_max("probs"), F.col("label")
    marked = rows.select(*by, "correct", conf.alias("_conf"), U.confidence_bin(F.col("probs")).alias("_bin"), U.brier(F.col("probs"), label).alias("_brier"), U.nll(F.col("probs"), label).alias("_nll"))
    sums = lambda c: F.sum(F.col(c).cast("double")).alias(c)
    bins = marked.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"), sums("correct"), sums("_conf"), sums("_brier"), sums("_nll"))
    n = F.sum("_n")
    return bins.groupBy(*by).agg((F.sum("correct") / n).alias("accuracy"), (F.sum("_nll") / n).alias("nll"), (F.sum(F.abs(F.col("correct") - F.col("_conf"))) / n).alias("ece"), (F.sum("_brier") / n).alias("brier"))


CALIBRATION = f"cal0 AS (SELECT method, {_BIN} AS bin, count(*) AS n, sum(correct::INT) AS c, sum(list_max(probs)) AS conf, sum({_BRIER}) AS b, sum({_NLL}) AS l FROM q WHERE NOT ood GROUP BY ALL), cal AS (SELECT method, sum(c) / sum(n) AS accuracy, sum(l) / sum(n) AS nll, sum(abs(c - conf)) / sum(n) AS ece, sum(b) / sum(n) AS brier FROM cal0 GROUP BY method)"


@query("calibration_metrics", f"{BASE}, {CALIBRATION} SELECT method, round(accuracy, 9) AS accuracy, round(nll, 9) AS nll, round(ece, 9) AS ece, round(brier, 9) AS brier FROM cal")
def calibration_metrics(spark, sf_dir):
    return rounded(calibration(predictions(spark, sf_dir).where("not ood"), ["method"]), ["accuracy", "nll", "ece", "brier"])


def _calibration(name: str):
    @query(name, f"{BASE}, {CALIBRATION} SELECT method, round({name}, 9) AS {name} FROM cal")
    def run(spark, sf_dir):
        return rounded(calibration(predictions(spark, sf_dir).where("not ood"), ["method"]).select("method", name), [name])

    return run


for _name in ("ece", "brier", "nll", "accuracy"):
    _calibration(_name)


@query(
    "reliability",
    f"{BASE}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(list_max(probs)) AS confidence, avg(correct::INT) AS accuracy FROM q WHERE method = 'softmax' AND NOT ood GROUP BY ALL) SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, round(confidence, 9) AS confidence, round(accuracy, 9) AS accuracy FROM range(0, 15) AS r(bin) LEFT JOIN b ON b.bin = r.bin",
)
def reliability(spark, sf_dir):
    """Fifteen bins of confidence, empty ones too."""
    rows = predictions(spark, sf_dir).where("method = 'softmax' and not ood")
    binned = rows.groupBy(U.confidence_bin(F.col("probs")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_max("probs")).alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    every = spark.range(15).select(F.col("id").cast("int").alias("bin"))
    return rounded(every.join(binned, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")), ["confidence", "accuracy"])


def sql_ap(source: str, score: str, positive: str, by: str, name: str) -> str:
    return f"""SELECT {by}, sum(pos * cp / (cp + cn)) / nullif(sum(pos), 0) AS {name} FROM (SELECT {by}, pos, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM (SELECT {by}, {score} AS s, count(*) FILTER (WHERE {positive}) AS pos, count(*) FILTER (WHERE NOT ({positive})) AS neg FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY {by} ORDER BY s DESC)) GROUP BY {by}"""


def sql_fpr(source: str, score: str, by: str) -> str:
    return f"""SELECT o.{by}, avg((o.{score} <= lim)::INT) AS fpr95 FROM {source} o JOIN (SELECT {by}, min(s) AS lim FROM (SELECT {by}, {score} AS s, row_number() OVER (PARTITION BY {by} ORDER BY {score}) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE NOT ood) WHERE rn >= ceil(0.95 * (n - 1)) + 1 GROUP BY {by}) l ON l.{by} = o.{by} WHERE ood GROUP BY o.{by}"""


def sql_ood(source: str, score: str, by: str, name: str) -> str:
    """CTEs that end in ``name`` (by, auroc, aupr_in, aupr_out, fpr95)."""
    return f"""{name}_a AS ({sql_auroc(source, score, 'ood', by)}), {name}_i AS ({sql_ap(source, f'(-{score})', 'NOT ood', by, 'aupr_in')}), {name}_o AS ({sql_ap(source, score, 'ood', by, 'aupr_out')}), {name}_f AS ({sql_fpr(source, score, by)}),
{name} AS (SELECT {by}, round(auroc, 9) AS auroc, round(aupr_in, 9) AS aupr_in, round(aupr_out, 9) AS aupr_out, round(fpr95, 9) AS fpr95 FROM {name}_a LEFT JOIN {name}_i USING ({by}) LEFT JOIN {name}_o USING ({by}) LEFT JOIN {name}_f USING ({by}))"""


OOD = ["auroc", "aupr_in", "aupr_out", "fpr95"]


@query("ood_metrics", f"{BASE}, {sql_ood('q', 'msp', 'method', 'm')} SELECT * FROM m")
def ood_metrics(spark, sf_dir):
    return rounded(S.ood_metrics(predictions(spark, sf_dir), ["method"], "msp", F.col("ood")), OOD)


def _ood(key: str, name: str):
    @query(key, f"{BASE}, {sql_ood('q', 'msp', 'method', 'm')} SELECT method, {name} FROM m")
    def run(spark, sf_dir):
        rows, ood = predictions(spark, sf_dir), F.col("ood")
        kinds = {
            "auroc": lambda: S.auroc(rows, ["method"], F.col("msp"), ood),
            "aupr_in": lambda: S.average_precision(rows, ["method"], -F.col("msp"), ~ood, "aupr_in"),
            "aupr_out": lambda: S.average_precision(rows, ["method"], F.col("msp"), ood, "aupr_out"),
            "fpr95": lambda: S.fpr_at_tpr(rows, ["method"], "msp", ood),
        }
        return rounded(kinds[name](), [name])

    return run


for _key, _name in (("ood_auroc", "auroc"), ("aupr_in", "aupr_in"), ("aupr_out", "aupr_out"), ("fpr95", "fpr95")):
    _ood(_key, _name)


_POINTS = "[" + ", ".join(f"{i / 19!r}::DOUBLE" for i in range(20)) + "]"


@query(
    "roc_curve",
    f"{BASE}, s AS (SELECT msp, ood FROM q WHERE method = 'softmax'), t AS (SELECT unnest(range(0, 20)) AS point, unnest(list_reverse(quantile_cont(msp, {_POINTS}))) AS threshold FROM s) SELECT CAST(point AS INTEGER) AS point, round(threshold, 9) AS threshold, round(avg((msp >= threshold)::INT) FILTER (WHERE NOT ood), 6) AS fpr, round(avg((msp >= threshold)::INT) FILTER (WHERE ood), 6) AS tpr FROM t CROSS JOIN s WHERE point NOT IN (0, 19) GROUP BY ALL",
)
def roc_curve(spark, sf_dir):
    """Without the ends, where a threshold meets a single score."""
    rows = predictions(spark, sf_dir).where("method = 'softmax'")
    curve = S.roc_curve(rows, F.col("msp"), F.col("ood"), 20).where("point not in (0, 19)")
    return curve.select(F.col("point").cast("int").alias("point"), F.round("threshold", 9).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


def by_primary(rows):
    """``rows`` with the score that each method is judged by."""
    score = F.lit(None).cast("double")
    for method, name in PRIMARY.items():
        score = F.when(F.col("method") == method, F.col(name)).otherwise(score)
    return rows.withColumn("score", score)


_PRIMARY = "CASE method WHEN 'softmax' THEN msp WHEN 'ensemble' THEN mutual_information ELSE vacuity END"
_CURVE = "c0 AS (SELECT method, vec_id, correct, row_number() OVER w AS n, sum((NOT correct)::INT) OVER w / row_number() OVER w AS risk, count(*) OVER (PARTITION BY method) AS total FROM q WHERE NOT ood WINDOW w AS (PARTITION BY method ORDER BY msp, vec_id ROWS UNBOUNDED PRECEDING)), c AS (SELECT *, n / total AS coverage FROM c0)"


def curve(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("not ood")
    return S.risk_coverage(rows, ["method"], "msp", F.col("correct"), "vec_id")


@query("risk_coverage", f"{BASE}, {_CURVE} SELECT method, CAST(n AS BIGINT) AS n, round(coverage, 9) AS coverage, round(risk, 9) AS risk FROM c")
def risk_coverage(spark, sf_dir):
    return rounded(curve(spark, sf_dir).select("method", F.col("n").cast("long").alias("n"), "coverage", "risk"), ["coverage", "risk"])


@query("aurc", f"{BASE}, {_CURVE} SELECT method, round(avg(risk), 9) AS aurc FROM c GROUP BY method")
def aurc(spark, sf_dir):
    return rounded(S.selective(curve(spark, sf_dir), ["method"]).select("method", "aurc"), ["aurc"])


_ACC = lambda c: f"round(max(1 - risk) FILTER (WHERE n = greatest(1, least(total, ceil(total * {c})))), 9) AS acc_at_{round(100 * c)}"


@query("accuracy_at_coverage", f"{BASE}, {_CURVE} SELECT method, {_ACC(0.8)}, {_ACC(0.9)} FROM c GROUP BY method")
def accuracy_at_coverage(spark, sf_dir):
    return rounded(S.selective(curve(spark, sf_dir), ["method"]).drop("aurc"), ["acc_at_80", "acc_at_90"])


@query("selective", f"{BASE}, {_CURVE} SELECT method, 'msp' AS score, round(avg(risk), 9) AS aurc, {_ACC(0.8)}, {_ACC(0.9)}, round(avg(correct::INT), 9) AS acc_at_100 FROM c GROUP BY method")
def selective(spark, sf_dir):
    rows = S.selective(curve(spark, sf_dir), ["method"], (0.8, 0.9, 1.0)).withColumn("score", F.lit("msp"))
    return rounded(rows, ["aurc", "acc_at_80", "acc_at_90", "acc_at_100"])


_HEAD = f"{BASE}, {CALIBRATION}, {_CURVE}, pr AS (SELECT *, {_PRIMARY} AS score FROM q), nr AS (SELECT * FROM pr WHERE part <> 'far'), fr AS (SELECT * FROM pr WHERE part <> 'near'), {sql_ood('nr', 'score', 'method', 'near')}, {sql_ood('fr', 'score', 'method', 'far')}"


def head(spark, sf_dir):
    rows = by_primary(predictions(spark, sf_dir))
    out = calibration(rows.where("not ood"), ["method"])
    for part, other in (("near", "far"), ("far", "near")):
        m = S.ood_metrics(rows.where(F.col("part") != other), ["method"], "score", F.col("ood"))
        out = out.join(m.select("method", *[F.col(c).alias(f"{part}_{c}") for c in OOD]), "method")
    return out.join(S.selective(curve(spark, sf_dir), ["method"]).select("method", "aurc"), "method")


@query(
    "headline",
    f"{_HEAD} SELECT method, {', '.join(f'round(cal.{n}, 9) AS {n}' for n in ('accuracy', 'nll', 'ece', 'brier'))}, {', '.join(f'{p}.{n} AS {p}_{n}' for p in ('near', 'far') for n in OOD)}, a.aurc FROM cal JOIN near USING (method) JOIN far USING (method) JOIN (SELECT method, round(avg(risk), 9) AS aurc FROM c GROUP BY method) a USING (method)",
)
def headline(spark, sf_dir):
    rows = head(spark, sf_dir)
    return rounded(rows, [c for c in rows.columns if c != "method"])


@query("near_far", f"{_HEAD} SELECT method, far.auroc AS far_auroc, near.auroc AS near_auroc, round(far.auroc - near.auroc, 6) AS gap FROM near JOIN far USING (method)")
def near_far(spark, sf_dir):
    rows = rounded(head(spark, sf_dir).select("method", "far_auroc", "near_auroc"), ["far_auroc", "near_auroc"])
    return rows.withColumn("gap", F.round(F.col("far_auroc") - F.col("near_auroc"), 6))


_LONG = "lg AS (SELECT concat(method, '/', s, '/', p.part) AS key, ood, v FROM (SELECT method, part, ood, unnest(['msp', 'entropy', 'mutual_information', 'vacuity']) AS s, unnest([msp, entropy, mutual_information, vacuity]) AS v FROM q) x JOIN (VALUES ('near', 'far'), ('far', 'near')) AS p(part, other) ON x.part <> p.other WHERE v IS NOT NULL)"


@query("all_scores", f"{BASE}, {_LONG}, {sql_ood('lg', 'v', 'key', 'm')} SELECT * FROM m")
def all_scores(spark, sf_dir):
    """Every score of every method against either outside set (key: method/score/set)."""
    long = predictions(spark, sf_dir).unpivot(["method", "part", "ood"], ["msp", "entropy", "mutual_information", "vacuity"], "_name", "v").where("v is not null")
    sets = F.explode(F.when(F.col("part") == "id", F.array(F.lit("near"), F.lit("far"))).otherwise(F.array("part")))
    keyed = long.withColumn("_set", sets).withColumn("key", F.concat_ws("/", "method", "_name", "_set"))
    return rounded(S.ood_metrics(keyed, ["key"], "v", F.col("ood")), OOD)


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


#: Vectors stand in for images: one channel of eight by eight pixels, moved to about the middle of 0 to 1.
SHAPE = (1, 8, 8)
_PIXELS = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE + 0.5) AS e FROM embeddings"
_MATRIX = lambda m: "[" + ", ".join("[" + ", ".join(map(repr, row)) + "]" for row in m.tolist()) + "]::DOUBLE[][]"
_LEVELS = "(VALUES " + ", ".join(f"('{kind}', {i}, {p}::DOUBLE, {_MATRIX(how(8, p)) if how else 'NULL'})" for kind, (values, how) in {"gaussian_noise": (NOISE, None), "gaussian_blur": (BLUR, U.blur_weights), "contrast": (CONTRAST, None), "brightness": (BRIGHTNESS, None), "pixelate": (PIXELATE, U.box_weights)}.items() for i, p in enumerate(values, 1)) + ") AS l(kind, severity, f, m)"
_DRAW = "lambda x, i: " + _clamp("x + f * sqrt(-2 * ln((('0x' || left(md5(concat('0:', vec_id, ':', i - 1)), 8))::BIGINT + 1)::DOUBLE / 4294967297::DOUBLE)) * cos(2 * pi() * ('0x' || substr(md5(concat('0:', vec_id, ':', i - 1)), 9, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE)")
_ACROSS = "list_transform(range(0, 64), lambda i: list_dot_product(m[i % 8 + 1], e[i // 8 * 8 + 1:i // 8 * 8 + 8]))"
_DOWN = f"list_transform(range(0, 64), lambda i: {_clamp('list_dot_product(m[i // 8 + 1], list_transform(range(0, 8), lambda a: h[a * 8 + i % 8 + 1]))')})"
_CHANGED = f"""v AS ({_PIXELS}), w AS (SELECT *, {_ACROSS} AS h FROM v, {_LEVELS}),
x AS (SELECT vec_id, label, kind, severity, CASE kind WHEN 'gaussian_noise' THEN list_transform(e, {_DRAW})
WHEN 'contrast' THEN list_transform(e, lambda x: {_clamp('(x - list_sum(e) / len(e)) * f + list_sum(e) / len(e)')}) WHEN 'brightness' THEN list_transform(e, lambda x: {_clamp('x + f')}) ELSE {_DOWN} END AS e FROM w)"""
#: What stands for a changed vector in the queries: the sum of its pixels, and of pixels times their place.
_SUMS = "round(list_sum(e), 6) AS total, round(list_sum(list_transform(e, lambda x, i: x * i)), 4) AS placed"


def _corrupt(kind: str):
    def run(spark, sf_dir):
        rows = corrupted(spark, sf_dir).where(F.col("kind") == kind)
        placed = U.total(F.transform("e", lambda x, i: x * (i + 1)))
        return rows.select("vec_id", F.col("severity").cast("long").alias("severity"), F.round(U.total(F.col("e")), 6).alias("total"), F.round(placed, 4).alias("placed"))

    return run


for _kind in ("gaussian_noise", "gaussian_blur", "contrast", "brightness", "pixelate"):
    query(f"corrupt_{_kind.removeprefix('gaussian_')}", f"WITH {_CHANGED} SELECT vec_id, CAST(severity AS BIGINT) AS severity, {_SUMS} FROM x WHERE kind = '{_kind}'")(_corrupt(_kind))


def pixels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") + 0.5).alias("e"))


def corrupted(spark, sf_dir):
    """vec_id, label, kind, severity, e: whole vectors under each corruption."""
    return U.corrupted(pixels(spark, sf_dir), "vec_id", "e", SHAPE, CORRUPTIONS)


_COR = f"""WITH {_CHANGED.replace('AS e FROM w)', "AS e FROM w UNION ALL SELECT vec_id, label, 'none', 0, e FROM v)")},
s AS (SELECT vec_id, label, kind, severity, list_transform(e[1:10], lambda u: 5 * u) AS l FROM x), q AS (SELECT *, {_sm('l')} AS probs FROM s),
r AS (SELECT *, 1 - list_max(probs) AS unc, list_position(probs, list_max(probs)) - 1 = label AS correct, {_BIN} AS bin FROM q),
b AS (SELECT kind, severity, bin, count(*) AS n, sum(correct::INT) AS c, sum(list_max(probs)) AS conf, sum(unc) AS u FROM r GROUP BY ALL),
m AS (SELECT kind, severity, sum(c) / sum(n) AS accuracy, sum(abs(c - conf)) / sum(n) AS ece, sum(u) / sum(n) AS uncertainty FROM b GROUP BY ALL),
k AS (SELECT DISTINCT kind, severity FROM r WHERE kind <> 'none'),
z AS (SELECT concat(k.kind, '/', k.severity) AS key, r.kind <> 'none' AS ood, round(unc, 9) AS unc FROM k JOIN r ON (r.kind = k.kind AND r.severity = k.severity) OR r.kind = 'none'),
a AS ({sql_auroc('z', 'unc', 'ood', 'key')}),
corr AS (SELECT kind, CAST(m.severity AS INTEGER) AS severity, accuracy, ece, uncertainty, coalesce(auroc, 0.5) AS shift_auroc FROM m LEFT JOIN a ON a.key = concat(kind, '/', m.severity))"""
_SHIFT = ("accuracy", "ece", "uncertainty", "shift_auroc")


def corruption_rows(spark, sf_dir):
    """Ten classes are read from the first ten pixels."""
    plain = pixels(spark, sf_dir).withColumns({"kind": F.lit("none"), "severity": F.lit(0)})
    rows = plain.unionByName(corrupted(spark, sf_dir)).withColumn("probs", U.softmax(F.transform(F.slice("e", 1, 10), lambda x: x * 5)))
    rows = written(rows.drop("e"), "corrupted-predictions")
    rows = rows.withColumn("unc", U.msp(F.col("probs"))).withColumn("correct", U.argmax(F.col("probs")) == F.col("label"))
    out = calibration(rows, ["kind", "severity"]).select("kind", "severity", "accuracy", "ece").join(rows.groupBy("kind", "severity").agg(F.avg("unc").alias("uncertainty")), ["kind", "severity"])
    # the clean rows stand beside those of each corruption and severity
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("severity")) for k in CORRUPTIONS for i in range(1, 6)]))
    clean = rows.where("severity = 0").select("unc", every.alias("_k")).select("_k.*", "unc", F.lit(False).alias("shifted"))
    both = clean.unionByName(rows.where("severity > 0").select("kind", "severity", "unc", F.lit(True).alias("shifted")))
    shift = S.auroc(both, ["kind", "severity"], F.round("unc", 9), F.col("shifted"))
    return out.join(shift.withColumnRenamed("auroc", "shift_auroc"), ["kind", "severity"], "left").withColumn("shift_auroc", F.coalesce("shift_auroc", F.lit(0.5)))


@query("corruption", f"{_COR} SELECT kind, severity, {', '.join(f'round({n}, 9) AS {n}' for n in _SHIFT)} FROM corr")
def corruption(spark, sf_dir):
    return rounded(corruption_rows(spark, sf_dir), list(_SHIFT))


@query("by_severity", f"{_COR} SELECT severity, {', '.join(f'round(avg({n}), 9) AS {n}' for n in _SHIFT)} FROM corr GROUP BY severity")
def by_severity(spark, sf_dir):
    return rounded(corruption_rows(spark, sf_dir).groupBy("severity").agg(*[F.avg(n).alias(n) for n in _SHIFT]), list(_SHIFT))


_EVIDENCE = "SELECT vec_id, label, list_transform(embedding[1:10], lambda x: ln(1 + exp(5 * x::DOUBLE)) + 1) AS a FROM embeddings"


def evidence(spark, sf_dir):
    e = F.transform(F.slice("embedding", 1, 10), lambda x: F.log1p(F.exp(x.cast("double") * 5)))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", e.alias("evidence"))


_HOT = "CASE WHEN k - 1 = label THEN 1 ELSE 0 END"


@query("edl_fit_mse", f"WITH v AS ({_EVIDENCE}) SELECT vec_id, round(list_sum(list_transform(a, lambda x, k: ({_HOT} - x / list_sum(a)) ** 2 + x / list_sum(a) * (1 - x / list_sum(a)) / (list_sum(a) + 1))), 9) AS fit FROM v")
def edl_fit_mse(spark, sf_dir):
    return evidence(spark, sf_dir).select("vec_id", F.round(U.edl_fit(F.col("evidence"), F.col("label"), "mse"), 9).alias("fit"))


@query("edl_fit_log", f"WITH v AS ({_EVIDENCE}) SELECT vec_id, round(ln(list_sum(a)) - ln(a[label + 1]), 9) AS fit FROM v")
def edl_fit_log(spark, sf_dir):
    return evidence(spark, sf_dir).select("vec_id", F.round(U.edl_fit(F.col("evidence"), F.col("label"), "log"), 9).alias("fit"))


@query("edl_loss_digamma")
def edl_loss_digamma(spark, sf_dir):
    """The whole evidential loss; SQL has no digamma."""
    return evidence(spark, sf_dir).select("vec_id", U.edl_loss_udf()("evidence", "label", F.lit(5)).alias("loss"))


@query("backoff_schedule", "SELECT event_id, event_id % 8 AS attempt, least(60.0, greatest(2.0, 2 * 2.0 ** (event_id % 8))) AS rate_limit, least(30.0, 3 * 2.0 ** (event_id % 8)) AS server FROM events WHERE event_type = 'error'")
def backoff_schedule(spark, sf_dir):
    """Seconds to wait before each further attempt (errors among the events, in one of eight attempts)."""
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", (F.col("event_id") % 8).alias("attempt"))
    power = F.pow(F.lit(2.0), F.col("attempt"))
    return errors.select("event_id", "attempt", F.least(F.lit(60.0), F.greatest(F.lit(2.0), 2 * power)).alias("rate_limit"), F.least(F.lit(30.0), 3 * power).alias("server"))
