"""Personal data by candidate boosting.

Generators propose spans: four exact patterns whose checked matches are always
redacted, and two wide ones for near formats.  Gradient-boosted trees score
the wide proposals from format and context features; they learn from checked
matches rewritten in forms that the exact patterns miss (positives) and from
the wide proposals that overlap no checked match.  These are unlabelled: some
are the near forms sought.  A first fit takes them all as negatives; those it
scores like known forms are then set aside, and the second fit and the
thresholds use the others.  Every proposal counts: distinct ones (with context)
are weighted by their number, half of them fit the trees, half calibrate.  Per
kind, the threshold is the lowest at which the calibration half reaches the
wanted precision.

DataFrame functions only; spans come from a pattern's matches and the lengths
of the pieces between them.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import numbered_once
from corvid.llm.decontaminate import let

KINDS = ["email", "ip", "card", "phone"]
#: The exact patterns.  Look-behinds and possessive loops keep them linear; the matches are the leftmost ones all the same.
EXACT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {"at": r"(?<![^\s@])[^\s@]++@[^\s@]++", "digits": r"[0-9](?:[\x20().+/-]{0,2}+[0-9])++"}
#: Wanted precision, and trees.
PRECISION, TREES = 0.99, 10
#: Share of the known forms that the first fit may score below an unlabelled proposal that is set aside.
ALIKE = 0.01
CONTEXT = 16


def _proposals(pattern: str, name: str, trigger: Column) -> Column:
    """Array of (gen, k, gap, match, before, after): the matches, with the length of the text since the last one."""
    pieces, found = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    rows = let(pieces, lambda p: F.transform(found, lambda m, k: F.struct(
        F.lit(name).alias("gen"), k.alias("k"), F.length(F.element_at(p, k + 1)).alias("gap"), m.alias("match"),
        F.right(F.element_at(p, k + 1), F.lit(CONTEXT)).alias("before"), F.left(F.element_at(p, k + 2), F.lit(CONTEXT)).alias("after"))))
    return F.when(trigger, rows).otherwise(F.array().cast("array<struct<gen:string,k:int,gap:int,match:string,before:string,after:string>>"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the check?"""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    doubled = F.transform(d, lambda x, k: F.when(k % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def _checked(kind: Column, match: Column) -> Column:
    n = F.length(_digits(match))
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    return (F.when(kind == "email", True).when(kind == "ip", small)
            .when(kind == "card", F.when(n.between(14, 19), luhn(_digits(match))).otherwise(False))
            .when(kind == "phone", n.between(10, 15)).otherwise(False))


def _kind() -> Column:
    """The kind of a proposal, from its generator and match."""
    dotted = F.col("match").rlike(r"^[0-9]+(\.[0-9]+){3}$")
    return (F.when(F.col("gen") == "at", "email").when(F.col("gen") != "digits", F.col("gen")).when(dotted, "ip")
            .when(F.length(_digits(F.col("match"))) >= 13, "card").otherwise("phone"))


def proposals(texts: DataFrame) -> DataFrame:
    """(row, gen, kind, start, end, match, before, after, base) of (row, text); base: a checked match of an exact pattern."""
    digit = F.col("text").rlike("[0-9][^0-9]{0,2}[0-9]")
    triggers = {"email": F.contains("text", F.lit("@")), "at": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")),
                "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": digit, "digits": digit}
    all_ = F.concat(*[_proposals(p, g, triggers[g]) for g, p in (EXACT | WIDE).items()])
    rows = texts.select("row", F.explode_outer(all_).alias("p")).where("p is not null").select("row", "p.*")
    size = F.length("match")
    to_here = Window.partitionBy("row", "gen").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + size).over(to_here)
    return (rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - size).withColumn("kind", _kind())
            .withColumn("base", F.col("gen").isin(*EXACT) & _checked(F.col("kind"), F.col("match")))
            .where(F.col("base") | F.col("gen").isin(*WIDE)).where(F.col("base") | (F.col("gen") == "at") | (F.length(_digits(F.col("match"))) >= 7))
            .select("row", "gen", "kind", "start", "end", "match", "before", "after", "base"))


def featured(spans: DataFrame) -> DataFrame:
    """Adds the format and context features, as columns f0, f1, ...; none tells an exact match apart."""
    m, before, after = F.col("match"), F.lower("before"), F.lower("after")
    count = lambda cls: F.length(m) - F.length(F.regexp_replace(m, cls, ""))
    d = _digits(m)
    found = [F.length(m), F.length(d), count(r"[\x20]"), count("-"), count(r"\."), count("[()]"), count("[A-Za-z]"), count("[^A-Za-z0-9@._%+-]"),
             F.when((F.col("kind") == "card") & (F.length(d) <= 19), luhn(d)).otherwise(False), F.size(F.split(m, "[^0-9]+")),
             *[F.col("kind") == k for k in KINDS], before.rlike(r"[\p{L}0-9]$"), before.rlike(r"[\x22'=]\s*$"),
             after.rlike(r"^[\p{L}0-9]"), after.rlike(r"^[\x22']"),
             before.rlike("tel|phone|call|fax|mobil"), before.rlike("card|visa|credit|iban"), before.rlike("mail|contact"), before.rlike("ip|host|addr")]
    return spans.select("*", *[f.cast("double").alias(f"f{k}") for k, f in enumerate(found)])


def _features(spans: DataFrame) -> list[str]:
    return [c for c in spans.columns if c.startswith("f") and c[1:].isdigit()]


def _scored(spans: DataFrame, model) -> DataFrame:
    vectors = VectorAssembler(inputCols=_features(spans), outputCol="x").transform(spans)
    return model.transform(vectors).withColumn("p", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def _bins(n: int) -> int:
    """Bins with which MLlib takes the cuts of ``n`` rows from all of them: it reads at most the square of the bins, and 10,000 at least."""
    return min(max(32, math.isqrt(max(n - 1, 0)) + 1), 46_000)


def _boosted(part: DataFrame, trees: int):
    fit = VectorAssembler(inputCols=_features(part), outputCol="x").transform(part.withColumn("label", F.col("y").cast("double")))
    return GBTClassifier(featuresCol="x", labelCol="label", weightCol="w", maxIter=trees, maxDepth=4, maxBins=_bins(part.count()), seed=7,
                         checkpointInterval=-1).fit(fit.select("x", "label", "w"))


def near_forms(checked: DataFrame) -> DataFrame:
    """Checked matches, each in one form that the exact patterns miss: what the trees learn to find.

    Phones lose their plus sign and get 00, other separators or no country
    code; cards get other separators or 13 digits; mail domains lose their
    dots or get a letter beyond ASCII.  An ip has no other form.
    """
    m, d = F.regexp_replace("match", r"^\+", ""), _digits(F.col("match"))
    apart = lambda sep: F.regexp_replace(m, "[^0-9]+", sep)
    short = F.concat(F.left(d, F.lit(12)), F.element_at(F.filter(F.array(*map(F.lit, "0123456789")), lambda c: luhn(F.concat(F.left(d, F.lit(12)), c))), 1))
    forms = {"phone": [m, F.concat(F.lit("00"), m), apart("-"), apart("/"), F.regexp_replace(m, r"^[0-9]{1,3}[^0-9]+", "")],
             "card": [apart("/"), apart("  "), apart(" -"), short, short],
             "email": [F.regexp_replace(m, r"(@[A-Za-z0-9-]++)\..*", "$1")] * 2 + [F.regexp_replace(m, "@(.)", "@$1ü")] * 3}
    pick = F.pmod(F.xxhash64(F.lit(1), "match", "before", "after"), F.lit(5)).cast("int")
    form = F.coalesce(*[F.when(F.col("kind") == k, F.element_at(F.array(*v), pick + 1)) for k, v in forms.items()])
    gen = F.when(F.col("kind") == "email", "at").otherwise("digits")
    out = checked.where(F.col("kind") != "ip").select("before", "after", gen.alias("gen"), form.alias("match"))
    return out.where((F.col("gen") == "at") | (F.length(_digits(F.col("match"))) >= 7)).withColumn("kind", _kind())


def _fit(wide: DataFrame, known: DataFrame, trees: int, precision: float):
    """(model, {kind: threshold}) from wide proposals and known forms, or None if one is missing.

    All distinct proposals (with context) of both take part, weighted by
    their number; by their hash, half fit the trees, half calibrate.
    """
    part = None
    for y, spans in enumerate((wide, known)):
        forms = spans.groupBy("kind", "match", "before", "after").agg(F.count("*").alias("w"))
        forms = forms.withColumn("h", F.xxhash64("match", "before", "after")).withColumn("y", F.lit(y))
        part = forms if part is None else part.unionAll(forms)
    part = featured(part).withColumn("half", F.pmod("h", F.lit(2))).checkpoint()
    seen = {(r["half"], r["y"]) for r in part.select("half", "y").distinct().collect()}
    if len(seen) < 4:
        return None
    # Unlabelled proposals that score like known forms are no negatives.
    scored = _scored(part, _boosted(part.where("half = 0"), trees))
    low = {r["kind"]: r["p"] for r in scored.where("y = 1").groupBy("kind").agg(F.expr(f"percentile_disc({ALIKE}) WITHIN GROUP (ORDER BY p)").alias("p")).collect()}
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in low.items()], F.lit(2.0))
    sure = scored.where((F.col("y") == 1) | (F.col("p") < least)).drop("p").checkpoint()
    if {(r["half"], r["y"]) for r in sure.select("half", "y").distinct().collect()} != seen:
        return None
    model = _boosted(sure.where("half = 0"), trees)
    bins = (_scored(sure.where("half = 1"), model).groupBy("kind", F.floor(F.col("p") * 100).cast("int").alias("bin"))
            .agg(F.sum(F.col("y") * F.col("w")).alias("hit"), F.sum("w").alias("n")).collect())
    cut = {}
    for kind in KINDS:
        hit = n = 0
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            hit, n = hit + r["hit"], n + r["n"]
            if hit < precision * n:
                break
            cut[kind] = r["bin"] / 100
    return model, {k: max(v, 0.5) for k, v in cut.items()}


def first_of_overlaps(spans: DataFrame) -> DataFrame:
    """(row, kind, start, end) of spans that overlap no earlier one that stays; each run of overlapping spans on its own."""
    order = Window.partitionBy("row").orderBy("start", "end", "gen")
    new = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    run = F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    take = lambda kept, s: F.when(F.coalesce(F.try_element_at(kept, F.lit(-1))["end"] <= s["start"], F.lit(True)), F.concat(kept, F.array(s))).otherwise(kept)
    none = F.array().cast("array<struct<start:bigint,end:bigint,gen:string,kind:string>>")
    return (spans.withColumn("new", new).withColumn("run", run).groupBy("row", "run")
            .agg(F.sort_array(F.collect_list(F.struct("start", "end", "gen", "kind"))).alias("all"))
            .select("row", F.explode(F.aggregate("all", none, take)).alias("s")).select("row", "s.kind", "s.start", "s.end"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
             trees: int = TREES, precision: float = PRECISION) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns one row per input row: (row_col,) the id, n_email, n_ip, n_card
    and n_phone (checked matches of the exact patterns), base_sha256 (of those
    matches as kind:start:end, ordered by start and kind, comma-joined; code
    points, end exclusive) and spans, the same list with what the trees add.
    An addition never overlaps a checked match; of additions that overlap, the
    first stays.  NULL and empty texts have no spans; NULL and repeated ids and
    repeated rows are rows of their own; without both labels in each half
    nothing is added; an empty table gives no row; other columns are dropped.
    """
    rows = numbered_once(docs, id_col, text_col, row_col)
    found = proposals(rows.select("row", "text")).checkpoint()
    # Overlap with a checked match: the farthest end before, and the nearest start behind.
    ahead = Window.partitionBy("row").orderBy("start", "end", "gen").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("gen")).rowsBetween(Window.unboundedPreceding, -1)
    near = (found.withColumn("last", F.max(F.when(F.col("base"), F.col("end"))).over(ahead))
            .withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(behind))
            .withColumn("y", (F.coalesce(F.col("last") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))).cast("int")))
    wide = near.where(~F.col("base") & (F.col("y") == 0)).checkpoint()
    spans = found.where("base").select("row", "kind", "start", "end", "base")
    fitted = _fit(wide, near_forms(found.where("base")), trees, precision)
    if fitted and fitted[1]:
        model, cut = fitted
        least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in cut.items()], F.lit(2.0))
        more = first_of_overlaps(_scored(featured(wide), model).where(F.col("p") >= least).select(*wide.columns))
        spans = spans.unionAll(more.select("row", "kind", "start", "end", F.lit(False).alias("base")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    per_row = spans.groupBy("row").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "base"))).alias("all"))
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    listed = per_row.select("row", *[f"n_{k}" for k in KINDS], text(F.filter("all", lambda s: s.base)).alias("base_list"), text(F.col("all")).alias("spans"))
    keep = [F.col("row").alias(row_col)] if row_col else []
    return rows.select("row", "id").join(listed, "row", "left").select(
        *keep, F.col("id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base_list", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
