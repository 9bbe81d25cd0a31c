"""URL verdicts: given rules first, gradient-boosted trees for the rest.

Lexical features of a URL (lengths, depth, shares of digits and other characters,
entropy, parameter counts, host and path endings) and statistics of its host's
endings feed boosted trees. They are trained on labelled URLs, by default those
that the rules decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import let
from docketry.operators.scaling import broadcast_if_small
from docketry.session import cut_lineage

# Labelled rows used to fit; a documented bound. The endings' statistics use all labelled rows.
FIT_ROWS = 20_000
TREES, DEPTH, STEP = 12, 3, 0.3
# Weight of the overall share of blocked URLs in an ending's share.
PRIOR = 20.0
ENDINGS = ("suffix", "domain", "section")
FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "labels", "digit_share", "host_digits", "letter_share",
    "hyphens", "entropy", "host_entropy", "parameters", "escapes", "has_extension", "has_fragment", "secure", "longest_label",
    *(f"{e}_{s}" for e in ENDINGS for s in ("share", "log_rows")),
)


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """``value(rule)`` of the longest rule that fits; among equally long ones the first given."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text), reverse=True)[::-1]:
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character of a text's own character distribution."""

    def of(characters: Column) -> Column:
        n = F.size(characters).cast("double")
        bits = lambda c: let(F.size(F.filter(characters, lambda x: x == c)) / n, lambda p: -p * F.log2(p))
        return F.aggregate(F.transform(F.array_distinct(characters), bits), F.lit(0.0), lambda s, x: s + x)

    return F.when(F.length(text) > 0, let(F.filter(F.split(text, ""), lambda c: c != ""), of)).otherwise(0.0)


def lexical(df: DataFrame, url_column: str) -> DataFrame:
    """``df`` with host, path, the endings and the lexical features, all prefixed ``_u_``."""
    url = F.coalesce(F.col(url_column), F.lit(""))
    host, path = host_and_path(F.col(url_column))
    df = df.withColumns({"_u_host": host, "_u_path": path})
    host, path = F.col("_u_host"), F.col("_u_path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    size = F.greatest(F.length(url), F.lit(1))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    labels = F.split(host, r"\.")
    longest = F.array_max(F.transform(labels, lambda x: F.length(x)))
    values = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "depth": count(path, "/[^/]"), "labels": F.size(labels), "digit_share": count(url, "[0-9]") / size,
        "host_digits": count(host, "[0-9]"), "letter_share": count(url, "[A-Za-z]") / size, "hyphens": count(host, "-"),
        "entropy": entropy(url), "host_entropy": entropy(host),
        "parameters": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0), "escapes": count(url, "%[0-9A-Fa-f]{2}"),
        "has_extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"), "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "secure": F.startswith(url, F.lit("https://")).cast("int"), "longest_label": longest,
        "suffix": F.element_at(labels, -1), "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        "section": F.regexp_extract(path, "^/([^/]*)", 1),
    }
    return df.withColumns({
        f"_u_{name}": value.cast("string" if name in ENDINGS else "double") for name, value in values.items()
    })


def with_endings(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Add each ending's smoothed share of blocked URLs and its logarithmic frequency among all labelled ones."""
    whole = labelled.agg(F.avg("_u_label").alias("share")).first()["share"]
    for ending in ENDINGS:
        name = f"_u_{ending}"
        stats = labelled.groupBy(name).agg(F.count("*").alias("n"), F.sum("_u_label").alias("blocked")).select(
            name, ((F.col("blocked") + PRIOR * F.lit(whole)) / (F.col("n") + PRIOR)).alias(f"{name}_share"),
            F.log1p(F.col("n").cast("double")).alias(f"{name}_log_rows"),
        )
        rows = rows.join(broadcast_if_small(stats), name, "left").fillna({f"{name}_share": float(whole or 0.0), f"{name}_log_rows": 0.0})
    return rows


def judged(df: DataFrame, rules: tuple[Rule, ...], labels: Column | None = None, id_column: str = "page_id",
           url_column: str = "url", rows: int = FIT_ROWS) -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` of every row.

    ``labels`` (1 to block, 0 to allow, null unknown) marks the training rows; by
    default a rule's verdict does. ``score`` is the trees' probability of block,
    and null for rows that a rule decides. A null URL, or one without ``://``, has
    an empty host and path and is judged by the trees like any other. With no
    labelled row everything else is allowed, with one label only that label is
    given. Repeated rows each get a row and equal URLs equal verdicts; when
    labelled rows exceed ``rows`` the trees learn from those with the smallest
    hash of the URL and id. Only the two named columns, and those that ``labels``
    uses, are read.
    """
    label = F.lit(None).cast("int") if labels is None else labels.cast("int")
    given = df.select(F.col(id_column).alias("_u_id"), F.col(url_column).alias("_u_url"), label.alias("_u_given"))
    wide = lexical(given, "_u_url")
    rule = fitting_rule(F.col("_u_host"), F.col("_u_path"), rules, lambda r: r.text)
    verdict = fitting_rule(F.col("_u_host"), F.col("_u_path"), rules, lambda r: r.verdict)
    wide = wide.withColumns({"_u_rule": rule, "_u_verdict": verdict})
    ruled = F.when(F.col("_u_verdict") == "block", 1).when(F.col("_u_verdict") == "allow", 0)
    wide = cut_lineage(wide.withColumn("_u_label", ruled if labels is None else F.col("_u_given")).drop("_u_given"))
    labelled = wide.where("_u_label IS NOT NULL")
    kinds = {r["_u_label"]: r["n"] for r in labelled.groupBy("_u_label").agg(F.count("*").alias("n")).collect()}  # two rows
    base = ["_u_id", "_u_host", "_u_path", "_u_rule", "_u_verdict"]
    if len(kinds) < 2:
        constant = F.lit(float(next(iter(kinds), 0)))
        scored = wide.select(*base, constant.alias("_u_score"))
    else:
        full = with_endings(wide, labelled)
        vectors = VectorAssembler(inputCols=[f"_u_{f}" for f in FEATURES], outputCol="_u_vector").transform(full)
        sample = cut_lineage(
            vectors.where("_u_label IS NOT NULL").orderBy(F.xxhash64("_u_url"), "_u_id").limit(rows)
            .select(F.col("_u_label").cast("double").alias("label"), F.col("_u_vector").alias("features"))
        )
        trees = GBTClassifier(
            maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=11, featuresCol="features", labelCol="label"
        ).fit(sample)
        trees = trees.setFeaturesCol("_u_vector").setProbabilityCol("_u_probability")
        scored = trees.transform(vectors).select(*base, F.get(vector_to_array("_u_probability"), F.lit(1)).alias("_u_score"))
    own = F.when(F.col("_u_score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        F.col("_u_id").alias("id"), F.col("_u_host").alias("host"), F.col("_u_path").alias("path"), F.col("_u_rule").alias("rule"),
        F.coalesce("_u_verdict", own).alias("verdict"), F.when(F.col("_u_rule").isNull(), F.col("_u_score")).alias("score"),
    )
