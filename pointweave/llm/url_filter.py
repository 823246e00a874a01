"""URL filter: host and path rules, and two character language models for the rest, in built-in functions.

Rules decide what they fit.  The URLs that a rule allows train one smoothed variable-order Markov model, those
that a rule blocks another: counts of all eight-grams over all such rows, interpolated from order 7 down to
0 with Witten-Bell weights.  Any other URL gets the mean difference of its log-likelihoods a character, held against a
threshold.  A first fit that leaves out one distinct URL in five, with all its rows, calibrates the threshold on the
rows left out; the scores come from a second fit on all ruled rows; both are made in one pass.  Each distinct URL is scored once.  The models read
the URL as it stands, every character of it: scheme, query and fragment too, and no character is folded into another.

Defined results
    * no ``://`` in the URL: host and path empty for the rules; the models read the URL.
    * null URL: as an empty one.
    * several rules fit: the longest host and path together wins.
    * no ruled URL of either kind: threshold and score 0, verdict ``allow``.
    * repeated rows and rows with equal URLs: equal verdicts; each row counts in the models and the threshold.  Empty input: no rows.
    * extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bind, cut_table

#: (verdict, host, path)
Rule = tuple[str, str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Context characters of the models' highest order.
ORDER = 7
#: Marks before and after a text: control characters, which no valid URL has.
START, END = "\x02", "\x03"
#: A gram that is more than one in so many of all grams is common; so there are fewer common ones than this.
COMMON = 4096
#: Scores are summed as whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
#: One part in so many of the ruled URLs calibrates the threshold and is not in the first fit.
FOLDS = 5
#: Rows of a written table that one task reads, about; a small table is not dealt over more tasks than it needs.
TASK_GRAMS, TASK_URLS = 250_000, 10_000


def _tasks(written: DataFrame, rows: int) -> int:
    return max(1, -(-written.count() // rows))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case and the path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path) and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, own_host, own_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        name, verdict = F.when(fits, F.lit(own_host + own_path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def grams(text: Column) -> Column:
    """All eight-grams of a text with seven marks before and one after: one for each character and one for the end."""
    padded = F.concat(F.lit(START * ORDER), text, F.lit(END))
    return bind(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - ORDER), lambda i: F.substring(p, i, ORDER + 1)))


def log_ratios(counts: DataFrame, pairs: dict[str, tuple[str, str]], tasks: int) -> DataFrame:
    """``gram`` and for each pair of count columns the difference of the models' smoothed log-probabilities."""
    columns = [c for pair in pairs.values() for c in pair]
    alphabet = max(1, counts.select(F.substring("gram", ORDER + 1, 1)).distinct().count())
    lower = None
    for k in range(ORDER + 1):
        own = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("g")).agg(*[F.sum(c).alias(c) for c in columns]).coalesce(tasks)
        context = own.groupBy(F.substring("g", 1, k).alias("context")).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("sum", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0)))])
        own = own.withColumns({"context": F.substring("g", 1, k), "tail": F.substring("g", 2, k)}).join(context, "context")
        own = own.withColumns({f"p_{c}": F.lit(1.0 / alphabet) for c in columns}) if lower is None else own.join(lower, "tail")
        smooth = {c: F.when(F.col(f"{c}_sum") == 0, F.col(f"p_{c}")).otherwise((F.col(c) + F.col(f"{c}_kinds") * F.col(f"p_{c}")) / (F.col(f"{c}_sum") + F.col(f"{c}_kinds"))) for c in columns}
        lower = own.select(F.col("g").alias("tail"), *[p.alias(f"p_{c}") for c, p in smooth.items()]).coalesce(tasks)
    return lower.select(F.col("tail").alias("gram"), *[F.round((F.log(f"p_{yes}") - F.log(f"p_{no}")) * UNIT).cast("long").alias(name) for name, (yes, no) in pairs.items()])


def scores(texts: DataFrame, ratios: DataFrame, common: DataFrame) -> DataFrame:
    """``id, s, kind`` to ``id, score``: mean log-ratio a character in units of ``UNIT``, by the first fit where the kind is known.

    Grams that occur in most texts are joined without a shuffle, as each is one key with a row for every text.
    """
    each = texts.select("id", F.col("kind").isNotNull().alias("known"), (F.length("s") + 1).alias("n"), F.explode(grams(F.col("s"))).alias("gram"))
    few = F.broadcast(ratios.join(F.broadcast(common), "gram", "left_semi"))
    rest = each.join(F.broadcast(common), "gram", "left_anti").join(ratios, "gram")
    both = each.join(few, "gram").unionByName(rest)
    return both.groupBy("id").agg(F.floor(F.sum(F.when(F.col("known"), F.col("first")).otherwise(F.col("ratio"))) / F.max("n")).cast("long").alias("score"))


def threshold(scored: DataFrame, step: int = UNIT // 100, most: int = 2000) -> int:
    """The score from which on URLs are allowed: least sum of both error rates over ``score, kind, rows``."""
    steps = F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.col("score") / step)))
    counted = scored.groupBy(steps.cast("int").alias("at")).agg(*[F.sum(F.when(F.col("kind") == kind, F.col("rows")).otherwise(0)).alias(c) for c, kind in (("yes", "allow"), ("no", "block"))])
    rows = sorted(tuple(r) for r in counted.collect())  # at most 2 * most + 1 rows, whatever the input
    all_yes, all_no = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not all_yes or not all_no:
        return 0
    best, below_yes, below_no, cut_at = 1.0, 0, 0, rows[0][0]
    for at, yes, no in rows:
        error = below_yes / all_yes + (all_no - below_no) / all_no
        if error < best or (error == best and abs(at) < abs(cut_at)):
            best, cut_at = error, at
        below_yes, below_no = below_yes + yes, below_no + no
    return cut_at * step


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score``; the score is null where a rule decides."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(url_col), F.lit("")).alias("s"))
    name, kind = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "kind": kind})
    # equal URLs have equal kinds, as host and path are functions of the URL
    texts = rows.groupBy("s").agg(F.max("kind").alias("kind"), F.count("*").alias("rows"))
    texts = cut_table(texts.withColumns({"id": F.monotonically_increasing_id(), "fold": F.pmod(F.xxhash64("s"), F.lit(FOLDS))}))
    texts = texts.coalesce(_tasks(texts, TASK_URLS))
    kinds = {"yes": F.col("kind") == "allow", "no": F.col("kind") == "block"}
    kinds |= {f"first_{c}": on & (F.col("fold") > 0) for c, on in kinds.items()}
    each = texts.select(F.explode(grams(F.col("s"))).alias("gram"), *[F.when(on, F.col("rows")).otherwise(0).alias(c) for c, on in kinds.items()])
    scratch = Scratch(pages.sparkSession)
    counts = scratch.cut(each.groupBy("gram").agg(*[F.sum(c).alias(c) for c in kinds], F.count("*").alias("n")))
    tasks = _tasks(counts, TASK_GRAMS)
    counts = counts.coalesce(tasks)
    common = scratch.cut(counts.join(counts.agg(F.sum("n").alias("all")), F.col("n") * COMMON > F.col("all")).select("gram"))
    ratios = scratch.cut(log_ratios(counts, {"ratio": ("yes", "no"), "first": ("first_yes", "first_no")}, tasks)).coalesce(tasks)
    some = texts.where(F.col("kind").isNull() | (F.col("fold") == 0))
    scored = cut_table(scores(some, ratios, common).coalesce(_tasks(texts, TASK_URLS)).join(some.select("id", "s", "kind", "rows"), "id").select("s", "kind", "rows", "score"))
    scratch.drop()
    limit = threshold(scored.where(F.col("kind").isNotNull()))
    scored = scored.where(F.col("kind").isNull()).select("s", "score")
    judged = rows.join(scored, "s", "left")
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("kind", F.when(F.col("score") >= limit, F.lit("allow")).otherwise("block")).alias("verdict"),
        F.when(F.col("kind").isNull(), F.col("score")).alias("score"),
    )
