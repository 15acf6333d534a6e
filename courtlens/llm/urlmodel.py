"""URL filter: rules, and for what no rule fits, the ratio of two character language models.

The urls that rules allow or block train two variable-order Markov models over characters as they are. A model
interpolates its orders (Witten-Bell) up to ``ORDER``: contexts that it has not seen fall back to shorter ones, so the
order in use varies with what was seen. A url's score is the difference of its log-likelihoods divided by its length; the
threshold comes from a part of the rule-judged urls that the models have not seen, as the point of largest
difference between the shares of accepted and rejected urls above it.

The table of n-grams grows with the input: it holds every n-gram of the urls, of all orders. It is written to the shared
folder and joined, order by order with the next shorter one, then with the urls; nothing of it is broadcast or sent
to the driver. Everything is DataFrame work.

Edge cases: null urls and urls without ``://`` have empty host and path, fit no rule and are scored as they are
(null: as empty); empty tables give empty results; where rules leave no url of either verdict to learn from, the
method allows all; repeated rows count as often as they occur. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, store, table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The longest context: host labels, words of a path and numbers fit in it.
ORDER = 12
#: The edge of a url, before and behind it.
EDGE = "\0"
#: So many orders of the model are made in one step.
STORED = 3
#: Compression of the tables of n-grams: their strings are much alike.
CODEC = "zstd"
#: Symbols that a model without any evidence chooses from: the code points.
SIZE = 0x110000
#: One of so many rule-judged urls is kept from the models, for the threshold.
HELD_OUT = 4
#: Cells of the threshold's histogram for one nat.
CELLS = 100
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    # (?s): a line break is a character like any other.
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule, verdict); null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _grams(url: Column) -> Column:
    """The n-grams of a url with an edge behind it: each symbol with the ``ORDER`` symbols before it."""
    chars = F.filter(F.split(F.coalesce(url, F.lit("")), ""), lambda c: c != "")
    padded = F.concat(F.array_repeat(F.lit(EDGE), ORDER), chars, F.array(F.lit(EDGE)))
    at = F.sequence(F.lit(1), F.size(padded) - ORDER)
    return F.transform(at, lambda i: F.array_join(F.slice(padded, i, ORDER + 1), ""))


def _model(counts: DataFrame) -> DataFrame:
    """(gram, ratio): the log ratio of both models for every n-gram of ``counts`` (gram, good, bad).

    An n-gram has as many longer ones, and a context as many n-grams, as there are symbols: no key of a join is frequent.
    """
    orders = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("order")
    ends = counts.select("good", "bad", "gram", orders).select("order", F.expr(f"substring(gram, {ORDER + 1} - order, order + 1)").alias("gram"), "good", "bad")
    written = store(ends.groupBy("order", "gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-levels", "order", CODEC)
    discard(counts)
    levels = written.withColumn("context", F.expr("substring(gram, 1, order)"))
    contexts = levels.where("good + bad > 0").groupBy(F.col("order").alias("of"), F.col("context").alias("seen")).agg(
        *(F.sum(k).alias(f"{k}_all") for k in ("good", "bad")), *(F.count(F.when(F.col(k) > 0, 1)).alias(f"{k}_kinds") for k in ("good", "bad"))
    )
    contexts = store(contexts, "url-contexts", "of", CODEC)
    out = held = None
    for order in range(ORDER + 1):
        level = levels.where(F.col("order") == order).join(contexts.where(F.col("of") == order), F.col("context") == F.col("seen"), "left")
        if out is None:
            level = level.withColumns({"p_good": F.lit(1.0 / SIZE), "p_bad": F.lit(1.0 / SIZE)})
        else:
            level = level.join(out.withColumnRenamed("gram", "end"), F.expr(f"substring(gram, 2, {order})") == F.col("end"))
        p = []
        for k in ("good", "bad"):
            kinds, total = (F.coalesce(F.col(f"{k}_{x}"), F.lit(0)) for x in ("kinds", "all"))
            p.append(F.when(total > 0, (F.col(k) + kinds * F.col(f"p_{k}")) / (total + kinds)).otherwise(F.col(f"p_{k}")).alias(f"p_{k}"))
        out = level.select("gram", *p)
        if order % STORED == 0 and 0 < order < ORDER:  # files of finished orders go
            out, done = store(out, "url-order", codec=CODEC), held
            if done is not None:
                discard(done)
            held = out
    model = store(out.select("gram", (F.log("p_good") - F.log("p_bad")).alias("ratio")), "url-model", codec=CODEC)
    for done in (held, written, contexts):
        if done is not None:
            discard(done)
    return model


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold) for each row of ``df``."""
    host, path = host_and_path(F.col("url"))
    source = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    source = source.withColumns({"rule": rule, "by_rule": by_rule})
    held_out = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0

    keyed = store(source.withColumn("key", F.monotonically_increasing_id()).withColumn("held_out", held_out), "url-keyed", codec=CODEC)
    trains = F.col("by_rule").isNotNull() & ~F.col("held_out")
    trained = keyed.agg(*(F.count(F.when(trains & (F.col("by_rule") == v), 1)).alias(k) for k, v in (("good", "allow"), ("bad", "block")))).first()
    if not (trained["good"] and trained["bad"]):
        return keyed.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"))
    each = keyed.select("key", *(F.when(trains & (F.col("by_rule") == v), 1).otherwise(0).alias(k) for k, v in (("good", "allow"), ("bad", "block"))), F.explode(_grams(F.col("url"))).alias("gram"))
    counts = store(each.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-counts", codec=CODEC)
    ratios = _model(counts)
    of_url = each.select("key", "gram").join(ratios, "gram").groupBy("key").agg(F.avg("ratio").alias("score"))
    scored = store(keyed.join(of_url, "key").select("page_id", "host", "path", "rule", "by_rule", "score", "held_out"), "url-scores")
    discard(keyed)
    discard(ratios)

    cells = scored.where("by_rule is not null and held_out").groupBy(F.floor(F.col("score") * CELLS).cast("int").alias("cell")).agg(F.count(F.when(F.col("by_rule") == "allow", 1)).alias("good"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("bad"))
    # A few thousand cells at most, whatever the input.
    best, at, good, bad = -1.0, 0.0, 0, 0
    found = sorted(cells.collect(), key=lambda r: -r["cell"])
    all_good, all_bad = max(1, sum(r["good"] for r in found)), max(1, sum(r["bad"] for r in found))
    for r in found:
        good, bad = good + r["good"], bad + r["bad"]
        if (gain := good / all_good - bad / all_bad) > best:
            best, at = gain, r["cell"] / CELLS
    by_model = F.when(F.col("score") >= at, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score", F.lit(float(at)).alias("threshold"))


def op3_url_model(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
