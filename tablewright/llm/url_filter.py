"""URL filter: rules first, else the ratio of two character language models.

Both models read whole urls, query and fragment included; only the rules look at host and path.
They are learned from four fifths of the urls that rules judge: one from accepted, one from
rejected urls. They are Markov models of variable order: a character's probability mixes
its frequencies after contexts of 4, 3, 2, 1 and 0 characters, each weighted by how often
the context was seen against how many characters followed it (Witten-Bell smoothing). A
url's score is the mean difference of log probabilities a character, accepted minus
rejected; the threshold is the one that best separates the judged urls of the other fifth,
which the models have not seen. DataFrame operations only.

Counts are kept per distinct five-character gram, and lower orders are sums of them, so a
frequent gram is one row of the model. Only scoring joins grams with urls. A model of at most
`BROADCAST_GRAMS` rows is broadcast, and scores add up beside the scan; a larger one is joined
by gram, its rows repeated for as many salts as the most frequent gram has fair shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: (host, path, verdict) of the filter's rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER = 4  # characters of context
BROADCAST_GRAMS = 200_000  # some 10 MB
FOLDS = 5  # one of them sets the threshold
ALPHABET = 256.0  # an unseen character has 1 / ALPHABET
STEP = 0.02  # thresholds tried
START, END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from
    there up to `?`, `#` or the end. Both are empty without a url or `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule (like `net/es/`) and verdict of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column) -> Column:
    """Every character of the text and its end, each with the characters before it. Characters
    are split once for a text, so the work grows with its length and not with its square."""
    characters = F.split(F.concat(F.lit(START * ORDER), text, F.lit(END)), "")

    def windows(c: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(c) - ORDER - 1), lambda i: F.concat(*[F.get(c, i + k) for k in range(ORDER + 1)])
        )

    return F.get(F.transform(F.array(characters), windows), F.lit(0))


def _learns(text: Column) -> Column:
    """Whether a judged url teaches the models; the others set the threshold."""
    return F.crc32(text) % FOLDS != 0


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio) for `counts` (gram, accepted, rejected): log P(last character | those
    before it) in the accepted model minus the same in the rejected one."""
    kinds = ("accepted", "rejected")
    levels = [counts]
    for _ in range(ORDER):
        shorter = levels[-1].groupBy(F.expr("substr(gram, 2)").alias("gram"))
        levels.append(shorter.agg(*(F.sum(k).alias(k) for k in kinds)))
    lower = None
    for level, rows in zip(range(ORDER + 1), reversed(levels)):
        rows = rows.withColumn("context", F.expr(f"substr(gram, 1, {level})"))
        totals = rows.groupBy("context").agg(
            *(F.sum(k).alias(f"{k}_all") for k in kinds),
            *(F.sum((F.col(k) > 0).cast("long")).alias(f"{k}_kinds") for k in kinds),
        )
        rows = rows.join(totals, "context")
        if lower is None:
            rows = rows.select("*", *(F.lit(1 / ALPHABET).alias(f"{k}_lower") for k in kinds))
        else:
            lower = lower.select(F.col("gram").alias("shorter"), *(F.col(f"{k}_p").alias(f"{k}_lower") for k in kinds))
            rows = rows.withColumn("shorter", F.expr("substr(gram, 2)")).join(lower, "shorter")
        for k in kinds:
            seen, follow = F.col(f"{k}_all"), F.col(f"{k}_kinds")
            mixed = (F.col(k) + follow * F.col(f"{k}_lower")) / (seen + follow)
            rows = rows.withColumn(f"{k}_p", F.when(seen > 0, mixed).otherwise(F.col(f"{k}_lower")))
        lower = rows.select("gram", *(f"{k}_p" for k in kinds))
    return lower.select("gram", (F.log("accepted_p") - F.log("rejected_p")).alias("ratio"))


def threshold(judged: DataFrame) -> float:
    """The score that splits judged urls (score, verdict) with the best balanced accuracy,
    among multiples of STEP; 0 where a verdict is missing. One row per multiple is collected."""
    level = F.round(F.col("score") / STEP).cast("int")
    level = F.greatest(F.lit(-1000), F.least(F.lit(1000), level))
    rows = judged.groupBy(level.alias("level")).pivot("verdict", ["allow", "block"]).count().na.fill(0)
    rows = sorted(rows.collect(), key=lambda r: r.level)
    allow, block = sum(r.allow for r in rows), sum(r.block for r in rows)
    if not allow or not block:
        return 0.0
    best, at = -1.0, 0.0
    kept, out = allow, 0  # with the threshold below all levels
    for r in rows:
        if kept / allow + out / block > best:
            best, at = kept / allow + out / block, (r.level - 0.5) * STEP
        kept, out = kept - r.allow, out + r.block
    return at


def _scores(grams: DataFrame, ratios: DataFrame, frequent: int, total: int) -> DataFrame:
    """(text_id, score): the mean ratio of each url's grams. `frequent` is the count of the most
    frequent gram over different urls, `total` that of all grams."""
    if ratios.count() <= BROADCAST_GRAMS:
        joined = grams.join(F.broadcast(ratios), "gram")
    else:
        parts = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = max(1, min(parts, -(-frequent * parts // max(total, 1))))
        ratios = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = grams.withColumn("salt", F.pmod(F.xxhash64("text_id"), F.lit(salts)).cast("int"))
        joined = dealt.join(ratios, ["gram", "salt"])
    return joined.groupBy("text_id").agg(F.avg("ratio").alias("score"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of `pages` (page_id, url): page_id, host, path, rule, verdict, score.

    Urls that no rule fits are allowed if their score reaches the threshold. Without
    accepted or rejected urls to learn from, all scores and the threshold are 0; without both
    among those held back, the threshold is 0. Null urls are scored as empty ones, and urls
    without `://` as they are. Equal urls get equal scores; rows with equal or null page_id
    all stay. Other columns are ignored.
    """
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    texts = rows.groupBy("url").agg(F.count("*").alias("pages"))
    host, path = host_and_path(F.col("url"))
    texts = texts.withColumns({"host": host, "path": path})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    # 128 bits tell urls apart among any number of them; 64 would not.
    texts = written(texts.withColumns({"rule": rule, "verdict": verdict, "text_id": F.unhex(F.md5("url"))}))

    taught = F.when(_learns(F.col("url")), F.col("verdict")).alias("taught")
    grams = texts.select("text_id", "pages", taught, F.explode(_grams(F.col("url"))).alias("gram"))
    allowed = F.when(F.col("taught") == "allow", F.col("pages")).otherwise(0)
    blocked = F.when(F.col("taught") == "block", F.col("pages")).otherwise(0)
    counts = written(
        grams.groupBy("gram").agg(
            F.sum(allowed).alias("accepted"), F.sum(blocked).alias("rejected"), F.count("*").alias("urls")
        )
    )
    seen = counts.agg(F.max("urls").alias("frequent"), F.sum("urls").alias("total")).first()
    ratios = written(log_ratios(counts.drop("urls")))
    scores = _scores(grams.select("text_id", "gram"), ratios, seen.frequent or 0, seen.total or 0)
    scored = written(texts.join(scores, "text_id").drop("text_id", "pages"))

    held_back = scored.where(F.col("verdict").isNotNull() & ~_learns(F.col("url")))
    at = threshold(held_back.select("score", "verdict"))
    method = F.when(F.col("score") >= F.lit(at), "allow").otherwise("block")
    judged = scored.withColumn("verdict", F.coalesce("verdict", method))
    return rows.join(judged, "url").select("page_id", "host", "path", "rule", "verdict", "score")
