"""URL filters: host and path rules, and a logistic regression on hashed character n-grams. All expressions are Spark's own."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """A verdict on a host, its subdomains, and the paths that begin with the rule's."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed rules of the query.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

#: Words of the small labelled table, of which its hosts and paths are made.
BAD_WORDS = (
    "casino poker bets jackpot lottery slots bonus viagra pills pharmacy cheap discount replica loans credit payday cash money "
    "free winner prize adult porn webcam dating escort crack keygen warez torrent spam bulk clicks traffic farm banner popup tracker adserver xxx"
).split()
GOOD_WORDS = (
    "library museum university research physics chemistry biology history archive garden kitchen recipe travel journal gazette tribune "
    "council parliament hospital clinic theatre orchestra chess cycling hiking railway harbour village school teacher science nature "
    "education national station fiction northern southern mother weather thesis method ethics author rather within another others thirty "
    "lesson session motion section nation option notation edition tradition translation question painting building writing reading evening "
    "python oracle software engineer forest island mountain river ocean coffee bakery market street cathedral letters poetry novel review "
    "press times herald daily world people family children health food music film dance sport football tennis winter summer spring autumn"
).split()
BAD_PATHS = ("/buy/now", "/claim")
GOOD_PATHS = ("/", "/about", "/articles/spring", "/en/guide", "/blog/notes.html")
DOMAINS = ("com", "org", "net", "info", "co.uk")

#: The share of unwanted urls that is assumed; the labelled table has another, for which the odds are corrected.
UNWANTED = 0.4

#: Hash bins of the n-grams.
BINS = 1 << 14

#: The squared penalty of the regression.
PENALTY = 0.001


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label), made of word lists by rule; 1 is unwanted.

    Each word is a host alone and is paired with the words 5 and 11 places on; hosts of either label get paths of both by turns,
    so that a path alone decides little, and every fourth has a www in front.
    """
    rows = []
    for label, words, paths in ((1.0, BAD_WORDS, BAD_PATHS + GOOD_PATHS), (0.0, GOOD_WORDS, GOOD_PATHS)):
        for i, word in enumerate(words):
            for j, host in enumerate((word, f"{word}-{words[(i + 5) % len(words)]}", f"{words[(i + 11) % len(words)]}{word}")):
                at = 3 * i + j
                rows.append((f"https://{'www.' * (at % 4 == 0)}{host}.{DOMAINS[at % len(DOMAINS)]}{paths[at % len(paths)]}", label))
    return spark.createDataFrame(rows, "url string, label double")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and where there is no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER), F.regexp_extract(whole, pattern, 2)


def _grams(name: str, chars: Column) -> Column:
    """Runs of three and four of the characters, each with the name of its part."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.transform(starts, lambda i: F.concat_ws("", F.lit(name), *(F.get(chars, i + j) for j in range(n))))

    return F.concat(runs(3), runs(4))


def _featured(urls: DataFrame) -> DataFrame:
    host, path = parts(F.col("url"))
    cut_up = urls.withColumns({"host": host, "path": path}).withColumns({f"_{c}": F.split(F.concat(F.lit("^"), F.col(c), F.lit("$")), "") for c in ("host", "path")})
    grams = cut_up.withColumn("_grams", F.concat(_grams("h:", F.col("_host")), _grams("p:", F.col("_path"))))
    return HashingTF(numFeatures=BINS, inputCol="_grams", outputCol="_x").transform(grams)


def fit(table: DataFrame) -> LogisticRegressionModel:
    """A model of a labelled table (url, label), which is small. Its rows are weighed so that UNWANTED of the weight is unwanted."""
    share = F.avg("label").over(W.partitionBy())  # over a small table
    weight = F.when(F.col("label") == 1, UNWANTED / share).otherwise((1 - UNWANTED) / (1 - share))
    rows = _featured(table.withColumn("_weight", weight))
    return LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_weight", probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r", regParam=PENALTY, maxIter=100).fit(rows)


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's probability of an unwanted url) of every row.

    A url that is null or has no :// has empty host and path, fits no rule, and is judged by the model like any other.
    Repeated rows get equal verdicts, an empty table gives an empty one; a long url costs time in proportion to its length.
    """
    scored = model.transform(_featured(pages.select("page_id", "url")))
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest that fits is asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    score = F.get(vector_to_array("_p"), F.lit(1))
    own = F.when(score >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), score.alias("score"))
