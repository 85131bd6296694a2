"""URL filter: rules by host and path, else a logistic regression on hashed n-grams.

Everything is an expression of DataFrame functions.  Training is one row and one
expression: the labelled table is small (at most ``MOST_LABELLED`` rows, checked),
so its hashed n-grams are gathered into arrays and ``aggregate`` runs full-batch
gradient descent over them.  The weights, ``BUCKETS`` numbers, are a scalar
subquery of the scoring plan.

A URL's features are the n-grams of its host, the words of its host, and the n-grams of
its path.  Each of the three has a length of its own (``SHARES``), so a long path does not
dilute what the host says.

Defined cases: a null URL or one without ``://`` has an empty host and path, no
rule, and is judged by the bias and the marks of an empty host; ties cannot arise, since
two rules that fit one URL and are equally long are the same rule; very long URLs are read
whole; repeated rows are judged alike; page_id may have any type; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import labelled_urls

#: (verdict, rule): a rule is a host, which covers its subdomains, and the begin of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

BUCKETS, SIZES = 8192, (3, 4, 5)
#: Lengths of the host's n-grams, the host's words and the path's n-grams in a URL's features.
SHARES = (1.0, 1.0, 0.2)
STEPS, RATE, SHRINK = 180, 24.0, 0.0003
#: Added to the trained bias: between held-out plain and spam hosts that share few n-grams with the table.
#: Such hosts score low, most n-grams being unknown, and plain ones lower still.
MARGIN = 0.32
MOST_LABELLED = 2_000

#: What labelled URLs are made of: words of hosts and of paths, for URLs to block and for plain ones.
SPAM_WORDS = (
    "cheap buy discount viagra pharmacy meds tablets casino poker slots betting jackpot lottery bonus loans payday credit porn xxx "
    "adult cams escort dating replica backlinks seo clicks adserver tracker popunder banner affiliate leads free win prize gamble wager spam"
).split()
SPAM_PATHS = "buy order offer deal bonus signup click track pixel go promo win free cams play bet claim xxx seo apply-now".split()
SPAM_ENDS = "com net info biz top xyz club online".split()
PLAIN_WORDS = (
    "news library museum school university science weather garden cooking history travel music chess maps bank farming theatre wiki "
    "docs code software journal archive health city council government research physics biology books forum blog photo sport football "
    "radio times daily post press media open data stack exchange hub overflow python linux java developer learn college academy art "
    "film nature earth ocean river mountain bird animal plant kitchen recipe house home build engineer law court family church society "
    "trade market energy water rail air hotel insurance doctor hospital clinic kids teacher student language dictionary encyclopedia"
).split()
PLAIN_PATHS = "wiki article about docs paper abs news questions blog help story post section topics guide people events research en de".split()
PLAIN_ENDS = "com org net edu gov info de fr es co.uk io".split()


def _made(words: list[str], paths: list[str], ends: list[str], n: int) -> tuple[str, ...]:
    """``n`` URLs: hosts of one word, and of two with and without a hyphen, by turns."""
    out = []
    for k in range(n):
        one, two = words[k % len(words)], words[(k * 7 + k // len(words) * 3 + 1) % len(words)]
        host = (one, f"{one}-{two}", one + two)[k % 3] if one != two else one
        host = ("", "www.", "", "m.", "blog.")[k % 5] + f"{host}.{ends[k * 3 % len(ends)]}"
        tail = ("", ".html", "/", "?page=2", "#top")[k // 2 % 5]
        out.append(f"{('https', 'http')[k // 3 % 2]}://{host}/{paths[(k * 5 + 2) % len(paths)]}/{k % 97 + 1}{tail}")
    return tuple(out)


#: Frequent pairs of letters of English text.
PAIRS = "th he in er an re nd on en at ou ed ha to or it is hi es ng st ar se le te al io ne de ve ri ro ic li ra co me ti ea sh wh bl".split()


def _neutral(n: int) -> tuple[str, ...]:
    """``n`` names of two to four pairs that mean nothing: a host of which nothing is known is plain."""
    return tuple("".join(PAIRS[(k * (17 + 6 * j) + j * j * 5 + k // 7) % len(PAIRS)] for j in range(2 + k % 3)) for k in range(1, n + 1))


#: Hand-labelled URLs, and more of the same words by rule; spam and plain hosts have the same kinds of paths and ends.
BLOCKED = tuple(labelled_urls.BLOCKED.split()) + _made(SPAM_WORDS, SPAM_PATHS + PLAIN_PATHS[:10], SPAM_ENDS + PLAIN_ENDS, 280)
PLAIN = tuple(labelled_urls.PLAIN.split()) + _made(PLAIN_WORDS, PLAIN_PATHS, PLAIN_ENDS + SPAM_ENDS[-4:], 90) + _made(list(_neutral(200)), PLAIN_PATHS + SPAM_PATHS[::3], PLAIN_ENDS + SPAM_ENDS, 200)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(verdict, rule) of the longest rule that fits, null where none does."""
    verdict, found = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, begin = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + begin)
        verdict, found = F.when(fits, F.lit(kind)).otherwise(verdict), F.when(fits, F.lit(rule)).otherwise(found)
    return verdict, found


def features(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """(id, x) of the distinct n-grams of ``^host$``, of the host's words and of the path's n-grams, hashed to buckets:
    the values of each of the three have the length that ``SHARES`` gives it."""
    def hashed(mark: str, text: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(mark), text), F.lit(buckets)).cast("int")

    def grams(text: Column, mark: str, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: hashed(mark, F.substring(text, i, F.lit(n))))

    def weighed(ids: Column, share: float) -> Column:
        scaled = lambda ids: F.transform(ids, lambda k: F.struct(k.alias("id"), (F.lit(share) / F.sqrt(F.size(ids).cast("double"))).alias("x")))
        return F.element_at(F.transform(F.array(F.array_sort(F.array_distinct(ids))), scaled), 1)

    marked = F.concat(F.lit("^"), host, F.lit("$"))
    ids = [F.concat(*[grams(marked, "h", n) for n in SIZES]), F.transform(F.split(host, "[.-]"), lambda w: hashed("w", w)), F.concat(*[grams(path, "p", n) for n in SIZES])]
    return F.concat(*map(weighed, ids, SHARES))


def labelled(spark: SparkSession) -> DataFrame:
    both = [spark.range(1).select(F.explode(F.split(F.lit(" ".join(us)), " ")).alias("url"), F.lit(k).alias("label")) for k, us in ((1, BLOCKED), (0, PLAIN))]
    return both[0].unionByName(both[1])


def trained(table: DataFrame, buckets: int = BUCKETS, steps: int = STEPS) -> DataFrame:
    """(w): one row, the weights of all buckets and last the bias, from (url, label)."""
    rows = table.where("url is not null and label is not null")
    n = rows.limit(MOST_LABELLED + 1).count()
    if not 0 < n <= MOST_LABELLED:
        raise ValueError(f"{n} labelled URLs; 1 to {MOST_LABELLED} are asked for")
    rows = rows.select("label", features(host_of(F.col("url")), path_of(F.col("url")), buckets).alias("f"))
    # By example: its buckets; by bucket: the examples that have it.  Examples in one order.
    ranked = rows.agg(F.array_sort(F.collect_list(F.struct("label", "f"))).alias("rows"))
    having = ranked.select(F.posexplode("rows").alias("k", "row")).select("k", F.inline("row.f"))
    having = having.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("ks"))
    whole = table.sparkSession.range(buckets).join(having, "id", "left").select("id", F.coalesce("ks", F.expr("cast(array() as array<struct<k:int,x:double>>)")).alias("ks"))
    cols = whole.agg(F.array_sort(F.collect_list(F.struct("id", "ks"))).alias("all")).select(F.col("all.ks"))
    ranked = ranked.withColumn("cols", cols.scalar())
    error = "transform(rows, r -> 1 / (1 + exp(-(aggregate(r.f, 0D, (a, g) -> a + w[g.id] * g.x) + w[" + str(buckets) + "]))) - r.label)"
    step = f"""aggregate(array({error}), w, (v, e) -> concat(
        transform(cols, (ks, b) -> v[b] * {1 - SHRINK}D - {RATE}D * aggregate(ks, 0D, (a, g) -> a + e[g.k] * g.x) / size(rows)),
        array(v[{buckets}] - {RATE / 4}D * aggregate(e, 0D, (a, x) -> a + x) / size(rows))))"""
    return ranked.select(F.expr(f"aggregate(sequence(1, {steps}), array_repeat(0D, {buckets + 1}), (w, i) -> {step})").alias("w"))


def judge(pages: DataFrame, table: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Per page (page_id, url): page_id, host, path, rule, verdict, score (of being blocked)."""
    weights = trained(labelled(pages.sparkSession) if table is None else table).scalar()
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("f", features(F.col("host"), F.col("path"))).withColumn("w", weights)
    total = F.aggregate("f", F.lit(0.0), lambda a, g: a + F.get(F.col("w"), g["id"]) * g["x"]) + F.get(F.col("w"), F.lit(BUCKETS)) + MARGIN
    rows = rows.select("page_id", "host", "path", (1 / (1 + F.exp(-total))).alias("score"))
    verdict, rule = matching_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
