"""Reports: compared groupings, summaries of communities, signals, facts, costs, prompts for labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .components import written
from .graph import degrees
from .segments import top_n

WORD = r"(?U)\b[\p{L}]{3,}\b"


def numbered(df: DataFrame, day: Column, order: list[Column], name: str) -> DataFrame:
    """Adds dense numbers from 1 in the order of days and then of ``order``. Only the counts of days, which are few,
    meet in one task; rows are numbered within their day."""
    df = df.withColumn("_day", day)
    counts = df.groupBy("_day").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_day").alias("_d"), (F.sum("_n").over(Window.orderBy(F.asc_nulls_first("_day"))) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_day").orderBy(*order))
    return df.withColumn("_i", within).join(before, F.col("_day").eqNullSafe(F.col("_d"))).withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_day", "_d", "_before", "_i")


def changed_groups(df: DataFrame, old: str, new: str) -> DataFrame:
    """(kind, groups, mails): old groups that lie in several new ones (split), and new ones that join several old (merge)."""
    sides = []
    for kind, whole, part in (("split", old, new), ("merge", new, old)):
        g = df.where(F.col(whole).isNotNull()).groupBy(whole).agg(F.count_distinct(part).alias("c"), F.count("*").alias("n")).where("c > 1")
        sides.append(g.agg(F.lit(kind).alias("kind"), F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("mails")))
    return sides[0].unionByName(sides[1])


def change_examples(df: DataFrame, whole: str, part: str, day: str, groups: int = 3, parts: int = 4) -> DataFrame:
    """(whole, total, part, n, first, last): the largest groups that fall into several parts, with their least parts."""
    each = df.where(F.col(whole).isNotNull() & F.col(part).isNotNull()).groupBy(whole, part).agg(F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("last"))
    large = each.groupBy(whole).agg(F.sum("n").alias("total"), F.count("*").alias("parts")).where("parts > 1").orderBy(F.desc("total"), whole).limit(groups).select(whole, "total")
    return top_n(each.join(F.broadcast(large), whole), [whole], [F.col(part)], parts).select(whole, "total", part, "n", "first", "last")


def community_summary(edges: DataFrame, people: DataFrame, mails: DataFrame, stop_words: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """One row a community: sizes, its most central persons, external domains, frequent words, months, number of mails.

    ``edges`` (a, b, weight) after pruning; ``people`` (person, community, internal, domain); ``mails`` (id, person,
    subject, day), a row for each person of a mail. A mail counts once for each community that it touches. Ties go to
    the lesser name.
    """
    c = degrees(edges).select(F.col("node").alias("person"), "centrality")
    people = written(people.join(c, "person", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0))), "people")  # read four times
    sizes = people.groupBy("community").agg(F.count("*").alias("size"), F.count_if("internal").alias("n_int"), F.count_if(~F.col("internal")).alias("n_ext")).where(F.col("size") >= least)
    best = lambda rows, keys, order, n, what, to: top_n(rows, keys, order, n, "r").groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", what.alias("v")))), lambda x: x["v"]).alias(to))
    top5 = best(people, ["community"], [F.desc("centrality"), F.col("person")], 5, F.col("person"), "top5")
    doms = people.where(~F.col("internal") & (F.col("domain") != "")).groupBy("community", "domain").agg(F.count("*").alias("n"))
    doms = best(doms, ["community"], [F.desc("n"), F.col("domain")], 5, F.struct("domain", "n"), "ext_doms")
    touched = written(mails.join(people.select("person", "community"), "person").select("community", "id", "subject", "day").distinct(), "touched")  # read twice
    spans = touched.groupBy("community").agg(F.count_distinct("id").alias("n_emails"), F.substring(F.min(F.nullif("day", F.lit(""))), 1, 7).alias("first"), F.substring(F.max("day"), 1, 7).alias("last"))
    words = touched.groupBy("community", "subject").agg(F.count("*").alias("times"))  # a subject is cut into words once
    words = words.select("community", "times", F.explode(F.transform(F.regexp_extract_all("subject", F.lit(WORD), F.lit(0)), lambda w: F.lower(w))).alias("word"))
    words = words.where(~F.col("word").isin(*stop_words)) if stop_words else words
    words = best(words.groupBy("community", "word").agg(F.sum("times").alias("n")), ["community"], [F.desc("n"), F.col("word")], 12, F.struct("word", "n"), "top_words")
    out = sizes
    for part in (top5, doms, words, spans):
        out = out.join(part, "community", "left")
    return out


def signal_stats(scores: DataFrame, signals: list[str], total: str, threshold: float) -> DataFrame:
    """(signal, passed, n, median, mean, low, high, zeros, share) of each signal, for hits with and without enough in all;
    ``share`` is the signal's percentage of the group's sum over signals. One pass, whatever the number of signals."""
    rows = scores.select((F.round(total, 4) >= threshold).alias("passed"), F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.coalesce(s, F.lit(0.0)).alias("x")) for s in signals])).alias("e")).select("passed", "e.*")
    g = rows.groupBy("signal", "passed").agg(F.count("*").alias("n"), F.median("x").alias("median"), F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"), F.count_if(F.col("x") == 0).alias("zeros"), F.sum("x").alias("sum"))
    whole = F.sum("sum").over(Window.partitionBy("passed"))
    return g.withColumn("share", F.when(whole != 0, 100 * F.col("sum") / whole)).drop("sum")


def separation(similarities: DataFrame, same: str, score: str) -> DataFrame:
    """(related, unrelated, gap): mean similarities within and across groups, and their difference."""
    mean = lambda c: F.avg(F.when(c, F.col(score)))
    return similarities.agg(mean(F.col(same)).alias("related"), mean(~F.col(same)).alias("unrelated")).withColumn("gap", F.col("related") - F.col("unrelated"))


def fact_scores(answers: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """(model, key, found, facts): facts (key, variants array) of which any variant occurs in the answer (model, key, text)."""
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = answers.join(facts, key).select("model", key, F.exists("variants", lambda v: F.contains(low, F.lower(v))).alias("hit"))
    return rows.groupBy("model", key).agg(F.count_if("hit").alias("found"), F.count("*").alias("facts"))


#: Words inside a fact by which documents that may hold it are found.
ANCHOR = 3


def fact_counts(docs: DataFrame, text: str, facts: DataFrame, key: str, fact: str) -> DataFrame:
    """(key, n): how many documents hold each fact, whatever the case; facts that none holds are left out.

    What stands between a fact's first and last blank are whole words of any text that holds it, so documents and facts
    of enough words meet on ANCHOR words from there; only what meets is searched. Facts of fewer words, which have no
    such words, are searched for everywhere, in a join that Spark broadcasts only while they are small.
    """
    low = docs.select(F.lower(F.col(text)).alias("low")).where("low IS NOT NULL")
    f = facts.select(F.col(key), F.lower(F.col(fact)).alias("fact")).withColumn("words", F.split("fact", " "))
    anchor = lambda words, i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(ANCHOR)])
    long = f.where(F.size("words") >= ANCHOR + 2).withColumn("anchor", anchor(F.col("words"), F.lit(1)))
    inside = low.withColumn("words", F.split("low", " ")).where(F.size("words") >= ANCHOR)
    after = lambda k: F.slice("words", 1 + k, F.size("words") - ANCHOR + 1)  # noqa: E731  words from the k-th on, beside each other
    runs = F.transform(F.arrays_zip(*[after(k).alias(f"w{k}") for k in range(ANCHOR)]), lambda z: F.concat_ws(" ", *[z[f"w{k}"] for k in range(ANCHOR)]))
    met = inside.select("low", F.explode(F.array_distinct(runs)).alias("anchor")).join(long.select(key, "fact", "anchor"), "anchor").where(F.contains("low", F.col("fact")))
    short = f.where((F.size("words") < ANCHOR + 2) & (F.col("fact") != ""))
    every = low.join(short, F.contains("low", F.col("fact")))
    return met.select(key).unionAll(every.select(key)).groupBy(key).agg(F.count("*").alias("n"))


def costs(calls: DataFrame, prices: dict[str, tuple[float, float]], runs_per_month: int = 30) -> DataFrame:
    """(model, calls, tokens_in, tokens_out, cost, cost_each, cost_month) of calls (model, tokens_in, tokens_out), where
    prices are by model and million tokens; models without a price cost nothing."""
    price = lambda k: F.coalesce(*[F.when(F.col("model") == m, F.lit(p[k])) for m, p in prices.items()], F.lit(0.0))
    g = calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    g = g.withColumn("cost", (F.col("tokens_in") * price(0) + F.col("tokens_out") * price(1)) / 1_000_000)
    return g.withColumn("cost_each", F.col("cost") / F.col("calls")).withColumn("cost_month", F.col("cost_each") * runs_per_month)


def label_lines(mails: DataFrame, cluster: str, order: list[Column], n: int = 10, snippet: int = 120) -> DataFrame:
    """(cluster, lines): the first n mails of a cluster, numbered, with their snippet where it says more than the subject."""
    subject, text = strip(F.coalesce("subject", F.lit(""))), F.substring(strip(F.coalesce("body_snippet", F.lit(""))), 1, snippet)
    rows = top_n(mails, [cluster], order, n, "i").withColumn("_s", subject).withColumn("_t", text)
    line = F.concat(F.col("i").cast("string"), F.lit(". "), F.col("_s"), F.when((F.col("_t") != "") & (F.col("_t") != F.col("_s")), F.concat(F.lit("\n   "), "_t")).otherwise(""))
    return rows.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def alternative_names(people: DataFrame, community: str, total: str) -> DataFrame:
    """Persons (community, person, n) with at least max(5, total // 40) mails, which is what makes a name worth showing."""
    return people.where(F.col("n") >= F.greatest(F.lit(5), F.floor(F.col(total) / 40)))
