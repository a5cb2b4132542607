"""Conversations stitched from headers and guarded subjects; what was active; project tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.dates import parse_iso, whole_days
from ..functions.parsing import episodes, summary_and_open
from ..functions.text import addresses_in, clean_body, drop_prefixes, email_type, message_ids, normalize_subject, strip
from ..models import Provider, apply
from .components import connected_components, written
from .persons import firms_by_domain, firms_of
from .reports import numbered
from .segments import active_streak, in_episodes, latest_block, newest, sample_thirds, time_blocks


def header_edges(mails: DataFrame) -> DataFrame:
    """(a, b): a mail and the one that its In-Reply-To or References name; of equal message ids the last counts."""
    named = F.array_distinct(F.concat(message_ids(F.col("in_reply_to")), message_ids(F.col("references"))))
    refs = mails.select(F.col("id").alias("a"), F.explode(named).alias("ref"))
    owners = mails.where("message_id IS NOT NULL").groupBy("message_id").agg(F.max_by("id", F.struct(F.coalesce("date", F.lit("")), "id")).alias("b"))
    return refs.join(owners, refs["ref"] == owners["message_id"]).where("a != b").select("a", "b")


def subject_edges(mails: DataFrame, gap_days: int = 60) -> DataFrame:
    """(a, b): a run's first mail and another of the run. Neighbours by date within a normalised subject are of one run if
    near in time (or undated) or with a common participant; so a run of any length takes one step to join, not a path."""
    people = F.concat(addresses_in(F.col("from_address")), addresses_in(F.col("to_addresses")), addresses_in(F.col("cc_addresses")))
    rows = mails.select("id", normalize_subject(F.col("subject")).alias("s"), parse_iso(F.col("date")).alias("ts"), people.alias("people")).where("s != ''")
    w = Window.partitionBy("s").orderBy(F.col("ts").asc_nulls_first(), "id")
    rows = rows.select("id", "s", "ts", "people", F.lag("id").over(w).alias("a"), F.lag("ts").over(w).alias("before"), F.lag("people").over(w).alias("others"))
    near = F.col("ts").isNull() | F.col("before").isNull() | (whole_days(F.col("before"), F.col("ts")) <= gap_days)
    joins = F.col("a").isNotNull() & F.coalesce(near | F.arrays_overlap("people", "others"), F.lit(False))
    rows = rows.select("id", "s", "ts", F.when(~joins, F.col("id")).alias("head"))
    rows = rows.select("id", F.last("head", ignorenulls=True).over(w).alias("a"))
    return rows.where("a != id").select("a", F.col("id").alias("b"))


def conversations(mails: DataFrame, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, dict[str, int]]:
    """((id, conversation_id), counters). Numbers follow the first mail by date. Merges are counted as components saved."""
    mails = written(mails.select("id", "message_id", "in_reply_to", "references", "date", "from_address", "to_addresses", "cc_addresses", "subject"), "mails")
    nodes = mails.select(F.col("id").alias("node"))
    first = connected_components(nodes, header_edges(mails))
    # the subjects' edges join what headers have joined already, so the second graph has a node for each first component
    to = lambda end: first.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
    between = subject_edges(mails, config.subject_gap_days).join(to("a"), "a").join(to("b"), "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b"))
    roots = written(first.select(F.col("component").alias("node")).distinct(), "roots")
    merged = connected_components(roots, between)
    last = first.join(merged.select(F.col("node").alias("component"), F.col("component").alias("root")), "component").select("node", F.col("root").alias("component"))
    n, n1, n2 = nodes.count(), roots.count(), merged.select("component").distinct().count()
    dated = last.join(mails.select("id", "date"), last["node"] == F.col("id"))
    order = dated.groupBy("component").agg(F.min(F.struct(F.coalesce("date", F.lit("")).alias("first"), "id")).alias("o"))
    numbers = numbered(order, F.substring("o.first", 1, 10), [F.col("o")], "conversation_id").select("component", "conversation_id")
    out = last.join(numbers, "component").select(F.col("node").alias("id"), "conversation_id")
    return out, {"header_merges": n - n1, "subj_merges": n1 - n2}


def project_of(subjects: DataFrame, labels: DataFrame, config: EngineConfig) -> DataFrame:
    """(conversation_id, project, project_source): the name most subjects vote for, each by its first matching rule; else
    the code named most; else the first rule that fits the cluster's label; else unknown. Ties go to the lesser name."""
    s = subjects.select("conversation_id", strip(F.col("subject")).alias("subject")).distinct()
    pick = lambda df: df.groupBy("conversation_id", "project").agg(F.count("*").alias("n")).groupBy("conversation_id").agg(F.min_by("project", F.struct(-F.col("n"), "project")).alias("project"))
    first = lambda x, rules: F.coalesce(*[F.when(x.rlike(f"(?iU){p}"), F.lit(v)) for p, v in rules], F.lit(None).cast("string"))
    names = pick(s.select("conversation_id", first(F.col("subject"), config.name_rules).alias("project")).where("project IS NOT NULL"))
    found = F.array_compact(F.array(*[F.when(F.col("subject").rlike(rf"(?iU)\b{c}[\W_]"), F.lit(v)) for c, v in config.code_rules])) if config.code_rules else F.array().cast("array<string>")
    codes = pick(s.select("conversation_id", F.explode(found).alias("project")))
    by_label = labels.select("conversation_id", first(F.col("label"), config.cluster_rules).alias("by_label"))
    rows = s.select("conversation_id").distinct().join(names.withColumnRenamed("project", "by_name"), "conversation_id", "left").join(codes.withColumnRenamed("project", "by_code"), "conversation_id", "left").join(by_label, "conversation_id", "left")
    source = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_code").isNotNull(), "code").when(F.col("by_label").isNotNull(), "cluster").otherwise("unknown")
    return rows.select("conversation_id", F.coalesce("by_name", "by_code", "by_label", F.lit("unknown")).alias("project"), source.alias("project_source"))


def active_window(mails: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(conversation_id, subject, last_activity, n_window, n_streak, needs_topic): conversations with a mail in the last
    days, whose newest mail is work, and whose streak has two mails or more; newest first, capped.

    Mails: id, conversation_id, date (string), from_address, subject.
    """
    rows = mails.withColumn("ts", parse_iso(F.col("date")))
    start = rows.agg(F.date_format(F.date_sub(F.max(F.to_date("ts")), config.activity_days), "yyyy-MM-dd").alias("start"))
    rows = rows.crossJoin(F.broadcast(start))  # one row
    recent = rows.groupBy("conversation_id").agg(F.sum((F.col("date") >= F.col("start")).cast("int")).alias("n_window")).where("n_window > 0")
    rows = rows.drop("start").join(recent, "conversation_id")
    last = newest(rows, "conversation_id", "ts", "id").where(email_type(F.col("from_address"), F.col("subject")) == "WORK")
    streak = active_streak(rows, "conversation_id", "ts", "id", config.streak_gap_days)
    blocks = time_blocks(streak, "conversation_id", "ts", "id", config.block_gap_days)
    sizes = blocks.groupBy("conversation_id", "block").agg(F.count("*").alias("n")).groupBy("conversation_id").agg(F.sum("n").alias("n_streak"), F.max_by("n", "block").alias("last_block"))
    out = last.join(sizes, "conversation_id").where("n_streak >= 2")
    return out.orderBy(F.desc("date"), "conversation_id").limit(config.model_cap).select(
        "conversation_id", "subject", F.col("date").alias("last_activity"), "n_window", F.col("n_streak"), (F.col("last_block") > config.topic_min).alias("needs_topic")
    )


def _thread_texts(rows: DataFrame, key: list[str], each: int, most: int) -> DataFrame:
    """(key..., text): cleaned bodies of (date, id, from_address, body_text), in order, under a line of date and sender."""
    body = clean_body(F.col("body_text"))
    rows = rows.withColumn("_b", body).where("_b != ''")
    line = F.concat(F.lit("["), F.coalesce(F.substring("date", 1, 16), F.lit("")), F.lit("] "), F.coalesce("from_address", F.lit("?")), F.lit("\n"), F.when(F.length("_b") > each, F.concat(F.substring("_b", 1, each), F.lit("[...]"))).otherwise(F.col("_b")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("date", F.lit("")).alias("date"), "id", line.alias("line")))), lambda x: x["line"]), "\n\n---\n\n").alias("text")
    return rows.groupBy(*key).agg(joined).withColumn("text", F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("\n[...]"))).otherwise(F.col("text")))


def active_threads(mails: DataFrame, labels: DataFrame, provider: Provider, config: EngineConfig = EngineConfig(), computed_at: str = "") -> DataFrame:
    """Rows of the table ``active_threads``: what the conversations of ``active_window`` are about at last.

    Of a streak's mails with a body, the last block is the episode; where it has more than ``topic_min`` mails, a model
    names episodes from a sample of it, and the last of those with a mail counts. The model sums the episode up.
    Mails: id, conversation_id, date, from_address, to_addresses, cc_addresses, subject, body_text; labels
    (conversation_id, label): the label that most of a conversation's mails have.
    """
    found = written(active_window(mails, config), "active")
    rows = mails.join(F.broadcast(found.select("conversation_id")), "conversation_id").withColumn("ts", parse_iso(F.col("date")))  # model_cap rows
    streak = written(active_streak(rows, "conversation_id", "ts", "id", config.streak_gap_days), "streak")
    blocks = time_blocks(streak.where(F.trim(F.coalesce("body_text", F.lit(""))) != ""), "conversation_id", "ts", "id", config.block_gap_days)
    last = written(latest_block(blocks, "conversation_id"), "last")
    size = F.count("*").over(Window.partitionBy("conversation_id"))
    large = last.withColumn("_size", size).where(F.col("_size") > config.topic_min).drop("_size")
    texts = _thread_texts(sample_thirds(large, "conversation_id", [F.asc_nulls_first("date"), F.col("id")], 6), ["conversation_id"], 400, 6000)
    named = written(apply(texts.withColumn("prompt", F.concat(F.lit(config.episode_prompt), "text")), "conversation_id", "prompt", provider), "episodes")
    episodes_ = named.select("conversation_id", F.posexplode(episodes(F.col("result"))).alias("i", "e")).select("conversation_id", "i", "e.*")
    inside = in_episodes(large.withColumn("_day", F.substring("date", 1, 10)), episodes_, "conversation_id", "_day")
    inside = inside.withColumn("_last", F.max("i").over(Window.partitionBy("conversation_id"))).where("i = _last")
    part = inside.select("conversation_id", "id", "date", "from_address", "body_text", "d_from", "d_to")
    days = Window.partitionBy("conversation_id")
    day = F.substring("date", 1, 10)
    whole = last.join(part.select("conversation_id").distinct(), "conversation_id", "left_anti").select("conversation_id", "id", "date", "from_address", "body_text", F.min(day).over(days).alias("d_from"), F.max(day).over(days).alias("d_to"))
    episode = written(part.unionByName(whole), "episode")
    spans = episode.groupBy("conversation_id").agg(F.first("d_from").alias("episode_from"), F.first("d_to").alias("episode_to"))
    about = _thread_texts(episode, ["conversation_id"], 400, 8000).withColumn("prompt", F.concat(F.lit(config.summary_prompt), "text"))
    sums = apply(about, "conversation_id", "prompt", provider).select("conversation_id", summary_and_open(F.coalesce("result", "error")).alias("s")).select("conversation_id", "s.*")
    people = streak.select("conversation_id", F.explode(F.array_distinct(F.flatten(F.array(*[addresses_in(F.col(c)) for c in ("from_address", "to_addresses", "cc_addresses")])))).alias("address")).distinct()
    people = written(firms_by_domain(people, "address", config.firms), "people")
    firms = people.groupBy("conversation_id").agg(F.array_join(F.array_sort(F.collect_set("firm")), "|").alias("firms"))
    segmented = large.select("conversation_id").distinct().withColumn("_s", F.lit(1))
    out = found.join(spans, "conversation_id").join(sums, "conversation_id", "left").join(firms_of(people, "conversation_id", "local", "firm"), "conversation_id", "left").join(firms, "conversation_id", "left")
    out = out.join(project_of(rows, labels, config), "conversation_id", "left").join(segmented, "conversation_id", "left")
    return out.select(
        "conversation_id", drop_prefixes(F.coalesce("subject", F.lit(""))).alias("subject"), F.substring("last_activity", 1, 10).alias("last_activity"), F.col("n_window").cast("int").alias("n_window"), F.col("n_streak").cast("int").alias("n_streak"),
        "episode_from", "episode_to", "summary", "open_points", "participants", "firms", F.coalesce("_s", F.lit(0)).alias("is_segmented"), "project", "project_source", F.lit(computed_at).alias("computed_at"),
    )
