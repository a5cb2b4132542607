"""Statistics of persons from senders and recipients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import is_active


def person_stats(mails: DataFrame, sender: str, recipients: str, date: str) -> DataFrame:
    """(person, email_count, as_sender, as_recipient, first_date, last_date). A mail counts once for its sender, and once
    for each different recipient other than the sender."""
    roles = F.concat(
        F.array(F.struct(F.col(sender).alias("person"), F.lit(1).alias("s"))),
        F.transform(F.filter(F.array_distinct(F.col(recipients)), lambda r: ~r.eqNullSafe(F.col(sender))), lambda r: F.struct(r.alias("person"), F.lit(0).alias("s"))),
    )
    rows = mails.select(F.explode(roles).alias("x"), F.col(date).alias("d")).select("x.*", "d").where("person IS NOT NULL AND cast(person AS string) != ''")
    return rows.groupBy("person").agg(
        F.count("*").alias("email_count"), F.sum("s").alias("as_sender"), F.sum(1 - F.col("s")).alias("as_recipient"), F.min("d").alias("first_date"), F.max("d").alias("last_date")
    )


def roles(stats: DataFrame, domain: str, internal_domain: str, as_of: str, days: int = 60, main: int = 3) -> DataFrame:
    """Adds ``internal``, ``active`` (seen in the last days) and ``role`` to statistics with a domain."""
    stats = main_contacts(stats, main).withColumn("internal", F.col(domain) == internal_domain)
    side = F.when(F.col("internal"), "internal").otherwise(F.concat(F.lit("external "), F.col(domain)))
    active = F.coalesce(is_active(F.col("last_date"), F.lit(as_of).cast("date"), days), F.lit(False))
    return stats.withColumn("role", F.concat_ws(", ", side, F.when(F.col("main_contact"), "main contact"))).withColumn("active", active)


def main_contacts(stats: DataFrame, n: int = 3) -> DataFrame:
    ranked = stats.orderBy(F.desc("email_count"), "person").limit(n).select("person", F.lit(True).alias("m"))
    return stats.join(F.broadcast(ranked), "person", "left").withColumn("main_contact", F.coalesce("m", F.lit(False))).drop("m")


def dominant_community(persons: DataFrame, membership: DataFrame) -> DataFrame:
    """The community with the most mails of its persons (least id on ties), over (person, email_count) and (person, community)."""
    votes = persons.join(membership, "person").groupBy("community").agg(F.sum("email_count").alias("votes"))
    return votes.orderBy(F.desc("votes"), "community").limit(1)


def firms_by_domain(people: DataFrame, address: str, firms: dict[str, str]) -> DataFrame:
    """Adds ``firm``, that of the address's domain or ``ext:domain``, and ``local``, what stands before the at sign."""
    known = F.coalesce(*[F.when(F.substring_index(address, "@", -1) == d, F.lit(f)) for d, f in firms.items()], F.concat(F.lit("ext:"), F.substring_index(address, "@", -1)))
    return people.withColumn("firm", known).withColumn("local", F.substring_index(address, "@", 1))


def firms_of(people: DataFrame, key: str, person: str, firm: str) -> DataFrame:
    """One line a group: ``firm: a, b | firm: c``."""
    by = people.groupBy(key, firm).agg(F.array_join(F.array_sort(F.collect_set(F.col(person).cast("string"))), ", ").alias("who"))
    return by.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", firm, "who"))), " | ").alias("participants"))
