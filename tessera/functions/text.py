"""Text, subject, body and address functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reply prefixes, quote boundaries, signatures, forwarded headers, classifier patterns, letters.
SUBJECT_PREFIXES = ("Re", "Fwd", "FW", "Odp", "Odp\\.", "Odpoveď", "VS", "AW", "Pfwd")
SHORT_PREFIXES = ("Re", "Fwd", "FW", "Odp", "Odp\\.", "VS", "AW")
QUOTE_CUTS = (
    r"_{4,}[^A-Za-z]{0,10}(?:Od|From)\s*:",
    r"\bFrom\s*:\s*[^\n]{2,80}?\bSent\s*:",
    r"\bOd\s*:\s*[^\n]{2,80}?Odoslan",
    r"\b(?:po|ut|st|št|pi|so|ne)\s+\d{1,2}\s*\.\s*\d{1,2}\s*\.\s*\d{4}\s+o\s+\d{1,2}:\d{2}",
    r"\bOn\s+\w{2,3},?\s+\w+\s+\d{1,2},?\s+\d{4}\s+at\s+\d{1,2}:\d{2}",
    r"[-_]{5,}\s*(?:Original|Forwarded|Pôvodná)",
)
SIGNATURES = r"(-{2,}|_{4,}|S pozdravom|Pozdravom|Best regards|Regards,|Kind regards|Sent from|Poslan[éo] z|This e-?mail|CONFIDENTIAL|S úctou)"
FORWARD_HEADERS = r"(Od|Odoslané|From|Komu|To|Predmet|Subject|Dátum|Date|Sent|Kópia|CC)\s*:"
FORWARD_SEPARATORS = r"-{5,}\s*(Original|Forwarded|Pôvodná)"
BULK_SENDERS = r"no-reply|noreply|do-not-reply|donotreply|notifications?|mailer-?daemon|automated"
BULK_SUBJECTS = (
    r"^meeting\s+minutes\s*[:/]|^meeting\s+invitation\s*[:/]|\byou\s+have\s+been\s+mentioned\b|^recall\s*[:/]|has\s+\d+\s+updates?\s+since\b"
    r"|automatick[áa]\s+správ|\bnewsletter\b|\bunsubscribe\b|\bweekly\s+report\b|\bscheduler\b"
)
SOCIAL_SUBJECTS = r"\bparty\b|\bgrill\b|\bbbq\b|\bbarbecue\b|\bbeach\b|\bvedro\b|\bchill\b|\bvolejbal\b|\boslava\b|\bnarodeninov|narodeninám\b|\bnaroden[iy]\b"
SYSTEM_ADDRESSES = r"no[-_]?reply|noreply|mailer.daemon|postmaster|bounce|notification|unsubscribe|donotreply|do.not.reply|auto.reply|autoreply"
LETTERS_SK_ONLY, LETTERS_SK, LETTERS_DE = "ľĺŕôĽĹŔÔ", "áčďéíňóšťúýžÁČĎÉÍŇÓŠŤÚÝŽ", "üößÜÖ"

def _folded() -> tuple[str, str]:
    """Letters that decompose into a letter and marks, as Unicode has it, and their lower-case base letters."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, range(0xC0, 0x2000))]
    pairs = [(c, d[0].lower()) for c, d in pairs if len(d) > 1 and all(map(unicodedata.combining, d[1:])) and not unicodedata.combining(d[0]) and c == c.lower() and len(d[0].lower()) == 1]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, PLAIN = _folded()


#: White space of any kind.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(x, F.lit(SPACES))


def squeeze(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def fold(x: Column) -> Column:
    """Lower case, letters without their marks, and marks that stand alone dropped."""
    low = F.lower(x)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.regexp_replace(F.translate(low, ACCENTED, PLAIN), r"\p{Mn}", ""))


def html_strip(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return squeeze(x)


def drop_prefixes(x: Column, prefixes: tuple[str, ...] = SHORT_PREFIXES) -> Column:
    """Without reply prefixes, however many; a prefix may end in white space instead of a colon."""
    return strip(F.regexp_replace(strip(x), rf"(?iU)^((?:{'|'.join(prefixes)})\s*[:\s]\s*)+", ""))


def normalize_subject(x: Column) -> Column:
    return squeeze(fold(drop_prefixes(F.coalesce(x, F.lit("")), SUBJECT_PREFIXES)))


def detect_language(x: Column) -> Column:
    """sk, de, en or other, by shares of letters."""
    share = lambda letters: (F.length(x) - F.length(F.translate(x, letters, ""))) / F.length(x)
    ascii_share = F.length(F.regexp_replace(x, r"[^\x00-\x7F]", "")) / F.length(x)
    return (
        F.when(x.isNull() | (F.length(x) < 15), "other").when(share(LETTERS_SK_ONLY) > 0, "sk").when(share(LETTERS_SK) > 0.015, "sk")
        .when(share(LETTERS_DE) > 0.01, "de").when(ascii_share > 0.96, "en").otherwise("other")
    )


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, however often ``then`` names it, in branches too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def clean_body(x: Column, cuts: tuple[str, ...] = QUOTE_CUTS) -> Column:
    """Up to the earliest quote boundary; of that, lines before the signature that are no quotes or forwarded headers."""

    def uncut(x: Column) -> Column:
        first = F.array_min(F.filter(F.array(*[F.regexp_instr(x, F.lit(f"(?iU){p}")) for p in cuts]), lambda p: p > 0))
        return _let(first, lambda first: F.when(first.isNotNull(), F.substring(x, F.lit(1), first - 1)).otherwise(x))

    def unsigned(lines: Column) -> Column:
        ends = F.transform(lines, lambda r: r["s"].rlike(f"(?iU)^{SIGNATURES}") | r["s"].isin("--", "—"))
        return _let(F.array_position(ends, True), lambda end: F.when(end > 0, F.slice(lines, 1, F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(lines))

    x = F.coalesce(x, F.lit(""))
    x = _let(x, uncut) if cuts else x
    # each line with itself stripped, which all that follows looks at
    lines = _let(F.transform(F.split(x, r"\R"), lambda s: F.struct(s.alias("line"), strip(s).alias("s"))), unsigned)
    header = f"(?iU)^(?:{FORWARD_HEADERS}|{FORWARD_SEPARATORS})"
    good = F.transform(F.filter(lines, lambda r: ~(r["s"].startswith(">") | r["s"].rlike(header))), lambda r: r["line"])
    return strip(F.regexp_replace(F.array_join(good, "\n"), r"\n{3,}", "\n\n"))


def email_type(sender: Column, subject: Column, bulk_senders: str = BULK_SENDERS, bulk_subjects: str = BULK_SUBJECTS) -> Column:
    """BULK, SOCIAL or WORK; an organisation's own patterns go into the arguments, beside the general ones."""
    s = F.coalesce(subject, F.lit(""))
    bulk = F.lower(F.coalesce(sender, F.lit(""))).rlike(f"(?iU){bulk_senders}") | s.rlike(f"(?iU){bulk_subjects}")
    return F.when(bulk, "BULK").when(s.rlike(f"(?iU){SOCIAL_SUBJECTS}"), "SOCIAL").otherwise("WORK")


def is_system(address: Column, patterns: str = SYSTEM_ADDRESSES) -> Column:
    """Whether an address's local part is that of a machine; ``patterns`` may add an organisation's own."""
    return F.substring_index(address, "@", 1).rlike(f"(?i){patterns}")


def persons_of_mail(sender: Column, *lists: Column, patterns: str = SYSTEM_ADDRESSES) -> Column:
    """The different persons, ascending, of a sender and lists of {name, address}: lower-cased, with an at sign, no machines."""
    every = F.concat(F.array(sender), *[F.transform(F.coalesce(x, F.array().cast("array<struct<name:string,address:string>>")), lambda a: a["address"]) for x in lists])
    clean = F.transform(every, lambda a: F.lower(strip(a)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda a: F.contains(a, F.lit("@")) & ~is_system(a, patterns))))


def domain(address: Column) -> Column:
    """What follows the first at sign, lower-cased; empty without one."""
    return F.when(F.locate("@", address) > 0, F.lower(F.substring(address, F.locate("@", address) + 1, F.length(address)))).otherwise("")


def addresses_in(x: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda a: F.lower(a)))


def message_ids(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"<[^>]+>"), F.lit(0))


def thread_root(message_id: Column, in_reply_to: Column, references: Column) -> Column:
    first = F.element_at(F.split(strip(references), r"(?U)\s+"), 1)
    empty = lambda c: F.when(F.length(c) > 0, c)
    return F.coalesce(empty(first), empty(strip(in_reply_to)), empty(strip(message_id)))


def words(x: Column) -> Column:
    """Tokens of the word index: runs of letters and digits, folded."""
    return F.array_remove(F.split(fold(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def query_terms(x: Column, most: int = 12) -> Column:
    return F.slice(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)(\w{2,})"), F.lit(1)), 1, most)


def embedding_input(subject: Column, sender: Column, body: Column) -> Column:
    parts = [strip(F.coalesce(c, F.lit(""))) for c in (subject, sender, F.substring(body, 1, 500))]
    return F.concat_ws(" ", *[F.when(F.length(p) > 0, p) for p in parts])


def has_fact(text: Column, variants: Column) -> Column:
    return F.exists(variants, lambda v: F.contains(F.lower(text), F.lower(v)))


def address_list(json: Column) -> Column:
    """Addresses of a JSON list of {name, address}; invalid JSON gives an empty list."""
    return F.coalesce(F.from_json(json, "array<struct<name:string,address:string>>"), F.array().cast("array<struct<name:string,address:string>>"))
