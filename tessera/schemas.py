"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ADDRESS = "struct<name:string,address:string>"
_DDL = {
    "emails": f"""id bigint, message_id string, thread_id string, in_reply_to string, references string, date string, from_address string,
        from_name string, to_addresses array<{ADDRESS}>, cc_addresses array<{ADDRESS}>, subject string, folder string, has_attachments boolean,
        attachment_names array<string>, attachment_types array<string>, size_bytes bigint, imap_uid bigint, synced_at string, body_text string,
        body_snippet string, embedding array<float>, language string, conversation_id bigint""",
    "sync_state": "folder string, last_uid bigint, last_sync string",
    "clusters": "id bigint, label string, description string, size bigint, created_at string, updated_at string",
    "email_clusters": "email_id bigint, cluster_id bigint, confidence double, source string, created_at string",
    "feedback": "email_id bigint, old_cluster_id bigint, correct_cluster_id bigint, note string, created_at string",
    "email_topics": "email_id bigint, cluster_id bigint, similarity double, rank int, low_confidence int",
    "active_threads": """conversation_id bigint, subject string, last_activity string, n_window int, n_streak int, episode_from string, episode_to string,
        summary string, open_points string, participants string, firms string, is_segmented int, project string, project_source string, computed_at string""",
    "communities": """id int, size int, n_int int, n_ext int, members array<string>, top5 array<string>, ext_doms array<struct<dom:string,n:bigint>>,
        top_words array<struct<w:string,n:bigint>>, first string, last string, n_emails bigint""",
}
TABLES = tuple(_DDL)


def schema(table: str) -> StructType:
    """Needs a session, which parses the declaration."""
    return StructType.fromDDL(_DDL[table])


def migrate(df: DataFrame, table: str) -> DataFrame:
    """Adds the columns of ``table`` that ``df`` lacks, as nulls; rows and other columns stay."""
    have = set(df.columns)
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema(table) if f.name not in have})
