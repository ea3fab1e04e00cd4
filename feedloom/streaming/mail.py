"""F9 and I13 as a stream: drafts meet the mailbox in an interval join, and a draft's state goes when its days are over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAIL = "message_id string, folder string, address string, internal_date timestamp, snippet string"


def follow_drafts(drafts: DataFrame, mailbox: DataFrame, days: int = 14, late: str = "1 day") -> DataFrame:
    """What became of each draft (id, recruiter_email, drafted_at) within `days`, once these are over on both streams.

    A draft was sent if a message to its address follows it, the latest counts; it bounced if a bounce follows that message, else
    it is verified; without a message it was discarded. Drafts that no mail answers come out of the outer join. Watermarks on
    both sides let the join drop mail that no draft can still ask for, and drafts that have their answer; the sums of a draft
    hold two messages at most, however busy its address is.
    """
    asked = drafts.select("id", "recruiter_email", "drafted_at").withWatermark("drafted_at", late)
    mail = mailbox.where("folder IN ('sent', 'bounce')").select("address", "folder", "internal_date", "message_id", "snippet").withWatermark("internal_date", late)
    within = (F.col("recruiter_email") == F.col("address")) & (F.col("internal_date") > F.col("drafted_at")) & (F.col("internal_date") <= F.col("drafted_at") + F.expr(f"INTERVAL {days} DAYS"))
    met = asked.join(mail, within, "left_outer").select("id", "drafted_at", "folder", F.struct("internal_date", "message_id", "snippet").alias("m"))
    # The latest message of a kind answers for all of them: a bounce follows the last sending just if the last bounce does.
    last = lambda kind: F.max(F.when(F.col("folder") == kind, F.col("m")))
    told = met.groupBy("id", "drafted_at").agg(last("sent").alias("s"), last("bounce").alias("b"))
    bounced = F.col("b.internal_date") > F.col("s.internal_date")
    status = F.when(F.col("s").isNull(), "discarded").when(bounced, "bounced").otherwise("verified")
    return told.select("id", "drafted_at", F.col("s.internal_date").alias("sent_at"), F.col("s.message_id").alias("message_id"), F.when(bounced, F.col("b.internal_date")).alias("bounced_at"), F.when(bounced, F.col("b.snippet")).alias("failure_detail"), status.alias("status"))
