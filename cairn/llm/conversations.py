"""Conversations from message rows.

Messages of a channel (here: of a session) are ordered by time, split where the channel was silent for longer than a gap, given the role
of user or assistant, numbered by the user messages that open turns, and kept only where the whole conversation is sound and every turn
has a reply. The gap is calibrated from the data or given. There are two calibrations: where conversations are stored as channels (sessions), the gap is the longest silence that any of them holds, over all
rows (``stored_gap``), so no stored one is parted; where nothing is known of them, it is the silence that best separates the pauses within from those between (``calibrated_gap``).

Scale: no window runs over a whole channel. Rows are windowed within (channel, day); what crosses days (running numbers, the silence before
a day's first message) is carried by one summary row per channel and day. Turns and conversations are plain aggregations, so a channel with a
third of all rows is spread over its days and pre-aggregated before each shuffle.

Defined cases: a message delivered several times counts once, as last received (ties: the greatest row); rows without id or channel are
ignored; a spoken message without time cannot be placed, so its conversation is damaged and dropped; a null or blank speaker is decided by the
one text column that is filled; unknown speakers, meta and side-chain rows (null flags count as false) and blank texts are not spoken; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.durable import durable

#: Spellings of the two speakers, without case and surrounding space.
USERS = ("user", "human", "you", "me", "customer", "prompter")
ASSISTANTS = ("assistant", "ai", "model", "bot", "agent")


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def spoken(rows: DataFrame, channel: list[str], user_text: str = "user_text", reply_text: str = "reply_text", texts: bool = True) -> DataFrame:
    """Distinct spoken messages: channel columns, ``message_id``, ``at``, ``is_user``, ``stored_number`` and, if asked for, ``text``."""
    said = F.lower(F.trim("speaker"))
    user, reply = _filled(user_text), _filled(reply_text)
    unknown = F.coalesce(said == "", F.lit(True))
    is_user = F.when(unknown, F.when(user & ~reply, True).when(reply & ~user, False)).when(said.isin(*USERS), True).when(said.isin(*ASSISTANTS), False)
    text = F.when(is_user, F.when(user, F.col(user_text)).otherwise(F.col(reply_text))).otherwise(F.when(reply, F.col(reply_text)).otherwise(F.col(user_text)))
    heard = is_user.isNotNull() & (user | reply) & ~F.coalesce(F.col("is_meta"), F.lit(False)) & ~F.coalesce(F.col("is_sidechain"), F.lit(False))
    taken = [F.col(c) for c in channel] + [F.col("turn_timestamp").alias("at"), is_user.alias("is_user"), F.col("turn_number").cast("bigint").alias("stored_number"), heard.alias("heard")]
    if texts:
        taken.append(text.alias("text"))
    whole = rows.where("message_id is not null").select("message_id", "received_at", F.struct(*taken).alias("row"))
    latest = whole.groupBy("message_id").agg(F.max(F.struct("received_at", "row")).alias("last"))
    known = " and ".join(f"{c} is not null" for c in channel)
    return latest.select(F.col("message_id").cast("bigint").alias("message_id"), "last.row.*").where(f"heard and {known}").drop("heard")


def calibrated_gap(paused: DataFrame) -> DataFrame:
    """One row: ``gap_s``, the silence that best separates the pauses within conversations from those between them.

    Pauses are counted in 96 bins of their logarithm over all rows; the cut is the one with the greatest variance between its two sides
    (Otsu's). Fewer than two pauses: null, which splits nowhere.
    """
    pauses = paused.where("pause_s > 0")
    bins = pauses.groupBy(F.least(F.lit(95), F.floor(F.log2("pause_s") * 4).cast("int")).alias("bin")).agg(F.count("*").alias("n")).where("bin is not null")
    # At most 96 rows, whatever the input: the prefix sums are a join of these with themselves.
    cut = bins.select(F.col("bin").alias("cut"))
    sides = cut.join(bins).groupBy("cut").agg(
        F.sum(F.when(F.col("bin") <= F.col("cut"), F.col("n")).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col("bin") > F.col("cut"), F.col("n")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col("bin") <= F.col("cut"), F.col("n") * F.col("bin")).otherwise(0)).alias("m0"),
        F.sum(F.when(F.col("bin") > F.col("cut"), F.col("n") * F.col("bin")).otherwise(0)).alias("m1"),
    )
    between = F.when((F.col("n0") > 0) & (F.col("n1") > 0), F.col("n0") * F.col("n1") * F.pow(F.col("m0") / F.col("n0") - F.try_divide("m1", "n1"), 2.0))
    # Of equal cuts (an empty stretch between two heaps) the middle one.
    best = sides.select("cut", between.alias("v")).where("v is not null")
    top = best.agg(F.max("v").alias("v"))
    return best.join(top, "v").agg(F.pow(2.0, (F.avg("cut") + 1) / 4).alias("gap_s"))


def stored_gap(paused: DataFrame) -> DataFrame:
    """One row: ``gap_s``, the longest pause within any stored channel; null without pauses, which splits nowhere."""
    return paused.agg(F.max("pause_s").alias("gap_s"))


def with_pause(messages: DataFrame, channel: list[str]) -> DataFrame:
    """With ``pause_s``, the seconds since the channel's message before; null for its first."""
    day = messages.where("at is not null").withColumn("day", F.to_date("at"))
    within = Window.partitionBy(*channel, "day").orderBy("at", "message_id")
    spans = day.groupBy(*channel, "day").agg(F.max("at").alias("last"))
    before = spans.withColumn("before", F.lag("last").over(Window.partitionBy(*channel).orderBy("day"))).drop("last")
    lagged = day.withColumn("lag", F.lag("at").over(within)).join(before, [*channel, "day"])
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return lagged.withColumn("pause_s", seconds("at") - F.coalesce(seconds("lag"), seconds("before"))).drop("lag", "before")


def _running(df: DataFrame, keys: list[str], flag: Column, name: str) -> DataFrame:
    """The running count of a flag in a channel's order, by day and then over the days' sums; expects ``day``."""
    within = Window.partitionBy(*keys, "day").orderBy("at", "message_id").rowsBetween(Window.unboundedPreceding, 0)
    days = df.groupBy(*keys, "day").agg(F.sum(flag.cast("bigint")).alias("n"))
    over = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select(*keys, "day", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("offset"))
    return df.withColumn(name, F.sum(flag.cast("bigint")).over(within)).join(offsets, [*keys, "day"]).withColumn(name, F.col(name) + F.col("offset")).drop("offset")


def turns(rows: DataFrame, channel: list[str], *, gap: float | str | None = None, check_numbers: bool = True, texts: bool = True) -> DataFrame:
    """The turns of whole conversations: channel, (``conversation``, from 1, if split by a gap), ``turn_number``, ``user_message_id``,
    ``reply_message_id``, ``turn_timestamp`` and, with ``texts``, ``user_text`` and ``reply_text``.

    ``gap``: seconds of silence that end a conversation, ``"calibrated"``, ``"stored"``, or None. ``check_numbers``: a conversation in which a stored number differs
    from the turn's is damaged.
    """
    messages = durable(spoken(rows, channel, texts=texts), "messages")
    lost = messages.where("at is null").select(*channel).distinct()
    placed = messages.where("at is not null")
    keys = list(channel)
    if gap is not None:
        paused = durable(with_pause(placed, channel), "paused") if isinstance(gap, str) else with_pause(placed, channel)
        if gap in ("calibrated", "stored"):
            calibrate = calibrated_gap if gap == "calibrated" else stored_gap
            paused = paused.join(F.broadcast(calibrate(paused)))  # one row
        else:
            paused = paused.withColumn("gap_s", F.lit(float(gap)))
        opens = F.coalesce(F.col("pause_s") > F.col("gap_s"), F.col("pause_s").isNull())
        placed = _running(paused, channel, opens, "conversation").drop("pause_s", "gap_s")
        keys.append("conversation")
    else:
        placed = placed.withColumn("day", F.to_date("at"))
    numbered = _running(placed, keys, F.col("is_user"), "turn_number")
    order = F.struct("at", "message_id")
    reply = F.max(F.when(~F.col("is_user"), F.struct(order, *(["text"] if texts else []))))
    user = F.max(F.when(F.col("is_user"), F.struct(order, *(["text"] if texts else []))))
    wrong = F.coalesce(F.col("stored_number") != F.col("turn_number"), F.lit(False)) if check_numbers else F.lit(False)
    each = numbered.groupBy(*keys, "turn_number").agg(user.alias("u"), reply.alias("r"), F.max(wrong).alias("wrong"))
    sound = F.col("u").isNotNull() & F.col("r").isNotNull() & ~F.col("wrong")
    # One row a damaged conversation: no window over a conversation's turns.
    damaged = each.groupBy(*keys).agg(F.min(sound).alias("whole")).where("not whole").select(*keys)
    out = each.join(damaged, keys, "left_anti").join(lost, channel, "left_anti")
    columns = [*keys, "turn_number", F.col("u.col1.message_id").alias("user_message_id"), F.col("r.col1.message_id").alias("reply_message_id"), F.col("u.col1.at").alias("turn_timestamp")]
    return out.select(*columns, *([F.col("u.text").alias("user_text"), F.col("r.text").alias("reply_text")] if texts else []))
