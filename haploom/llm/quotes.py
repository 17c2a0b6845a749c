"""Chat formatting: quotation linking, in DataFrame functions only.

Lines that begin with ``>`` marks are quoted, as deep as they have marks. A passage is a run of quoted
lines of one depth between blank lines; its words in lower case, parted by single blanks, are hashed.
What a message says itself is hashed in the same way, as a whole, by paragraphs, by lines and by sentences. A passage is
joined to the last earlier message of its conversation that says it, else to the first message of
any other conversation that does; a passage of several sentences that no message says as it is, such as a part of
a paragraph, is looked for by its longest one. A message replies to what its shallowest quotes lead to; replies
are ordered below what they reply to, and bodies come without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haploom.session import staged

#: A quoted line's marks.
MARKS = r"^[ \t]*(?:>[ \t]?)+"
#: A whole quoted line, with the line break after it.
QUOTED_LINE = r"(?m)^[ \t]*>[^\n]*(?:\n|\z)"
#: What ends a sentence, and words of a line or sentence that counts by itself: shorter ones are said too often.
SENTENCE_END = r"[.!?]+[ \t\r\n]+"
UNIT_WORDS = 3
#: Turns in a bucket of the search for the last earlier message.
BUCKET = 256


def _plain(text: Column) -> Column:
    """Words in lower case, parted by single blanks, without a mark at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "), r"[ .!?]+\z", ""))


def _telling(words: Column) -> Column:
    """Whether a line or sentence (as ``_plain``) is long enough to count by itself."""
    return F.size(F.split(words, " ")) >= UNIT_WORDS


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, key, body, has_quotes: each distinct message once, null text as ''."""
    said = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.distinct().withColumn("key", F.md5(F.concat_ws("|", F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")), F.col("text"))))
    has = F.col("text").rlike(r"(?m)^[ \t]*>")
    kept = F.when(has, F.regexp_replace("text", QUOTED_LINE, "")).otherwise(F.col("text"))
    body = F.regexp_replace(kept, r"^[ \t\r\n]+|[ \t\r\n]+\z", "")
    return said.withColumn("has_quotes", has).withColumn("body", body)


def passages(said: DataFrame) -> DataFrame:
    """key, conv_id, turn, run, depth, passage, h, h_part: the quoted passages of messages; ``h_part`` is the hash of the
    longest of several sentences (the first of equal ones), null if there is none that counts by itself."""
    lines = said.where("has_quotes").select("key", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    lines = lines.select("key", "conv_id", "turn", "at", F.length(F.regexp_replace(marks, "[^>]", "")).alias("depth"), F.trim(F.regexp_replace("line", MARKS, "")).alias("words"))
    lines = lines.withColumn("depth", F.when(F.col("words") == "", 0).otherwise(F.col("depth")))
    order = W.partitionBy("key").orderBy("at")
    new = (F.col("depth") != F.coalesce(F.lag("depth").over(order), F.lit(-1))).cast("int")
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(order)).where("depth > 0")
    whole = runs.groupBy("key", "conv_id", "turn", "run", "depth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"]), " ").alias("passage"))
    sentences = F.split("passage", SENTENCE_END)
    longest = F.array_max(F.transform(sentences, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("at"), s.alias("s"))))["s"]
    part = F.when((F.size(sentences) > 1) & _telling(_plain(longest)), F.md5(_plain(longest)))
    return whole.withColumn("h", F.md5(_plain(F.col("passage")))).withColumn("h_part", part).select("key", "conv_id", "turn", "run", "depth", "passage", "h", "h_part")


def originals(said: DataFrame) -> DataFrame:
    """conv_id, turn, h: hashes of what each message says itself, as a whole, by paragraphs, lines and sentences."""
    large = F.transform(F.array_union(F.array("body"), F.split("body", r"\n[ \t\r]*\n")), _plain)
    small = F.transform(F.array_union(F.split("body", "\n"), F.split("body", SENTENCE_END)), _plain)
    units = F.array_union(large, F.filter(small, _telling))
    each = said.where("conv_id IS NOT NULL AND turn IS NOT NULL AND body <> ''").select("conv_id", "turn", F.explode(units).alias("unit"))
    return each.where("unit <> ''").select("conv_id", "turn", F.md5("unit").alias("h"))


def _last_before(asked: DataFrame, said: DataFrame) -> DataFrame:
    """conv_id, turn, h, found: the last turn before each asked one that says h in the same conversation.

    Turns are cut into buckets, so that a long conversation that repeats itself is spread: the last one
    within the bucket, else the last of the buckets before.
    """
    bucket = F.floor(F.col("turn") / BUCKET).alias("bucket")
    wanted = asked.select("conv_id", "h").distinct()
    there = said.join(wanted, ["conv_id", "h"], "left_semi").select("conv_id", "h", "turn", bucket).distinct()
    ask = asked.select("conv_id", "h", "turn", bucket).distinct()
    events = there.select("*", F.col("turn").alias("own")).unionByName(ask.select("*", F.lit(None).cast("long").alias("own")))
    inside = W.partitionBy("conv_id", "h", "bucket").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    near = events.withColumn("near", F.max("own").over(inside)).where("own IS NULL")
    tops = there.groupBy("conv_id", "h", "bucket").agg(F.max("turn").alias("own"))
    marks = tops.unionByName(ask.select("conv_id", "h", "bucket").distinct().withColumn("own", F.lit(None).cast("long")))
    over = W.partitionBy("conv_id", "h").orderBy("bucket").rangeBetween(W.unboundedPreceding, -1)
    far = marks.withColumn("far", F.max("own").over(over)).where("own IS NULL").select("conv_id", "h", "bucket", "far")
    joined = near.join(far, ["conv_id", "h", "bucket"], "left")
    return joined.select("conv_id", "turn", "h", F.coalesce("near", "far").alias("found"))


def link(conversations: DataFrame) -> DataFrame:
    """One row for each distinct message: conv_id, turn, role, body, quote_depth, n_passages, n_linked,
    parent_turn, source_conv, source_turn, thread_turn, reply_depth.

    ``parent_turn``: the turn of the same conversation that the shallowest linked passages lead to (the
    latest of several); ``source_conv`` and ``source_turn``: where no passage of a message is from its
    own conversation, the first message elsewhere that says one. ``thread_turn``: the turn at the
    root of a message's replies, its own without a parent; ``reply_depth``: replies down to it. Sorted by conv_id,
    thread_turn, reply_depth, turn, the rows are reply-ordered conversations without quotes. Null text
    is empty; messages without conv_id or turn stay, unlinked; exact repeats are one row. Messages that
    share conv_id and turn have a parent each, and replies to that turn follow the earliest of those.
    """
    said = staged(messages(conversations), "messages")
    quoted = staged(passages(said), "passages")
    units = originals(said)
    # each passage by its own hash (way 0) and by that of its longest sentence (way 1)
    ways = F.filter(F.array(F.struct(F.lit(0).alias("way"), F.col("h").alias("h")), F.struct(F.lit(1).alias("way"), F.col("h_part").alias("h"))), lambda w: w["h"].isNotNull())
    found = quoted.select("key", "conv_id", "turn", "run", "depth", F.explode(ways).alias("w")).select("key", "conv_id", "turn", "run", "depth", "w.way", "w.h")
    near = _last_before(found.where("conv_id IS NOT NULL AND turn IS NOT NULL"), units)
    first = (
        units.join(found.select("h").distinct(), "h", "left_semi")
        .groupBy("h")
        .agg(F.min(F.struct("conv_id", "turn")).alias("one"))
    )
    at = found.join(near, ["conv_id", "turn", "h"], "left").join(first, "h", "left")
    other = F.when(F.col("one.conv_id") != F.col("conv_id"), F.col("one"))
    best = at.groupBy("key", "run", "depth").agg(F.min_by("found", F.when(F.col("found").isNotNull(), F.col("way"))).alias("found"), F.min_by(other, F.when(other.isNotNull(), F.col("way"))).alias("other"))
    linked = best.withColumn("elsewhere", F.when(F.col("found").isNull(), F.col("other")))
    each = linked.groupBy("key").agg(
        F.max("depth").alias("quote_depth"),
        F.count("*").alias("n_passages"),
        F.sum((F.col("found").isNotNull() | F.col("elsewhere").isNotNull()).cast("long")).alias("n_linked"),
        F.min(F.when(F.col("found").isNotNull(), F.struct(F.col("depth").alias("d"), (-F.col("found")).alias("t")))).alias("best"),
        F.min(F.when(F.col("elsewhere").isNotNull(), F.struct(F.col("depth").alias("d"), F.col("elsewhere.conv_id").alias("c"), F.col("elsewhere.turn").alias("t")))).alias("source"),
    )
    each = each.withColumn("parent_turn", -F.col("best.t"))
    rows = said.drop("text").join(each, "key", "left")
    rows = staged(
        rows.select(
            "conv_id",
            "turn",
            "role",
            "body",
            F.coalesce("quote_depth", F.lit(0)).cast("long").alias("quote_depth"),
            F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            "parent_turn",
            F.when(F.col("parent_turn").isNull(), F.col("source.c")).alias("source_conv"),
            F.when(F.col("parent_turn").isNull(), F.col("source.t")).alias("source_turn"),
        ),
        "linked",
    )
    # roots by doubling: up leads 1, 2, 4 ... replies up, n counts them
    hops = staged(rows.where("parent_turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("up")).withColumn("n", F.lit(1).cast("long")), "hops")
    while True:
        higher = hops.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("upper"), F.col("n").alias("more"))
        longer = staged(hops.join(higher, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("upper", "up").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.col("upper").isNotNull().alias("moved")), "hops")
        hops = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    tops = hops.select("conv_id", F.col("turn").alias("parent_turn"), "up", "n")
    return rows.join(tops, ["conv_id", "parent_turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "body",
        "quote_depth",
        "n_passages",
        "n_linked",
        "parent_turn",
        "source_conv",
        "source_turn",
        F.coalesce("up", "parent_turn", "turn").alias("thread_turn"),
        F.when(F.col("parent_turn").isNull(), F.lit(0)).otherwise(F.coalesce(F.col("n"), F.lit(0)) + 1).cast("long").alias("reply_depth"),
    )


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply-ordered conversations without quotes."""
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same in DuckDB.
SQL = r"""
WITH RECURSIVE said AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), own AS (
  SELECT *, regexp_matches(text, '(?m)^[ \t]*>') AS has_quotes,
    md5(concat_ws('|', conv_id, turn, coalesce(role, ''), text)) AS key,
    regexp_replace(CASE WHEN regexp_matches(text, '(?m)^[ \t]*>') THEN regexp_replace(text, '(?m)^[ \t]*>[^\n]*(?:\n|\z)', '', 'g') ELSE text END,
      '^[ \t\r\n]+|[ \t\r\n]+\z', '', 'g') AS body
  FROM said
), lines AS (
  SELECT key, conv_id, turn, unnest(range(len(l))) AS place, unnest(l) AS line
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM own WHERE has_quotes)
), marked AS (
  SELECT key, conv_id, turn, place, trim(regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', ''), ' ') AS words,
    len(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]?)+', 0), '[^>]', '', 'g')) AS marks
  FROM lines
), deep AS (
  SELECT *, CASE WHEN words = '' THEN 0 ELSE marks END AS depth FROM marked
), numbered AS (
  SELECT *, CASE WHEN depth <> coalesce(lag(depth) OVER (PARTITION BY key ORDER BY place), -1) THEN 1 ELSE 0 END AS new FROM deep
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY key ORDER BY place) AS run FROM numbered
), found AS (
  SELECT key, conv_id, turn, run, depth, string_agg(words, ' ' ORDER BY place) AS passage FROM runs WHERE depth > 0 GROUP BY key, conv_id, turn, run, depth
), parts AS (
  SELECT *, regexp_split_to_array(passage, '[.!?]+[ \t\r\n]+') AS s FROM found
), longest AS (
  SELECT *, list_sort(list_transform(range(len(s)), lambda i: {'n': length(s[i + 1]), 'at': -i, 's': s[i + 1]}), 'DESC')[1].s AS part FROM parts
), asked AS (
  SELECT key, conv_id, turn, run, depth, 0 AS way, trim(regexp_replace(regexp_replace(lower(passage), '[ \t\r\n]+', ' ', 'g'), '[ .!?]+\z', ''), ' ') AS h FROM longest
  UNION ALL SELECT key, conv_id, turn, run, depth, 1, trim(regexp_replace(regexp_replace(lower(part), '[ \t\r\n]+', ' ', 'g'), '[ .!?]+\z', ''), ' ') FROM longest WHERE len(s) > 1 AND len(string_split(trim(regexp_replace(regexp_replace(lower(part), '[ \t\r\n]+', ' ', 'g'), '[ .!?]+\z', ''), ' '), ' ')) >= 3
), units AS (
  SELECT DISTINCT conv_id, turn, h FROM (
    SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(unit), '[ \t\r\n]+', ' ', 'g'), '[ .!?]+\z', ''), ' ') AS h, least FROM (
      SELECT conv_id, turn, unnest(list_concat([body], regexp_split_to_array(body, '\n[ \t\r]*\n'))) AS unit, 0 AS least FROM own WHERE body <> ''
      UNION ALL SELECT conv_id, turn, unnest(list_concat(string_split(body, chr(10)), regexp_split_to_array(body, '[.!?]+[ \t\r\n]+'))), 3 FROM own WHERE body <> ''))
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND h <> '' AND len(string_split(h, ' ')) >= least
), near AS (
  SELECT f.key, f.run, f.way, max(u.turn) AS near_turn FROM asked f JOIN units u ON u.h = f.h AND u.conv_id = f.conv_id AND u.turn < f.turn GROUP BY ALL
), first AS (
  SELECT h, min(struct_pack(c := conv_id, t := turn)) AS one FROM units GROUP BY h
), ways AS (
  SELECT f.key, f.run, f.depth, f.way, n.near_turn, CASE WHEN o.one.c <> f.conv_id THEN o.one END AS other
  FROM asked f LEFT JOIN near n ON n.key = f.key AND n.run = f.run AND n.way = f.way LEFT JOIN first o ON o.h = f.h
), linked AS (
  SELECT key, run, depth, near_turn, CASE WHEN near_turn IS NULL THEN other END AS elsewhere FROM (
    SELECT key, run, depth, arg_min(near_turn, way) FILTER (near_turn IS NOT NULL) AS near_turn, arg_min(other, way) FILTER (other IS NOT NULL) AS other FROM ways GROUP BY ALL)
), each AS (
  SELECT key, max(depth) AS quote_depth, count(*) AS n_passages,
    sum(CASE WHEN near_turn IS NOT NULL OR elsewhere IS NOT NULL THEN 1 ELSE 0 END) AS n_linked,
    min(CASE WHEN near_turn IS NOT NULL THEN struct_pack(d := depth, t := -near_turn) END) AS best,
    min(CASE WHEN elsewhere IS NOT NULL THEN struct_pack(d := depth, c := elsewhere.c, t := elsewhere.t) END) AS source
  FROM linked GROUP BY key
), told AS (
  SELECT o.conv_id, o.turn, o.role, o.body, coalesce(e.quote_depth, 0)::BIGINT AS quote_depth, coalesce(e.n_passages, 0)::BIGINT AS n_passages,
    coalesce(e.n_linked, 0)::BIGINT AS n_linked, (-e.best.t)::BIGINT AS parent_turn,
    CASE WHEN e.best IS NULL THEN e.source.c END AS source_conv, CASE WHEN e.best IS NULL THEN e.source.t END AS source_turn
  FROM own o LEFT JOIN each e ON e.key = o.key
), ups AS (
  SELECT conv_id, turn, min(parent_turn) AS up FROM told WHERE parent_turn IS NOT NULL GROUP BY conv_id, turn
), climb AS (
  SELECT conv_id, turn, up, 1 AS n FROM ups
  UNION ALL
  SELECT c.conv_id, c.turn, u.up, c.n + 1 FROM climb c JOIN ups u ON u.conv_id = c.conv_id AND u.turn = c.up
), tops AS (
  SELECT conv_id, turn, min(up) AS up, max(n) AS n FROM climb GROUP BY conv_id, turn
)
SELECT t.conv_id, t.turn, t.role, t.body, t.quote_depth, t.n_passages, t.n_linked, t.parent_turn, t.source_conv, t.source_turn,
  coalesce(p.up, t.parent_turn, t.turn) AS thread_turn,
  (CASE WHEN t.parent_turn IS NULL THEN 0 ELSE coalesce(p.n, 0) + 1 END)::BIGINT AS reply_depth
FROM told t LEFT JOIN tops p ON p.conv_id = t.conv_id AND p.turn = t.parent_turn
"""
