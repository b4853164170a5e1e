"""Chat formatting by quotation linking, with DataFrame functions only.

A message's lines carry quote marks (``>``, ``>>``, ``> >``); their number is the
level. A run of lines of one level is a passage: its line ends count as spaces, so
a quote that was wrapped anew is the same passage. Runs, their paragraphs and their
lines are normalised and hashed; quoted ones are joined to those that earlier
messages of the conversation say themselves. 256 bits of SHA-2 stand for a text, so
that texts needn't be dealt out and compared to tell them apart. The message
that says the longest passage quoted at the lowest level found is what the quoting
one replies to, of equally long ones the latest. Messages are laid out without
quotes in reply order: each thread together, by the turn of its first message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

MARKS = r"^([ \t]*>)+"
#: Turns in one group of the search for origins and of places; what comes before is carried over.
BLOCK = 1024
END = "\n"


def passage(column: Column) -> Column:
    """Lower-cased, white space made one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(column), r"\s+", " "))


def quoted_lines(messages: DataFrame) -> DataFrame:
    """The messages with ``lines``: (level, body) of each line of a whole text; null counts as empty."""
    lines = F.split(F.coalesce("text", F.lit("")), END)
    marks = lambda x: F.regexp_extract(x, MARKS, 0)
    level = lambda x: F.length(marks(x)) - F.length(F.replace(marks(x), F.lit(">"), F.lit("")))
    return messages.withColumn("lines", F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS + " ?", "").alias("body"))))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (the text without quotes, trimmed) and ``units``: (level, hash, length) of the passages that its runs, paragraphs and lines make, distinct."""
    parsed = quoted_lines(messages.select("conv_id", "turn", "role", "text"))
    own = F.filter("lines", lambda x: x["level"] == 0)
    # a run begins where the level differs from the line before
    begins = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (i == 1) | (F.get("lines", i - 1)["level"] != F.get("lines", i - 2)["level"]))
    parsed = parsed.withColumn("begins", begins)
    spans = F.transform("begins", lambda b, k: F.struct(b.alias("at"), (F.coalesce(F.get("begins", k + 1), F.size("lines") + 1) - b).alias("n")))
    runs = F.transform(spans, lambda s: F.struct(F.get("lines", s["at"] - 1)["level"].alias("level"), F.array_join(F.transform(F.slice("lines", s["at"], s["n"]), lambda x: x["body"]), END).alias("body")))
    parsed = parsed.withColumn("runs", runs)
    parts = lambda pattern: F.flatten(F.transform("runs", lambda r: F.transform(F.split(r["body"], pattern), lambda p: F.struct(r["level"].alias("level"), passage(p).alias("passage")))))
    whole = F.transform("runs", lambda r: F.struct(r["level"].alias("level"), passage(r["body"]).alias("passage")))
    found = F.filter(F.array_distinct(F.concat(whole, parts(r"\n[ \t]*\n"), parts(END))), lambda u: u["passage"] != "")
    units = F.transform(found, lambda u: F.struct(u["level"].alias("level"), F.unhex(F.sha2(u["passage"], 256)).alias("hash"), F.length(u["passage"]).alias("long")))
    quoted = F.size(F.array_distinct(F.filter(whole, lambda u: (u["level"] > 0) & (u["passage"] != ""))))
    return parsed.select("conv_id", "turn", "role", F.trim(F.array_join(F.transform(own, lambda x: x["body"]), END)).alias("body"), units.alias("units"), quoted.cast("long").alias("n_quoted"))


def links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to: for each message that quotes, the earlier message that itself says the longest passage quoted at the lowest level found; of equally long ones the latest."""
    placed = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("units").alias("u")).select("conv_id", "turn", "u.level", "u.hash", "u.long")
    quotes = placed.where("level > 0").distinct()
    words = ["conv_id", "hash"]
    key = [*words, "block"]
    # only passages that someone quotes; one said twice in a turn counts once
    said = placed.where("level = 0").select("turn", *words).join(quotes.select(*words).distinct(), words, "left_semi").distinct()
    # one ordered pass a block of turns, so that a passage said and quoted all over a long conversation is many small groups
    both = quotes.select(*words, "turn", "level", "long", F.lit(None).cast("long").alias("origin"))
    both = both.unionByName(said.select(*words, "turn", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("long"), F.col("turn").cast("long").alias("origin")))
    both = both.withColumn("block", F.floor(F.col("turn") / BLOCK))
    # quotes come before what is said in the same turn: an origin is strictly earlier
    inside = Window.partitionBy(*key).orderBy("turn", F.col("origin").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("within", F.last("origin", ignorenulls=True).over(inside)).where("level IS NOT NULL")
    earlier = Window.partitionBy(*words).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy(*key).agg(F.max("origin").alias("last")).withColumn("before", F.max("last").over(earlier)).drop("last")
    found = told.join(blocks, key).withColumn("origin", F.coalesce("within", "before").cast(parsed.schema["turn"].dataType)).where("origin IS NOT NULL")
    best = found.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "long", "origin")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.origin").alias("reply_to"))


def threads(linked: DataFrame) -> DataFrame:
    """The links with ``thread`` and ``depth``: the first message above, and how many replies lie between; by pointer doubling."""
    jumps = materialize(linked.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "jumps")
    while True:
        up = jumps.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        step = jumps.join(up, ["conv_id", "thread"], "left")
        moved = materialize(step.select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "jumps")
        jumps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return jumps


def places(threaded: DataFrame) -> DataFrame:
    """The messages with ``position``, their place in the conversation's reply order (by thread, turn, role, body), from 0.

    Places are counted in blocks of turns and of threads, whose sums are carried
    over, so that a conversation with a third of all messages is many groups.
    """
    sure = threaded.where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("part", F.floor(F.col("turn") / BLOCK)).withColumn("shelf", F.floor(F.col("thread") / BLOCK))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda name, keys, order: F.coalesce(F.sum(name).over(before(keys, order)), F.lit(0))
    parts = sure.groupBy("conv_id", "shelf", "thread", "part").agg(F.count("*").alias("n")).withColumn("a", sums("n", ["conv_id", "shelf", "thread"], "part"))
    whole = parts.groupBy("conv_id", "shelf", "thread").agg(F.sum("n").alias("n")).withColumn("b", sums("n", ["conv_id", "shelf"], "thread"))
    shelves = whole.groupBy("conv_id", "shelf").agg(F.sum("n").alias("n")).withColumn("c", sums("n", ["conv_id"], "shelf"))
    row = F.row_number().over(Window.partitionBy("conv_id", "shelf", "thread", "part").orderBy("turn", "role", "body")) - 1
    joined = sure.withColumn("row", row).join(parts.drop("n"), ["conv_id", "shelf", "thread", "part"]).join(whole.drop("n"), ["conv_id", "shelf", "thread"]).join(shelves.drop("n"), ["conv_id", "shelf"])
    placed = joined.withColumn("position", F.expr("row + a + b + c").cast("long")).select(*threaded.columns, "position")
    return placed.unionByName(threaded.where("conv_id IS NULL OR turn IS NULL").withColumn("position", F.lit(None).cast("long")))


def chat_format(messages: DataFrame) -> DataFrame:
    """A row for each message: conv_id, turn, role, body, n_quoted (quoted passages), reply_to, thread, depth, position.

    By conv_id and position the rows are the conversations in reply order, without
    quotes. A message that quotes nothing, or nothing said before, begins a thread
    of its own. A null text counts as empty. Rows that share conv_id and turn are
    separate messages with one place in links; equal rows come in any order. A
    null conv_id or turn neither links nor is linked and has no position. An empty
    table gives no rows; further columns are not read. No conversation is gathered
    into one row or task, since one may hold a third of all.
    """
    # written once: else each of the plans below parses all texts anew, and exploding an array that is still an expression costs its square
    parsed = materialize(parse(messages), "parsed")
    found = materialize(links(parsed), "links")
    placed = found.join(threads(found), ["conv_id", "turn"])
    joined = parsed.drop("units").join(placed, ["conv_id", "turn"], "left")
    return places(joined.select("conv_id", "turn", "role", "body", "n_quoted", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth")))


def render(formatted: DataFrame, role: str = "<|{}|>") -> DataFrame:
    """conv_id, position and ``chat``, the message under its role; a conversation is its rows by position."""
    one = F.concat(F.format_string(role.replace("{}", "%s"), F.coalesce("role", F.lit("unknown"))), F.lit("\n"), F.coalesce("body", F.lit("")))
    return formatted.select("conv_id", "position", one.alias("chat"))


def with_replies(messages: DataFrame) -> DataFrame:
    """The messages as mail programs would send them: of each three turns, the second quotes the one before it, and the third quotes that with its quote.

    The tables hold next to no quotes, so the query makes its input of the whole
    table by this rule. A turn that is missing isn't quoted; of several messages
    of a turn, the one with the least text is.
    """
    said = messages.where("text IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    back = lambda n, name: said.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(name))
    quote = lambda c: F.concat(F.lit("> "), F.replace(c, F.lit("\n"), F.lit("\n> ")))
    joined = messages.select("conv_id", "turn", "role", "text").join(back(1, "one"), ["conv_id", "turn"], "left").join(back(2, "two"), ["conv_id", "turn"], "left")
    nested = F.coalesce(F.concat(quote(F.col("two")), F.lit("\n"), F.col("one")), F.col("one"))
    above = F.when(F.col("turn") % 3 == 1, quote(F.col("one"))).when(F.col("turn") % 3 == 2, quote(nested))
    return joined.select("conv_id", "turn", "role", F.coalesce(F.concat(above, F.lit("\n"), F.coalesce("text", F.lit(""))), F.col("text")).alias("text"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, made to quote by ``with_replies``, in reply order."""
    return chat_format(with_replies(table(spark, sf_dir, "conversations")))


OP5_SQL = r"""
WITH RECURSIVE said AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL),
near AS (SELECT c.conv_id, c.turn, c.role, c.text, a.text AS one, b.text AS two FROM conversations c
         LEFT JOIN said a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN said b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
sent AS (SELECT conv_id, turn, role, text, CASE turn % 3 WHEN 1 THEN '> ' || replace(one, chr(10), chr(10) || '> ')
                WHEN 2 THEN '> ' || replace(coalesce('> ' || replace(two, chr(10), chr(10) || '> ') || chr(10) || one, one), chr(10), chr(10) || '> ') END AS above FROM near),
m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(above || chr(10) || coalesce(text, ''), text, ''), chr(10)) AS lines FROM sent),
l AS (SELECT rid, conv_id, turn, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM m),
p AS (SELECT rid, conv_id, turn, n, length(regexp_replace(regexp_extract(line, '^([ \t]*>)+'), '[^>]', '', 'g')) AS level,
             regexp_replace(line, '^([ \t]*>)+ ?', '') AS body FROM l),
r AS (SELECT *, n - row_number() OVER (PARTITION BY rid, level ORDER BY n) AS g FROM p),
run AS (SELECT rid, conv_id, turn, level, string_agg(body, chr(10) ORDER BY n) AS body FROM r GROUP BY rid, conv_id, turn, level, g),
part AS (SELECT rid, conv_id, turn, level, body, true AS whole FROM run
         UNION ALL SELECT rid, conv_id, turn, level, unnest(string_split_regex(body, '\n[ \t]*\n')), false FROM run
         UNION ALL SELECT rid, conv_id, turn, level, unnest(string_split(body, chr(10))), false FROM run),
h AS (SELECT rid, conv_id, turn, level, passage, bool_or(whole) AS whole FROM (SELECT *, trim(regexp_replace(lower(body), '\s+', ' ', 'g'), ' ') AS passage FROM part) WHERE passage != '' GROUP BY ALL),
q AS (SELECT a.conv_id, a.turn, b.turn AS origin, a.level, length(a.passage) AS long FROM h a JOIN h b ON a.conv_id = b.conv_id AND a.passage = b.passage AND b.level = 0 AND b.turn < a.turn WHERE a.level > 0),
links AS (SELECT conv_id, turn, origin AS reply_to FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, long DESC, origin DESC) AS best FROM q) WHERE best = 1),
up AS (SELECT conv_id, turn, reply_to AS thread, CAST(1 AS BIGINT) AS depth FROM links
       UNION ALL SELECT up.conv_id, up.turn, links.reply_to, up.depth + 1 FROM up JOIN links ON links.conv_id = up.conv_id AND links.turn = up.thread),
top AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM up GROUP BY ALL),
bodies AS (SELECT rid, trim(coalesce(string_agg(body, chr(10) ORDER BY n) FILTER (level = 0), ''), ' ') AS body FROM p GROUP BY rid),
counts AS (SELECT rid, count(*) AS n_quoted FROM h WHERE level > 0 AND whole GROUP BY rid),
found AS (SELECT m.conv_id, m.turn, m.role, bodies.body, coalesce(n_quoted, 0) AS n_quoted, reply_to, coalesce(top.thread, m.turn) AS thread, coalesce(top.depth, 0) AS depth
          FROM m JOIN bodies USING (rid) LEFT JOIN counts USING (rid) LEFT JOIN links ON links.conv_id = m.conv_id AND links.turn = m.turn LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn)
SELECT *, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn, role NULLS FIRST, body) - 1 END AS position FROM found
"""
