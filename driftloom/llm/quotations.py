"""Chat formatting by quotation linking: quotes lead to the messages they come from, and conversations are read in order of reply.

A line's quote level is the number of ``>`` at its start. What a message says itself is its lines of level 0, without the line that
announces a quote ("... wrote:" before a quoted line). Quoted lines of one level that follow each other are a block. Passages of a
block are its lines, its sentences of ``LEAST_WORDS`` words, its paragraphs and the whole; all blocks of a level together are one
more. Own passages are lines, sentences, paragraphs and the whole. A line of fewer words equals own lines only, and gives way to
longer matches. Passages are normalised (lower case, letters and digits only, so wrapping does not matter) and hashed; a quote's
original is the first message of the conversation that holds the passage as its own. A message replies to the latest original among its
quotes of the lowest level. Roots and depths follow by pointer jumping, so rounds grow with the logarithm of the longest chain.

Order of reply: by the turn of the root, depth, turn. Messages come after what they reply to; without quotes the order is that of
the turns. DataFrame functions only. Only narrow rows are shuffled: (conversation, hash, turn), minima combined before; a
conversation that holds a third of all rows is range-partitioned like any other, and never gathered.

A null text is empty. Messages without conversation or turn are linked with nothing and stay, in an order of nulls first. Repeated
(conversation, turn) rows share parent and root. Columns ``conv_id, turn, role, text`` are read, others are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.meeting import meet
from driftloom.llm.ordering import with_places
from driftloom.operators.once import with_once
from driftloom.session import reliable_checkpoint

LEAST_WORDS = 4

PARAGRAPHS = r"\n[ \t]*\n"
#: Between sentences: after their last mark, or between paragraphs.
SENTENCES = r"(?<=[.!?]|[.!?][\"')\]])\s+|(?<=[。！？])|" + PARAGRAPHS

PREFIX = r"^((?:[ \t]{0,3}>)+) ?"
ANNOUNCES = r"(?i)\bwrote:\s*$"


def normal(text: Column) -> Column:
    """A passage for comparison: letters and digits in lower case, one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own, quotes): the text without quotes, and (level, line) of quoted lines."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda line, at: F.struct(F.length(F.translate(F.regexp_extract(line, PREFIX, 1), " \t", "")).alias("level"), F.regexp_replace(line, PREFIX, "").alias("line"), at.alias("at")))
    rows = with_once(messages.select("conv_id", "turn", "role", "text"), "_lines", lines).drop("text")
    after = F.slice("_lines", 2, F.greatest(F.size("_lines"), F.lit(1)))
    said = F.zip_with("_lines", after, lambda a, b: F.when((a.level == 0) & ~(a.line.rlike(ANNOUNCES) & F.coalesce(b.level > 0, F.lit(False))), a.line))
    own = F.array_join(F.filter(said, lambda line: line.isNotNull()), "\n")
    return rows.select("conv_id", "turn", "role", own.alias("own"), F.filter("_lines", lambda x: x.level > 0).alias("quotes"))


def passages(text: Column, least: int) -> Column:
    """(hash, long) of a text's lines, paragraphs, sentences of ``least`` words, and whole. Short lines have hashes of their own."""
    words = lambda p: F.size(F.split(p, " "))
    cut = lambda pattern: F.transform(F.split(text, pattern), normal)
    lines = cut("\n")
    sentences = F.filter(cut(SENTENCES), lambda p: words(p) >= least)
    whole = F.concat(F.filter(lines, lambda p: words(p) >= LEAST_WORDS), sentences, cut(PARAGRAPHS), F.array(normal(text)))
    short = F.filter(lines, lambda p: (p != "") & (words(p) < LEAST_WORDS))
    hashed = F.transform(F.array_distinct(F.filter(whole, lambda p: p != "")), lambda p: F.struct(F.xxhash64(p).alias("hash"), F.lit(True).alias("long")))
    return F.concat(hashed, F.transform(F.array_distinct(short), lambda p: F.struct(F.xxhash64(p, F.lit("line")).alias("hash"), F.lit(False).alias("long"))))


def parents(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): the turn that each quoting message replies to. ``messages``: as ``parsed``."""
    known = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    levels = F.array_distinct(F.transform("quotes", lambda q: q.level))
    quoting = known.filter(F.size("quotes") > 0).select("conv_id", "turn", "quotes", F.explode_outer(levels).alias("level"))
    held = with_once(quoting, "held", F.filter("quotes", lambda q: q.level == F.col("level")))
    # A mark stands where a block ends.
    line = lambda q: F.translate(q.line, "\0", " ")
    marked = F.transform("held", lambda q, k: F.when((k > 0) & (F.get("held", k - 1).at + 1 != q.at), F.concat(F.lit("\0"), line(q))).otherwise(line(q)))
    blocks = with_once(held.select("conv_id", "turn", "level", F.array_join(marked, "\n").alias("text")), "blocks", F.split("text", "\n?\0"))
    together = F.struct(F.xxhash64(normal(F.col("text"))).alias("hash"), F.lit(True).alias("long"))
    every = F.concat(F.flatten(F.transform("blocks", lambda b: passages(b, LEAST_WORDS))), F.when(normal(F.col("text")) != "", F.array(together)).otherwise(F.array().cast("array<struct<hash:bigint,long:boolean>>")))
    quotes = blocks.select("conv_id", "turn", "level", F.explode_outer(F.array_distinct(every)).alias("p")).select("conv_id", "turn", "level", "p.*").filter("hash IS NOT NULL")
    # Own passages matter where somebody quotes.
    candidates = meet(known.select("conv_id", "turn", "own"), quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    own = candidates.select("conv_id", "turn", F.explode_outer(passages(F.col("own"), 1)).alias("p")).select("conv_id", "turn", "p.hash").filter("hash IS NOT NULL")
    originals = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    found = quotes.join(originals, ["conv_id", "hash"]).filter("origin < turn")
    best = F.max(F.struct((-F.col("level")).alias("nearness"), "long", "origin")).alias("best")
    return found.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("best.origin").alias("parent"))


def roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root, depth) of every message that replies to another."""
    far = reliable_checkpoint(links.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    while True:
        further = far.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        joined = far.join(further, ["conv_id", "root"], "left")
        new = joined.select("conv_id", "turn", "parent", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_root").isNotNull().alias("moved"))
        new = reliable_checkpoint(new)
        moved = new.filter("moved").limit(1).count()
        far = new.drop("moved")
        if not moved:
            return far


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, parent_turn, root_turn, depth, position): messages without quotes, and their place from 0
    in the conversation's order of reply."""
    rows = reliable_checkpoint(parsed(messages))
    linked = rows.join(roots(parents(rows)), ["conv_id", "turn"], "left")
    named = linked.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.size("quotes").alias("n_quotes"), F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth")
    )
    placed = reliable_checkpoint(with_places(named, ["conv_id", "root_turn", "depth", "turn", "role"]))
    first = placed.groupBy("conv_id").agg(F.min("place").alias("_first"))
    joined = placed.alias("m").join(first.alias("f"), F.col("m.conv_id").eqNullSafe(F.col("f.conv_id")))
    return joined.select(*(f"m.{c}" for c in named.columns), (F.col("place") - F.col("_first")).alias("position"))
