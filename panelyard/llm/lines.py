"""Line deduplication by a deletion-neighbourhood join, in column functions alone.

Lines equal up to one edited character (inserted, deleted or replaced) are duplicates; of each the earliest in
the corpus, by (doc_id, text hash, position), stays.  Two lines within one edit give an equal string
when the edited character is deleted, so equal hashed variants find every such pair.

Variants are emitted only where they can meet another line.  One edit leaves the first or the second half
of a line as it was, and everything outside any window that holds it: lines first look for a partner by the
hashes of their halves, then by what lies outside windows of the line, and only then is each single
position of a matching window deleted.  Filters lose nothing: both lines of a pair pass them alike.

Lines are distinct before variants are made, so the group of a variant holds at most one line per inserted
character, whatever the number of copies.  Hot halves are counted by partial aggregates.

Defined cases: null texts have no lines and stay null; blank lines always stay; lines shorter than ``least``
characters are duplicates only if equal; rows that repeat id and text are one row and keep
the same lines; null ids come last; further columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyard.session import stored

LEAST = 16
WINDOW = 16
WINDOWS = 64  # at most so many windows of a line; longer lines have wider ones
LAST_ID = (1 << 63) - 1
ORDER = ("o_doc", "o_hash", "o_pos")


def with_row_key(docs: DataFrame) -> DataFrame:
    """Adds the sortable id and the hash of the text, which name a row."""
    return docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID))).withColumn(
        "__hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def hashes(line: Column) -> list[Column]:
    """The two hashes that name a line."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), F.reverse(line)).alias("k2")]


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line that isn't blank: its row, position, two hashes, length and the hashes of its halves."""
    rows = with_row_key(docs.select("doc_id", F.col("text").cast("string").alias("text"))).where("text IS NOT NULL")
    found = rows.select(F.col("__doc").alias("o_doc"), F.col("__hash").alias("o_hash"),
                        F.posexplode(F.split("text", "\n", -1)).alias("o_pos", "line"))
    found = found.where(F.trim(F.regexp_replace("line", "[\\x09-\\x0D]", " ")) != "")
    return found.select(*ORDER, "line", *hashes(F.col("line")), F.char_length("line").alias("chars"))


def outside(line: Column, m: Column, start: Column, width: Column) -> Column:
    """Hash of what an edit within [start, start + width) of a pair of longest length ``m`` leaves equal."""
    tail = F.greatest(m - start - width, F.lit(0))
    return F.xxhash64(m, start, line.substr(F.lit(1), start), line.substr(F.char_length(line) - tail + 1, tail))


def half(chars: Column, which: int) -> tuple[Column, Column, Column]:
    """(m, start, width) of half ``which``: the first or second one, for a partner as long or shorter (m = chars) or a longer one."""
    m = chars + which // 2
    middle = F.floor((m - 1) / 2).cast("int")
    return (m, F.lit(0), middle) if which % 2 == 0 else (m, middle, m - middle)


def half_keys(line: Column, chars: Column) -> list[Column]:
    """The keys of the four halves of a long line; they hold m and start, so equal keys mean equal halves."""
    return [F.when(chars >= LEAST, outside(line, *half(chars, which))).alias(f"half{which}") for which in range(4)]


def met(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (key, ...) whose key another line has too."""
    shared = keys.groupBy("key").count().where("count > 1").select(F.col("key").alias("s_key"))
    return keys.join(shared, F.col("key") == F.col("s_key"), "left_semi")


def near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """k1, k2 of the lines that have an earlier line within one edit.  ``firsts``: first place of each distinct line.

    What travels to find partners is a key and the place of the line's half, as few numbers; lines are read again from their first places.
    """
    long = firsts.where(F.col("chars") >= LEAST)
    four = F.array(*(F.struct(F.col(f"half{which}").alias("key"), (F.col("o_pos").cast("bigint") * 4 + which).alias("at")) for which in range(4)))
    keys = long.select("o_doc", "o_hash", F.explode(four).alias("h")).select("h.key", "o_doc", "o_hash", "h.at")
    places = met(keys).groupBy("o_doc", "o_hash").agg(F.collect_set("at").alias("asked"))

    # the texts of those lines, from the rows where they stand first
    rows = with_row_key(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("__doc", "__hash", "text")
    rows = rows.join(places, (F.col("__doc") == F.col("o_doc")) & (F.col("__hash") == F.col("o_hash")))
    at = F.floor(F.col("at") / 4).cast("int")
    split = rows.select("o_doc", "o_hash", F.split("text", "\n", -1).alias("all"), F.explode("asked").alias("at"))
    split = split.select("o_doc", "o_hash", at.alias("o_pos"), (F.col("at") % 4).cast("int").alias("which"), F.col("all")[at].alias("line"))
    split = split.withColumn("chars", F.char_length("line"))
    four = F.array(*(F.struct(*(c.alias(n) for n, c in zip(("m", "start", "width"), half(F.col("chars"), which)))) for which in range(4)))
    lines = split.select("o_doc", "o_hash", "o_pos", *hashes(F.col("line")), "line", F.element_at(four, F.col("which") + 1).alias("p"))
    lines = lines.groupBy("o_doc", "o_hash", "o_pos", "k1", "k2", "line").agg(F.collect_set("p").alias("parts"))
    lines = stored(lines, "lines")

    # windows of the half that differs
    part = lines.select("k1", "k2", *ORDER, "line", F.explode("parts").alias("p")).select("k1", "k2", *ORDER, "line", "p.*")
    step = F.greatest(F.lit(WINDOW), F.ceil(F.col("m") / WINDOWS).cast("int"))
    part = part.withColumn("step", step).withColumn("stop", F.greatest(F.col("start"), F.least(F.col("start") + F.col("width"), F.col("m")) - 1))
    windows = part.select("k1", "k2", *ORDER, "line", "m", "step",
                          F.explode(F.expr("sequence(start, stop, step)")).alias("start"))
    windows = windows.withColumn("key", outside(F.col("line"), F.col("m"), F.col("start"), F.col("step")))
    slim = met(windows.select("key", "k1", "k2", "m", "start", "step").distinct())
    slim = slim.groupBy("k1", "k2").agg(F.collect_list(F.struct("m", "start", "step")).alias("windows"))

    # single deletions
    asked = lines.select("k1", "k2", *ORDER, "line").join(slim, ["k1", "k2"])
    asked = asked.select("k1", "k2", *ORDER, "line", F.explode("windows").alias("w")).select("k1", "k2", *ORDER, "line", "w.*")
    line, chars = F.col("line"), F.char_length("line")
    whole = F.array(F.struct(F.lit(-1).alias("at"), F.xxhash64("line").alias("v"), F.lit(True).alias("short")))
    without = F.transform(
        F.sequence(F.col("start"), F.least(F.col("start") + F.col("step"), chars) - 1),
        lambda i: F.struct(i.alias("at"), F.xxhash64(F.concat(line.substr(F.lit(1), i), line.substr(i + 2, chars))).alias("v"),
                           F.lit(False).alias("short")))
    single = asked.select("k1", "k2", *ORDER, "m", F.explode(F.when(chars < F.col("m"), whole).when(
        F.col("start") < chars, without)).alias("d")).select("k1", "k2", *ORDER, "m", "d.*").distinct()
    me = F.struct(*ORDER, "k1", "k2")
    replaced = Window.partitionBy("m", "at", "v")  # a replaced character: the same string without the same position
    inserted = Window.partitionBy("m", "v")  # an inserted one: the shorter line is the longer without one
    found = single.select(
        "k1", "k2", *ORDER,
        F.when(~F.col("short"), F.min(F.when(~F.col("short"), me)).over(replaced)).alias("same"),
        F.min(F.when(F.col("short"), me)).over(inserted).alias("short_one"), F.min(F.when(~F.col("short"), me)).over(inserted).alias("long_one"),
        "short")
    other = F.when(F.col("short"), F.col("long_one")).otherwise(F.least("same", "short_one"))
    witness = found.withColumn("w", other).where(F.col("w") < me).groupBy("k1", "k2").agg(F.min("w").alias("w"))

    # verify on the texts
    left = witness.select("k1", "k2", F.col("w.k1").alias("w1"), F.col("w.k2").alias("w2")).join(lines.select("k1", "k2", "line"), ["k1", "k2"])
    right = lines.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), F.col("line").alias("other"))
    return left.join(right, ["w1", "w2"]).where(F.levenshtein("line", "other", 1).between(0, 1)).select("k1", "k2")


def removals(docs: DataFrame) -> DataFrame:
    """Per row (__doc, __hash) with removed lines: their positions, and how many of them only resemble an earlier line."""
    all_lines = occurrences(docs)
    keyed = all_lines.select("k1", "k2", *ORDER, "chars", *half_keys(F.col("line"), F.col("chars")))
    four = [f"half{which}" for which in range(4)]
    firsts = keyed.groupBy("k1", "k2").agg(F.min(F.struct(*ORDER)).alias("o"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("chars", *four)))
    firsts = stored(firsts.select("k1", "k2", "o.*", "n", "chars", *four), "firsts")
    near = near_lines(docs, firsts).withColumn("near", F.lit(True))
    gone = firsts.select("k1", "k2", *(F.col(c).alias(f"first_{c}") for c in ORDER), "n").join(near, ["k1", "k2"], "left").where(
        (F.col("n") > 1) | F.col("near"))
    where = all_lines.select("k1", "k2", *ORDER).join(gone, ["k1", "k2"])
    first = (F.col("o_doc") == F.col("first_o_doc")) & (F.col("o_hash") == F.col("first_o_hash")) & (F.col("o_pos") == F.col("first_o_pos"))
    lost = where.where(~first | F.col("near"))
    return lost.groupBy(F.col("o_doc").alias("r_doc"), F.col("o_hash").alias("r_hash")).agg(
        F.collect_set("o_pos").alias("gone"), F.count_distinct(F.when(first, F.col("o_pos"))).alias("n_near"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` and three columns: __lines (all), __kept (those that stay, in order) and __near."""
    rows = with_row_key(docs)
    lost = removals(docs)
    rows = rows.join(lost, (F.col("__doc") == F.col("r_doc")) & (F.col("__hash") == F.col("r_hash")), "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i))
    return rows.withColumn("__lines", lines).withColumn(
        "__kept", F.when(F.col("gone").isNull(), F.col("__lines")).otherwise(kept)).withColumn(
        "__near", F.coalesce("n_near", F.lit(0).cast("bigint"))).drop("__doc", "__hash", "r_doc", "r_hash", "gone", "n_near")


def dedup_lines(docs: DataFrame, keep_emptied: bool = True) -> DataFrame:
    """``docs`` with repeated and nearly repeated lines taken out of the texts; n_chars, if there, follows the text.

    Without ``keep_emptied``, documents that had words and have none left go; documents that were blank before stay.
    """
    rows = without_repeats(docs)
    if not keep_emptied:
        def some(lines: str) -> Column:
            return F.exists(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

        rows = rows.where(F.coalesce(some("__kept") | ~some("__lines"), F.lit(True)))
    text = F.array_join("__kept", "\n")
    changed = {"text": F.when(F.col("text").isNotNull(), text)}
    if "n_chars" in docs.columns:
        size = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.size("__kept") < F.size("__lines"), size).otherwise(F.col("n_chars"))
    return rows.withColumns(changed).select(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, lines in all, lines removed, those of them removed for a near line, and the md5 of the text that stays."""
    rows = without_repeats(docs.select("doc_id", "text"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("bigint")
    kept = F.when(F.col("text").isNull(), 0).otherwise(F.size("__kept")).cast("bigint")
    return rows.select("doc_id", n.alias("n_lines"), (n - kept).alias("n_removed"), F.col("__near").alias("n_near"),
                       F.md5(F.coalesce(F.array_join("__kept", "\n"), F.lit(""))).alias("kept_md5"))
