"""Text cut off by field limits or mid-transfer.

Every value is reduced to a few facts on its length and its end (no text is shuffled). Per source and field, the histogram
of lengths, in characters and in bytes, is tested for spikes at its maximum, or at what is the maximum once few longer
values are peeled off: a limit leaves many values of exactly that length where the lengths below it are sparse. A value
at a spike length is cut unless it ends with terminal punctuation, trails off on purpose or closes with a path, item or
command whose last piece is common. Elsewhere a value is cut if it ends with a mark of the cut, inside a character,
inside an open code block, or inside a word or sentence; a closing block, list, path or command line, a text that trails
off on purpose and a short request are whole.
Whether a closing path or command is complete is read from the closings of all values: an extension or name that is a rare
beginning of a common one is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.staging import small, staged

#: Lengths below a spike that it is compared with, and how many longer values there may be for each value of a spike.
NEAR, LONGER_SHARE = 40, 0.1
#: A spike has at least this many values, and this many times the mean count of the lengths below it.
SPIKE_COUNT, SPIKE_TIMES = 3, 4
#: A common closing has at least this share of all closings of its kind (so at most 1 / share are common) and this count.
CLOSING_SHARE, CLOSING_COUNT = 0.002, 3
#: Words and characters of a short request at most.
REQUEST_WORDS, REQUEST_CHARS = 8, 60

_MARK = r"(?i)\[[^\[\]\n]*(?:truncat|interrupt|cut|incomplete|omitted|abridged)[^\[\]\n]*\]$"
_TRAILS = r"(?i)\b(?:and so on|and so forth|etc\.?|usw\.?)\s*(?:…|\.\.\.)$"
_ELLIPSIS = r"(?:…|\.\.\.)$"
_TERMINAL = r"[.?!。？！]['\"”’»)\]）」』*_]*$"
_STEM = r"/[\w-]+\.$"
_LIST = r"^\s*(?:[-*•]|\d+[.)])\s+(\S+)$"
_COMMAND = r"^\s*[$>]\s+\S"
_PATH = r"^(?:\p{L}++:?\s++)?\S*/[^\s/]*\.\w+$"


def _last_line(text: Column) -> Column:
    return F.substring_index(text, "\n", -1)


def end_facts(values: DataFrame) -> DataFrame:
    """Keys of ``values`` with the lengths of the text and what its end shows; null and blank texts are left out.

    ``values``: source_table, record_id, turn_id, field_name, source, text.
    """
    text = F.regexp_replace("text", r"(?U)(?<!\s)\s+$", "")
    at = values.select("source_table", "record_id", "turn_id", "field_name", F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("source"), "text", text.alias("t"))
    at = at.where("record_id is not null and t is not null and t <> ''").withColumn("line", _last_line(F.col("t")))
    sound = F.regexp_replace("text", "�+$", "")
    fences = (F.length("t") - F.length(F.replace("t", F.lit("```"), F.lit("")))) / 3
    trails = F.col("t").rlike(_TRAILS)
    ellipsis = F.col("t").rlike(_ELLIPSIS)
    path, command = F.col("line").rlike(_PATH), F.col("line").rlike(_COMMAND)
    item = F.regexp_extract("line", _LIST, 1)
    closing = (
        F.when(command, F.struct(F.lit("command").alias("kind"), F.regexp_extract("line", r"([\p{L}\p{N}]+)$", 1).alias("piece")))
        .when((item != "") & ~item.contains("/"), F.struct(F.lit("item").alias("kind"), F.regexp_extract(item, r"([\p{L}\p{N}]+)$", 1).alias("piece")))
        .when(item.rlike(r"/[^\s/]*\.\w+$") | path, F.struct(F.lit("path").alias("kind"), F.regexp_extract("line", r"\.(\w+)$", 1).alias("piece")))
    )
    request = F.coalesce(F.col("field_name") == "prompt", F.lit(False)) & ~F.col("t").contains("\n") & (F.length("t") <= REQUEST_CHARS) & (F.size(F.split("t", r"\s+")) <= REQUEST_WORDS) & ~F.col("t").rlike(r"^\p{Lu}") & ~F.col("t").rlike(r"[.?!]\s")
    return at.select(
        "source_table",
        "record_id",
        F.coalesce("turn_id", F.lit("")).alias("turn_id"),
        "field_name",
        "source",
        F.length("text").alias("n_chars"),
        F.octet_length(sound).alias("n_bytes"),
        (F.col("t").rlike(_MARK) | (ellipsis & ~trails & F.col("t").rlike(r"\S(?:…|\.\.\.)$")) | F.col("t").endswith("�") | (fences % 2 == 1)).alias("marked"),
        ((F.col("line") == "```") | (F.col("t").rlike(_TERMINAL) & ~ellipsis & ~F.col("t").rlike(_STEM)) | trails).alias("terminal"),
        (ellipsis | request).alias("closed"),
        closing["kind"].alias("kind"),
        closing["piece"].alias("piece"),
    )


def length_spikes(facts: DataFrame) -> DataFrame:
    """source_table, source, field_name, unit, limit: the lengths of a source's field that are spikes at its maximum.

    Longer values may be ``LONGER_SHARE`` of those at the spike (outliers, or values from before a limit), so a field has
    few spikes. A group of the windows has one row per distinct length.
    """
    group = ["source_table", "source", "field_name", "unit"]
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("bigint").alias("length")) for u in ("n_chars", "n_bytes")])
    counts = facts.select("source_table", "source", "field_name", F.inline(units)).groupBy(*group, "length").agg(F.count("*").alias("n"))
    by_length = Window.partitionBy(*group).orderBy("length")
    below = F.coalesce(F.sum("n").over(by_length.rangeBetween(-NEAR, -1)), F.lit(0))
    longer = F.coalesce(F.sum("n").over(by_length.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    at = F.col("n")
    spike = (at >= SPIKE_COUNT) & (at >= SPIKE_TIMES * F.col("below") / NEAR) & (F.col("longer") <= LONGER_SHARE * at)
    return counts.withColumns({"below": below, "longer": longer}).where(spike).select(*group, F.col("length").alias("limit"))


def common_closings(facts: DataFrame) -> DataFrame:
    """kind, common: the common last pieces of closing paths, items and commands, at most 1 / CLOSING_SHARE of each."""
    counts = facts.where("piece is not null and piece <> ''").groupBy("kind", "piece").agg(F.count("*").alias("n"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    common = counts.join(F.broadcast(totals), "kind").where((F.col("n") >= CLOSING_COUNT) & (F.col("n") >= CLOSING_SHARE * F.col("total")))  # three kinds
    rarely = F.filter("pieces", lambda p: ~F.exists("pieces", lambda q: q["piece"].startswith(p["piece"]) & (q["n"] * 0.3 > p["n"])))
    return common.groupBy("kind").agg(F.collect_list(F.struct("piece", "n")).alias("pieces")).select("kind", F.transform(rarely, lambda p: p["piece"]).alias("common"))


def judged_values(values: DataFrame) -> DataFrame:
    """Every value that is not null or blank, once per source_table, record_id, turn_id and field_name, with ``cut``.

    Repeated rows count once; records with a null id are left out, null turn ids count as empty, null sources as the
    source ''; empty tables give an empty result; extra columns are ignored. Texts of any length are read whole.
    """
    facts = staged(end_facts(values).groupBy("source_table", "record_id", "turn_id", "field_name").agg(F.min(F.struct("source", "n_chars", "n_bytes", "marked", "terminal", "closed", "kind", "piece")).alias("f")).select("source_table", "record_id", "turn_id", "field_name", "f.*"))
    limits = length_spikes(facts).groupBy("source_table", "source", "field_name").agg(*[F.collect_set(F.when(F.col("unit") == unit, F.col("limit"))).alias(name) for unit, name in (("n_chars", "chars_limits"), ("n_bytes", "bytes_limits"))])
    known = F.broadcast(common_closings(facts))  # one row for each of three kinds
    cut_in_bytes = lambda x: F.col("n_bytes").between(x - 3, x) & ((F.col("n_bytes") == x) | (F.col("n_chars") < F.col("n_bytes")))
    at_limit = F.array_contains("chars_limits", F.col("n_chars").cast("bigint")) | F.exists("bytes_limits", cut_in_bytes)
    common = F.coalesce("common", F.array().cast("array<string>"))
    begun = ~F.array_contains(common, F.col("piece")) & F.exists(common, lambda c: c.startswith(F.col("piece")))
    usual = F.col("kind").isNotNull() & F.array_contains(common, F.col("piece"))
    complete = F.col("kind").isNotNull() & (F.col("piece") != "") & ~begun
    cut = F.col("marked") | (~F.col("terminal") & ((F.coalesce(at_limit, F.lit(False)) & ~F.coalesce(usual, F.lit(False))) | ~(F.col("closed") | F.coalesce(complete, F.lit(False)))))
    return (
        facts.join(small(staged(limits)), ["source_table", "source", "field_name"], "left")
        .join(known, "kind", "left")
        .select("source_table", "record_id", "turn_id", "field_name", "source", "n_chars", "n_bytes", F.coalesce(at_limit, F.lit(False)).alias("at_limit"), cut.alias("cut"))
    )


def truncation_rates(judged: DataFrame) -> DataFrame:
    """Per source, table and field: values, cut values, their share, and how many stand at a length limit."""
    return judged.groupBy("source_table", "field_name", "source").agg(
        F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut"), F.round(F.count_if("cut") / F.count("*"), 6).alias("share_cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("n_at_limit")
    )
