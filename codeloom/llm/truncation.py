"""Text cut off by field limits.

A field limit shows in the histogram of lengths: at the greatest length of a source many values end all alike without a
proper end. Per source (model configuration, origin) and column, histograms of the lengths in characters and in bytes
are tested for such spikes at the maximum. Every value that lacks an end has a *kind* of end (running text, a short
line of its own, a list item, ...). A kind that piles up at the spikes, against the lengths beside them, is what a cut
leaves behind: values of such kinds are lost, at a spike by the field limit and elsewhere, where the same kind of end
shows, mid-transfer. Kinds that are no more frequent at a limit than beside it (signatures, headings) are how their
writers end, and their values are whole at every length. Cut marks, broken characters and open code need no histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import materialize, spread

#: What programs put after a cut, and phrases that mean their dots.
CUT_WORDS = "truncated|cut|cut off|more|continued|snip|snipped|clipped|shortened|tronqué|suite|gekürzt|abgeschnitten|mehr|truncado|cortado|más"
SO_ON = "and so on|and so forth|and more|etc|et cetera|ainsi de suite|und so weiter|usw|así sucesivamente|etcétera"

SPIKE_LEAST = 3  # values without an end at one length
SPIKE_RATIO = 4.0  # against the mean of the lengths beside it
SPIKE_WINDOW = 10
MOST_ABOVE = 0.02  # share of the source's values that are longer than a limit
LINE_WORDS = 6  # a last line of fewer words is a short one

BLANKS = " \t\r\n\f\v"
MARK = rf"(?i)[ \t.…]*(?:[\[(<{{]\s*(?:\.\.\.|…|{CUT_WORDS})\s*(?:\.\.\.|…)?[\])>}}]|[\[(<{{]\s*…\s*[\])>}}])$"
CLOSERS = "[”“\"»«’')\\]}*_]*"
DOTS = r"(?:\.{3,}|…)$"
TERMINAL = rf"[.!?。！？]{CLOSERS}$"
ITEM = r"^\s*(?:[-*+•]|\d+[.)])\s+\S"
CODE_LINE = r"^\s*```$|^\s*`[^`]+`$|^\s*(?:[-*+•]|\d+[.)])\s+\S.*`$|[)\]};]$"
SO_ON_LINE = rf"(?i)^\W*(?:\w+ )?(?:{SO_ON})\W*$"


def ends(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``end``: how ``text`` ends.

    ``mark`` (a cut mark or a broken character), ``code`` (an open code block or span), ``proper`` (terminal
    punctuation, a closed block, item or bracket in a last line of its own, a phrase that means its dots), or the kind
    of an end that lacks all of these: ``run`` or ``line`` (the last line is the whole text, or one of its own), with
    ``-item`` for a list item and ``-short`` for a line of few words. Only the last line is matched against patterns.
    """
    df = df.withColumn("_t", F.rtrim(F.col(text), F.lit(BLANKS)))
    df = df.withColumn("_last", F.substring_index("_t", "\n", -1)).withColumn("_mark", F.regexp_extract("_last", MARK, 0))
    core = F.rtrim(F.expr("substr(_t, 1, length(_t) - length(_mark))"), F.lit(BLANKS))
    df = df.withColumn("_core", F.when(F.col("_mark") == "", F.col("_t")).otherwise(core)).withColumn("_last", F.substring_index("_core", "\n", -1))
    fences = (F.length("_core") - F.length(F.replace("_core", F.lit("```"), F.lit("")))) / 3
    ticks = F.length("_core") - F.length(F.replace("_core", F.lit("`"), F.lit("")))
    own, last = F.length("_last") < F.length("_core"), F.col("_last")
    proper = (last.rlike(TERMINAL) & ~last.rlike(DOTS)) | (own & (last.rlike(CODE_LINE) | last.rlike(SO_ON_LINE)))
    kind = F.concat(F.when(own, "line").otherwise("run"), F.when(last.rlike(ITEM), "-item").otherwise(""), F.when(own & (F.size(F.split(last, r"\s+")) < LINE_WORDS), "-short").otherwise(""))
    end = F.when((F.col("_mark") != "") | F.col("_t").endswith("�"), "mark").when((fences % 2 != 0) | (ticks % 2 != 0), "code").when(proper, "proper").otherwise(kind)
    return df.withColumn("end", end).drop("_t", "_last", "_mark", "_core")


def sized_ends(table: DataFrame, key: str, fields: list[str], sources: list[str]) -> DataFrame:
    """``_key, <sources>, field, n_chars, n_bytes, end`` of every value that is neither null nor blank; texts stay out."""
    texts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))
    v = spread(table.select(key, *sources, *fields)).select(F.col(key).alias("_key"), *sources, F.explode(texts).alias("v")).select("_key", *sources, "v.field", "v.text").where(F.col("text").rlike(r"\S"))
    return ends(v.withColumn("n_chars", F.length("text")).withColumn("n_bytes", F.octet_length("text"))).drop("text")


def _unended(end: Column) -> Column:
    return ~end.isin("proper", "mark")


def histogram(values: DataFrame, sources: list[str]) -> DataFrame:
    """``source_kind, source, field, measure, length, end, n`` over all values, aggregated before the shuffle."""
    kinds = F.array(*(F.struct(F.lit(s).alias("source_kind"), F.col(s).cast("string").alias("source")) for s in sources))
    measures = F.array(F.struct(F.lit("chars").alias("measure"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.col("n_bytes").alias("length")))
    one = values.groupBy(*sources, "field", "n_chars", "n_bytes", "end").agg(F.count(F.lit(1)).alias("k"))
    flat = one.withColumn("s", F.explode(kinds)).withColumn("m", F.explode(measures))
    return flat.groupBy("s.source_kind", "s.source", "field", "m.measure", "m.length", "end").agg(F.sum("k").alias("n"))


def length_spikes(hist: DataFrame) -> DataFrame:
    """``source_kind, source, field, measure, length, n, n_open``: spikes at the maximum of a source.

    At least SPIKE_LEAST values of this length lack a proper end, more than SPIKE_RATIO times what the SPIKE_WINDOW
    lengths on either side hold on average, and at most MOST_ABOVE of the source's values are longer.
    """
    keys = ["source_kind", "source", "field", "measure"]
    h = hist.groupBy(*keys, "length").agg(F.sum("n").alias("n"), F.sum(F.when(_unended(F.col("end")), F.col("n")).otherwise(0)).alias("n_open"))
    # all lengths of a source in one ordered window: a histogram has as many rows as there are lengths, however many values
    w = Window.partitionBy(*keys).orderBy("length")
    near, above, all_ = w.rangeBetween(-SPIKE_WINDOW, SPIKE_WINDOW), w.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy(*keys)
    h = h.withColumn("near", F.sum("n_open").over(near) - F.col("n_open")).withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).withColumn("total", F.sum("n").over(all_))
    spike = (F.col("n_open") >= SPIKE_LEAST) & (F.col("n_open") > SPIKE_RATIO * F.col("near") / (2 * SPIKE_WINDOW)) & (F.col("above") <= MOST_ABOVE * F.col("total"))
    return h.where(spike).select(*keys, "length", "n", "n_open")


def cut_kinds(hist: DataFrame, spikes: DataFrame) -> DataFrame:
    """``kind, n_at, n_beside``: the kinds of end that cuts leave, by their excess at the spikes over the lengths beside.

    There are at most six kinds, so this is a small table whatever the data.
    """
    keys = ["source_kind", "source", "field", "measure"]
    s = spikes.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.col("length").alias("s_length"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"s_{k}"))
    j = hist.where(~F.col("end").isin("proper", "mark", "code")).join(s, on).where(F.abs(F.col("length") - F.col("s_length")) <= SPIKE_WINDOW)
    at = F.sum(F.when(F.col("length") == F.col("s_length"), F.col("n")).otherwise(0))
    k = j.groupBy(F.col("end").alias("kind")).agg(at.alias("n_at"), (F.sum("n") - at).alias("n_beside"))
    return k.where((F.col("n_at") >= SPIKE_LEAST) & (F.col("n_at") > SPIKE_RATIO * F.col("n_beside") / (2 * SPIKE_WINDOW)))


def find_truncated(table: DataFrame, key: str, fields: list[str], sources: list[str]) -> DataFrame:
    """``key, field_name, <sources>, n_chars, evidence`` of every value whose end was lost.

    evidence: ``mark`` (a cut mark or a broken character), ``open`` (an open code block), ``spike`` (a kind of end that
    cuts leave, at a spike of its source), ``end`` (such a kind at another length). Null and empty values, also such of
    white space only, are no cases; a null source is a source of its own; repeated rows come out once each. Without any
    spike no kind is known to come from cuts, so only marks and open code are found.
    """
    v = materialize(sized_ends(table, key, fields, sources))
    hist = materialize(histogram(v, sources))
    spikes = materialize(length_spikes(hist))
    kinds = cut_kinds(hist, spikes).select("kind")
    sure = F.col("end").isin("mark", "code")
    lost = v.where("end <> 'proper'").join(F.broadcast(kinds), F.col("end") == F.col("kind"), "left").where(sure | F.col("kind").isNotNull())
    at = []
    for i, s in enumerate(sources):
        for m in ("chars", "bytes"):
            mine = spikes.where((F.col("source_kind") == s) & (F.col("measure") == m)).select(F.col("source").alias(f"s{i}{m}"), F.col("field").alias(f"f{i}{m}"), F.col("length").alias(f"l{i}{m}"))
            lost = lost.join(mine, F.col(s).cast("string").eqNullSafe(F.col(f"s{i}{m}")) & (F.col("field") == F.col(f"f{i}{m}")) & (F.col(f"n_{m}") == F.col(f"l{i}{m}")), "left")
            at.append(F.col(f"l{i}{m}").isNotNull())
    spike = at[0]
    for a in at[1:]:
        spike = spike | a
    evidence = F.when(F.col("end") == "mark", "mark").when(F.col("end") == "code", "open").when(spike, "spike").otherwise("end")
    return lost.select(F.col("_key").alias(key), F.col("field").alias("field_name"), *sources, "n_chars", evidence.alias("evidence"))


def field_limits(table: DataFrame, key: str, fields: list[str], sources: list[str], limits: DataFrame) -> DataFrame:
    """``source_kind, source, field_name, measure, length, n, n_open, max_tokens``: the limits that the histograms show.

    ``limits`` has ``source`` (text of the first of ``sources``) and ``max_tokens``, which stands beside the spikes of
    that source; other kinds of source have none.
    """
    spikes = length_spikes(materialize(histogram(sized_ends(table, key, fields, sources), sources)))
    c = limits.select(F.lit(sources[0]).alias("source_kind"), F.col("source").cast("string").alias("source"), "max_tokens").distinct()
    return spikes.join(c, ["source_kind", "source"], "left").select("source_kind", "source", F.col("field").alias("field_name"), "measure", "length", "n", "n_open", "max_tokens")


def truncation_rates(table: DataFrame, lost: DataFrame, fields: list[str], source: str) -> DataFrame:
    """``source, field_name, n_values, n_lost, rate`` per value of one source column."""
    texts = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields))
    n = table.select(source, F.explode(texts).alias("v")).where(F.col("v.text").rlike(r"\S")).groupBy(F.col(source).cast("string").alias("source"), "v.field_name").agg(F.count(F.lit(1)).alias("n_values"))
    k = lost.groupBy(F.col(source).cast("string").alias("l_source"), F.col("field_name").alias("l_field")).agg(F.count(F.lit(1)).alias("n_lost"))
    j = n.join(k, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("field_name") == F.col("l_field")), "left")
    return j.select(F.lit(source).alias("source_kind"), "source", "field_name", "n_values", F.coalesce("n_lost", F.lit(0)).alias("n_lost"), F.round(F.coalesce("n_lost", F.lit(0)) / F.col("n_values"), 6).alias("rate"))
