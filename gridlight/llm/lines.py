"""Removal of repeated runs of lines by winnowing over line hashes, with DataFrame and SQL functions only.

A line is a physical line; longer prose is also cut after sentence ends, so a passage inside a paragraph is found too.
Of every three consecutive lines the longest (by words, then by hash) is a fingerprint, and so is every line of at least
``always`` words.  Every run of three lines therefore has a fingerprint, the same one wherever the run stands.  A fingerprint
carries the hashes of two lines on either side; it is matched with the first place where it stands in the same run of three
(or, if it is long, with the first place of its hash) and extended both ways while the neighbours agree.  So a line is
repeated exactly if a run of three lines around it, or the line itself if it is long, stands at an earlier place, and
stretches of repeated lines of at least ``min_words`` words go.  The first place of every line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlight.llm.tables import maybe_in, written

MARK = "\x01"


def pieces(text: str) -> str:
    """SQL: the lines of a text with their separators; put together they are the text."""
    fast = f"split(replace(replace(replace(replace({text}, '\\n', '\\n\\u0001'), '. ', '. \\u0001'), '! ', '! \\u0001'), '? ', '? \\u0001'), '\\u0001')"
    return rf"CASE WHEN contains({text}, '\u0001') THEN split({text}, '(?<=\\n)|(?<=[.!?] )') ELSE {fast} END"


def lines_of(units: str) -> str:
    """SQL: (pos, h, w, o) of the lines that are not blank: place among all, hash, words and rank (long ones first)."""
    cut = f"transform({units}, (u, i) -> struct(i AS pos, btrim(u, ' \\t\\r\\n') AS t))"
    sized = f"transform(filter({cut}, x -> x.t <> ''), x -> struct(x.pos AS pos, xxhash64(x.t) AS h, length(x.t) - length(replace(x.t, ' ', '')) + 1 AS w))"
    return f"transform({sized}, x -> struct(x.pos AS pos, x.h AS h, x.w AS w, shiftleft(CAST(63 - least(x.w, 63) AS BIGINT), 57) | shiftrightunsigned(x.h, 7) AS o))"


def near(*steps: int) -> str:
    """SQL: the low halves of the hashes of two lines near ``x`` at ``j``; 0 where there is none."""
    low = [f"coalesce(get(lines, j + {s}).h & 4294967295, 0)" for s in steps]
    return f"(shiftleft({low[0]}, 32) | {low[1]})"


def fingerprints(rows: DataFrame, always: int) -> DataFrame:
    """(doc, th, h, j, of, left, right, words): the chosen lines of every text with what stands around them."""
    o = lambda s: f"coalesce(get(lines, j + {s}).o, 9223372036854775807)"
    least = f"((CASE WHEN x.o <= {o(-1)} AND x.o <= {o(-2)} THEN 1 ELSE 0 END) | (CASE WHEN x.o <= {o(-1)} AND x.o <= {o(1)} THEN 2 ELSE 0 END) | (CASE WHEN x.o <= {o(1)} AND x.o <= {o(2)} THEN 4 ELSE 0 END))"
    size = lambda s: f"least(coalesce(get(lines, j + {s}).w, 0), 4095)"
    words = " | ".join(f"shiftleft(CAST({size(s)} AS BIGINT), {12 * k})" for k, s in enumerate((-2, -1, 0, 1, 2)))
    # the windows of three it is the least of; bit 8 if it is long enough alone
    made = f"""filter(transform(transform(lines, (x, j) -> struct(x.h AS h, {least} | CASE WHEN x.w >= {always} THEN 8 ELSE 0 END AS of)), (x, j) -> CASE WHEN x.of <> 0
        THEN struct(x.h AS h, j AS j, x.of AS of, {near(-1, -2)} AS left, {near(1, 2)} AS right, {words} AS words) END), x -> x IS NOT NULL)"""
    found = rows.withColumn("lines", F.expr(lines_of("units"))).select("doc", "th", F.explode(F.expr(made)).alias("f"))
    return found.select("doc", "th", "f.*")


def repeated_runs(docs: DataFrame, min_words: int = 25, always: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, runs array of start and stop): which lines of each text (numbers among those that are not blank) are repeated, as
    stretches of at least ``min_words`` words.  th is the text's hash; earlier means a smaller id (null last), then th, then
    an earlier place in the text."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.expr(pieces(f"`{text_col}`")).alias("units"))
    prints = written(fingerprints(rows, always), "prints")
    often = written(prints.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "often")
    seen = written(maybe_in(prints, F.col("h"), often, F.col("h")).join(often, "h"), "seen")
    # the runs of three lines a fingerprint stands in: last, in the middle, first.  Equal keys are equal runs, so nothing more
    # is carried along; a long fingerprint also stands alone and takes its neighbours with it
    threes = F.expr("""filter(array(
        CASE WHEN (of & 1) <> 0 AND (left & 4294967295) <> 0 THEN struct(xxhash64(1, h, left) AS key, 2 AS back, 0 AS on) END,
        CASE WHEN (of & 2) <> 0 AND shiftrightunsigned(left, 32) <> 0 AND shiftrightunsigned(right, 32) <> 0
             THEN struct(xxhash64(2, h, shiftrightunsigned(left, 32), shiftrightunsigned(right, 32)) AS key, 1 AS back, 1 AS on) END,
        CASE WHEN (of & 4) <> 0 AND (right & 4294967295) <> 0 THEN struct(xxhash64(3, h, right) AS key, 0 AS back, 2 AS on) END), x -> x IS NOT NULL)""")

    def met_again(keyed: DataFrame, more: list[str]) -> DataFrame:
        """Rows of ``keyed`` whose key stands at an earlier place, with the columns ``more`` of the first place as *0."""
        first = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc0")).where("n > 1").drop("n"), "first")
        matched = written(keyed.join(first, "key"), "matched")
        source = matched.where(F.col("doc").eqNullSafe(F.col("doc0"))).groupBy("key").agg(F.min(F.struct("th", "j", *more)).alias("s"))
        source = written(source.select("key", *[F.col(f"s.{c}").alias(f"{c}0") for c in ("th", "j", *more)]), "sources")
        later = ~(F.col("doc").eqNullSafe(F.col("doc0")) & (F.col("th") == F.col("th0")) & (F.col("j") == F.col("j0")))
        return matched.join(source, "key").where(later)

    def reach(a: str, b: str) -> Column:
        one = F.expr(f"shiftrightunsigned({a}, 32) <> 0 AND shiftrightunsigned({a}, 32) = shiftrightunsigned({b}, 32)")
        return F.when(one & F.expr(f"{a} = {b} AND ({a} & 4294967295) <> 0"), 2).when(one, 1).otherwise(0)

    place = ["doc", "th", "j", "words"]
    alike = met_again(seen.select(*place, F.explode(threes).alias("k")).select(*place, "k.*"), [])
    alone = met_again(seen.where("(of & 8) <> 0").select(*place, "left", "right", F.col("h").alias("key")), ["left", "right"])
    alone = alone.select(*place, reach("left", "left0").alias("back"), reach("right", "right0").alias("on"))
    met = alike.select(*place, "back", "on").unionByName(alone).groupBy(*place).agg(F.max("back").alias("back"), F.max("on").alias("on"))
    covered = met.select(*place, F.explode(F.expr("sequence(-back, on)")).alias("step"))
    covered = covered.groupBy("doc", "th", (F.col("j") + F.col("step")).alias("j")).agg(F.max(F.expr("shiftrightunsigned(words, 12 * (step + 2)) & 4095")).alias("w"))
    island = covered.withColumn("island", F.col("j") - F.row_number().over(W.partitionBy("doc", "th").orderBy("j")))
    stretches = island.groupBy("doc", "th", "island").agg(F.min("j").alias("start"), F.max("j").alias("stop"), F.sum("w").alias("w")).where(F.col("w") >= min_words)
    return stretches.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once: a generator of one row keeps the optimizer from writing its expression
    into later ones, where it would be repeated for every element of an array."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def without_repeats(docs: DataFrame, min_words: int = 25, always: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with later repeated runs of lines taken out of the text, and ``_words_removed``.

    A null or empty text stays as it is.  Rows repeated in id and text are one document and are treated alike; texts with
    equal ids are told apart by their hash.  Other columns stay and may have any name but those beginning with ``_gl_``."""
    runs = repeated_runs(docs, min_words, always, id_col, text_col).select(F.col("doc").alias("_gl_doc"), F.col("th").alias("_gl_th"), F.col("runs").alias("_gl_runs"))
    runs = written(runs, "runs").hint("merge")    # one plan at every size: both sides grow with the input
    keyed = maybe_in(docs.withColumn("_gl_hash", F.xxhash64(text_col)), F.coalesce("_gl_hash", F.lit(0)), runs, F.col("_gl_th"), flag="_gl_maybe")
    same = keyed.where(~F.col("_gl_maybe")).select(*docs.columns, F.lit(0).alias("_words_removed"))    # most texts stay where they are
    keyed = keyed.where("_gl_maybe")
    joined = keyed.join(runs, keyed[id_col].eqNullSafe(runs["_gl_doc"]) & (F.col("_gl_hash") == F.col("_gl_th")), "left")
    units = F.expr(pieces(f"`{text_col}`"))
    cut = held(joined, "_gl_units", F.when(F.col("_gl_runs").isNotNull(), units))
    cut = held(cut, "_gl_places", F.expr("transform(filter(transform(_gl_units, (u, i) -> struct(i AS i, btrim(u, ' \\t\\r\\n') AS t)), x -> x.t <> ''), x -> x.i)"))
    cut = held(cut, "_gl_gone", F.expr("transform(_gl_runs, r -> struct(_gl_places[r.start] AS a, _gl_places[r.stop] AS b))"))
    kept = "array_join(filter(_gl_units, (u, i) -> NOT exists(_gl_gone, g -> i BETWEEN g.a AND g.b)), '')"
    gone = "aggregate(filter(_gl_units, (u, i) -> exists(_gl_gone, g -> i BETWEEN g.a AND g.b)), 0L, (n, u) -> n + CASE WHEN btrim(u, ' \\t\\r\\n') = '' THEN 0 ELSE length(btrim(u, ' \\t\\r\\n')) - length(replace(btrim(u, ' \\t\\r\\n'), ' ', '')) + 1 END)"
    none = F.col("_gl_runs").isNull()
    done = held(cut, "_gl_new", F.struct(F.when(none, F.col(text_col)).otherwise(F.expr(kept)).alias("text"), F.when(none, F.lit(0)).otherwise(F.expr(gone)).cast("int").alias("removed")))
    done = done.withColumn("_words_removed", F.col("_gl_new.removed")).withColumn(text_col, F.col("_gl_new.text"))
    return done.select(*docs.columns, "_words_removed").unionByName(same)
