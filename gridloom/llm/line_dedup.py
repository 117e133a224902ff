"""Line dedup over hashed lines, in DataFrame functions only.

Lines travel as (hash, document, position), never as text: they are range
partitioned by hash with document and position as secondary keys, so that even
one line in a third of all documents spreads over many ranges. Each sorted
range is streamed once for the first document of each of its keys. Only a
range's first and last key can lie in other ranges too; these two keys a range
are the edges, and their first documents are put right from one another. What
returns to the documents is a sparse bitmap of 64-line words, of which words
without drops are absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.sparkkit import Table, free_name, shuffle_partitions

MIN_KEY_CHARS = 10
_UP, _DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The line without [\x20\x09-\x0D] at both ends, A-Z lower-cased; lower() is the same for pure ASCII and faster.
_STRIPPED = "btrim(_line, ' \\t\\n\\u000B\\f\\r')"
_KEY = f"if(octet_length(_s) = char_length(_s), lower(_s), translate(_s, '{_UP}', '{_DOWN}'))"


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """h1, h2 (128 bits of the key's hash), doc, th (hash of the text), pos of each line long enough to count."""
    t = docs.where(f"`{id_col}` IS NOT NULL AND `{text_col}` IS NOT NULL").selectExpr(f"`{id_col}` AS doc", f"xxhash64(`{text_col}`) AS th", f"posexplode(split(`{text_col}`, '\\n')) AS (pos, _line)")
    t = t.selectExpr("doc", "th", "pos", f"{_STRIPPED} AS _s").where(f"char_length(_s) >= {min_chars}")
    return t.selectExpr("doc", "th", "pos", f"{_KEY} AS k").selectExpr("xxhash64(k) AS h1", "xxhash64(1, k) AS h2", "doc", "th", "pos")


def later_lines(lines: DataFrame) -> tuple[DataFrame, list[Table]]:
    """doc, th, pos of the lines (h1, h2, doc, th, pos) whose key a smaller document holds, and the tables behind them."""
    spark = lines.sparkSession
    hashed = Table(spark, lines, "lines")  # else the range sample hashes every line once more
    ranged = hashed.df.repartitionByRange(shuffle_partitions(spark), "h1", "h2", "doc", "pos").sortWithinPartitions("h1", "h2", "doc", "pos")
    runs = Table(spark, ranged.withColumn("run", F.spark_partition_id()), "runs")
    hashed.drop()
    stream = Window.partitionBy("run", "h1", "h2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = runs.df.withColumn("first", F.first("doc").over(stream))
    key = F.struct("h1", "h2", F.col("doc").alias("first"))
    ends = runs.df.groupBy("run").agg(F.min(key).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi"))
    last = runs.df.join(F.broadcast(ends.select("run", "hi")), "run").where("h1 = hi.h1 AND h2 = hi.h2").groupBy("run", "h1", "h2").agg(F.min("doc").alias("first"))
    # At most two rows a range.
    edges = ends.select("lo.*").unionByName(last.select("h1", "h2", "first")).groupBy("h1", "h2").agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = streamed.join(F.broadcast(edges), ["h1", "h2"], "left").where("doc > coalesce(least, first)").select("doc", "th", "pos")
    return out, [runs]


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_KEY_CHARS) -> Table:
    """doc, th, n_dropped, words: map of 64-line word number to bits of dropped lines; only documents that lose lines."""
    later, tables = later_lines(hashed_lines(docs, id_col, text_col, min_chars))
    bits = later.groupBy("doc", "th", F.expr("pos div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    maps = bits.groupBy("doc", "th").agg(F.expr("cast(sum(bit_count(bits)) as bigint)").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    done = Table(docs.sparkSession, maps, "bitmaps")
    for t in tables:
        t.drop()
    return done


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_KEY_CHARS, out: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text")) -> DataFrame:
    """Every input row and column, plus n_lines, n_dropped and kept_text, called as ``out`` says; they replace input columns of these names.

    A line loses in all documents but the smallest id that holds its key.
    Null and empty texts are one empty line. Rows with a null id keep all
    lines and count for none. Repeated rows are one document and lose the same
    lines; rows that share an id but not the text are judged each by its text.
    """
    taken = [*docs.columns, *out]
    d, h, n, w, dense = (free_name(x, taken) for x in ("_doc", "_th", "_n", "_w", "_dense"))
    maps = drop_bitmaps(docs, id_col, text_col, min_chars).df.selectExpr(f"doc AS {d}", f"th AS {h}", f"n_dropped AS {n}", f"words AS {w}")
    j = docs.join(maps, F.expr(f"`{id_col}` = {d} AND xxhash64(`{text_col}`) = {h}"), "left")
    j = j.withColumn(dense, F.expr(f"if({n} IS NULL, NULL, transform(sequence(0L, array_max(map_keys({w}))), x -> coalesce(try_element_at({w}, x), 0L)))"))
    text = f"coalesce(`{text_col}`, '')"
    kept = f"if({n} IS NULL, {text}, array_join(filter(split({text}, '\n'), (x, i) -> (shiftright(coalesce(get({dense}, i div 64), 0L), i % 64) & 1L) = 0L), '\n'))"
    made = (f"cast(length({text}) - length(replace({text}, '\n', '')) + 1 as bigint)", f"coalesce({n}, 0L)", kept)
    return j.select(*(docs[c] for c in docs.columns if c not in out), *(F.expr(e).alias(name) for e, name in zip(made, out)))
