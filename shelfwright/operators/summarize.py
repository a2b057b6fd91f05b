"""One line of text for each cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.functions import text as tx
from shelfwright.operators.clusters import first_rows
from shelfwright.tables import shuffled


def summaries(membership: DataFrame, files: DataFrame, snippets: DataFrame) -> DataFrame:
    """(node_id, summary) for membership (node_id, seq, id): count and bytes, then up to two texts that aren't blank.

    Ids that files don't have count as members of no size. A text shows its first 160 characters after stripping, line feeds as
    blanks, under the first six characters of its id; the whole is cut to 800 characters.
    """
    sized = membership.join(shuffled(files.select("id", "size")), "id", "left")
    total = sized.groupBy("node_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    line = F.regexp_replace(tx.strip("text"), "\n", " ")
    texts = snippets.groupBy("id").agg(F.min("text").alias("text")).select("id", line.alias("line")).where("line <> ''")
    top = first_rows(membership.select("node_id", "seq", "id").join(shuffled(texts), "id"), "node_id", "seq", 2)
    shown = F.concat(F.lit("Snippet["), F.substring("id", 1, 6), F.lit("]: "), F.substring("line", 1, 160))
    joined = top.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("s")))).alias("a"))  # two at most
    head = F.concat(F.lit("Files: "), F.col("n").cast("string"), F.lit(", Total bytes: "), F.col("bytes").cast("string"))
    whole = F.array_join(F.concat(F.array(head), F.coalesce(F.transform("a", lambda x: x["s"]), F.array().cast("array<string>"))), " | ")
    return total.join(shuffled(joined), "node_id", "left").select("node_id", F.substring(whole, 1, 800).alias("summary"))
