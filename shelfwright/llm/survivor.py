"""Problem 2: the best representative of each duplicate group, field by field.

Method: iterative truth discovery. A claim says that a source gives a field of a record a value. In turn, (1) every value gets the
sum of its claims' weights as support, a source counting once however often it repeats itself, and the value of the highest support
wins; (2) every voter's reliability is its share of the disputed claims that won, its weight the log odds of that. It ends when no
reliability moves by more than tol. Cells with one value tell nothing about whom to believe and don't take part.

A voter is a source in one of two standings: its claim is the one most preferred of its cell (highest trust, latest time, latest
sighting, highest confidence), or it is another. How far preference can be believed is thus estimated like everything else, source by
source, from a prior: PRIORS are the claims, won and lost, that each standing starts with. Preference wins a cell as long as it keeps
winning elsewhere; a source whose preferred claims stand against many others, again and again, loses its weight, and the votes of the
others decide. Claims that can't be right (an impossible time, a hash that is none) are not eligible: they win nothing.

Everything is an aggregation with map-side combine over (record, field, value, source): a record that holds a third of all rows
is combined before the shuffle, and no group is collected. Source weights are a table of (sources x fields) rows; Spark joins it
by broadcast only where it knows it to be small.

Defined results: records without an eligible claim of a field have no row for that field (seq 0 in p2_found); null ids are
dropped; ties go to the highest preference, then to the smallest seq; repeated rows change nothing; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.common import cut, forget, pick

#: (won, lost) of other claims and of preferred ones before anything is counted.
PRIORS = ((3.0, 2.0), (19.0, 1.0))
LEAST = 0.05  # weight of a voter that is wrong more often than right
#: Reasons that say nothing, in lower case; so do those without a letter or digit. Fixed values.
FILLERS = ["unknown", "n/a", "na", "none", "null", "nil", "tbd", "tba", "todo", "unspecified", "undefined", "no reason", "not available", "not known", "not set"]


def claims(df: DataFrame, record: str, source: Column, seq: str, fields: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """(record, field, value, source, seq, pref) of the eligible claims; fields: name -> (value, eligible, preference)."""
    each = [F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(pref.cast("double"), F.lit(float("-inf"))).alias("pref")) for name, (value, ok, pref) in fields.items()]
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.coalesce(source.cast("string"), F.lit("")).alias("source"), F.col(seq).alias("seq"), F.explode(F.array(*each)).alias("c"))
    return rows.where("c.ok and c.value is not null").select("record", "c.field", "c.value", "source", "seq", "c.pref")


def resolve(claimed: DataFrame, standings: bool = True, max_rounds: int = 20, tol: float = 1e-3) -> DataFrame:
    """(record, field, value, support, seq): the surviving value of each field, and the row it comes from. Without standings, preference breaks ties only."""
    facts = cut(claimed.groupBy("record", "field", "value", "source").agg(F.max(F.struct("pref", (-F.col("seq")).alias("low"))).alias("best")), "facts")
    cells = facts.groupBy("record", "field").agg((F.min("value") != F.max("value")).alias("disputed"), F.max("best").alias("top"))
    preferred = (F.col("best") == F.col("top")) if standings else F.lit(False)
    facts = cut(facts.join(cells, ["record", "field"]).select("record", "field", "value", "source", "best", "disputed", preferred.cast("int").alias("standing")), "cells")
    open_ = facts.where("disputed")
    own = lambda k: F.when(F.col("standing") == 1, PRIORS[1][k]).otherwise(PRIORS[0][k])
    start = facts.select("source", "field", "standing").distinct()
    rel = cut(start.withColumn("rel", own(0) / (own(0) + own(1))), "reliability")
    for _ in range(max_rounds):
        won = _winners(open_, rel)
        seen = open_.join(won.select("record", "field", F.col("value").alias("winner")), ["record", "field"]).groupBy("source", "field", "standing").agg(F.sum((F.col("value") == F.col("winner")).cast("long")).alias("won"), F.count("*").alias("n"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        new = rel.withColumnRenamed("rel", "was").join(seen, ["source", "field", "standing"], "left")
        new = cut(new.select("source", "field", "standing", ((zero("won") + own(0)) / (zero("n") + own(0) + own(1))).alias("rel"), "was"), "reliability")
        moved = new.agg(F.max(F.abs(F.col("rel") - F.col("was")))).first()[0]
        forget(rel)
        rel, path = new.drop("was"), new._shelfwright_path
        rel._shelfwright_path = path
        if moved is None or moved <= tol:
            break
    won = _winners(facts, rel)
    rows = facts.join(won, ["record", "field", "value"]).groupBy("record", "field", "value", "support").agg(F.max("best").alias("b"))
    return rows.select("record", "field", "value", "support", (-F.col("b.low")).alias("seq"))


def _winners(facts: DataFrame, rel: DataFrame) -> DataFrame:
    odds = F.greatest(F.log(F.col("rel") / (1 - F.col("rel"))), F.lit(LEAST))
    votes = facts.join(rel.select("source", "field", "standing", odds.alias("w")), ["source", "field", "standing"]).groupBy("record", "field", "value").agg(F.sum("w").alias("support"), F.max("best").alias("best"))
    top = votes.groupBy("record", "field").agg(F.max(F.struct(F.round("support", 9).alias("support"), "best", "value")).alias("t"))
    return top.select("record", "field", "t.value", "t.support")


def file_claims(files: DataFrame, scans: DataFrame, plan_deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims of path, mtime, hash by scans and of reason by plans, ids): for every id with at least two rows in files."""
    files = pick(files, "seq", "id", "path", "mtime", "hash", "scan_id", "seen_at")
    scans, plan_deletes = pick(scans, "scan_id", "trust"), pick(plan_deletes, "plan_seq", "id", "reason", "confidence")
    several = files.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    trust = scans.groupBy("scan_id").agg(F.max("trust").alias("trust"))
    rows = files.join(several, "id", "left_semi").join(trust, "scan_id", "left")
    seen = F.unix_micros("seen_at")
    fields = {
        "path": (F.col("path"), F.md5(F.encode("path", "UTF-8")) == F.col("id"), F.col("trust")),
        "mtime": (F.col("mtime"), (F.col("mtime") > 0) & ~F.isnan("mtime") & (F.col("mtime") <= seen / 1e6), F.col("mtime")),
        "hash": (F.lower("hash"), F.col("hash").rlike(r"\A[0-9A-Fa-f]{64}\z"), seen),
    }
    text = F.lower(F.regexp_replace("reason", r"(?U)^\s+|\s+$", ""))
    says = text.rlike(r"[\p{L}\p{N}]") & ~text.isin(FILLERS)
    conf = F.when(F.isnan("confidence"), None).otherwise(F.col("confidence"))
    why = claims(plan_deletes.join(several, "id", "left_semi"), "id", F.lit("plan"), "plan_seq", {"reason": (text, says, conf)})
    return claims(rows, "id", F.col("scan_id"), "seq", fields).union(why), several


def surviving_rows(files: DataFrame, scans: DataFrame, plan_deletes: DataFrame) -> DataFrame:
    """(id, path_seq, mtime_seq, hash_seq, reason_seq): the rows that the surviving values come from, 0 where there is none."""
    claimed, several = file_claims(files, scans, plan_deletes)
    won = resolve(claimed)
    wide = won.groupBy(F.col("record").alias("id")).agg(*[F.max(F.when(F.col("field") == f, F.col("seq"))).alias(f"{f}_seq") for f in ("path", "mtime", "hash", "reason")])
    return several.join(wide, "id", "left").select("id", *[F.coalesce(f"{f}_seq", F.lit(0)).cast("long").alias(f"{f}_seq") for f in ("path", "mtime", "hash", "reason")])


def surviving_values(files: DataFrame, scans: DataFrame, plan_deletes: DataFrame, standings: bool = True) -> DataFrame:
    """(id, path, mtime, hash, reason, support): one record for each id; support is the least of its fields. Without standings, by votes of sources alone."""
    claimed, several = file_claims(files, scans, plan_deletes)
    won = resolve(claimed, standings)
    value = {f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("path", "mtime", "hash", "reason")}
    wide = won.groupBy(F.col("record").alias("id")).agg(value["path"], value["mtime"].cast("double").alias("mtime"), value["hash"], value["reason"], F.min("support").alias("support"))
    return several.join(wide, "id", "left")


