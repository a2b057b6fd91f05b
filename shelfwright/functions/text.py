"""Scalar derivations on names, paths and texts, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name endings of scratch files. Fixed values.
TEMP_SUFFIXES = (".tmp", ".log", ".bak", ".old", "~")
#: Extensions read as images, and as plain text. Fixed values.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff", "heic", "heif")
TEXT_EXTENSIONS = ("txt", "md", "csv", "log", "json", "yaml", "yml", "xml", "html", "htm")
#: Age bands, youngest first. Fixed values.
AGES = ("new(<30d)", "stale(30-180d)", "old(>180d)")
#: Top-level MIME types and their buckets. Fixed values.
BUCKETS = {"image": "Images", "audio": "Audio", "video": "Video", "text": "Documents", "application": "Documents"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def bucket(mime: Column | str) -> Column:
    """Images, Audio, Video, Documents or Other; Other for null."""
    top, out = F.lower(F.substring_index(col(mime), "/", 1)), F.when(F.lit(False), F.lit(""))
    for kind, name in BUCKETS.items():
        out = out.when(top == kind, name)
    return out.otherwise("Other")


def basename(path: Column | str) -> Column:
    """The last part of a path; both kinds of slash separate."""
    return F.regexp_extract(col(path), r"([^/\\]*)[/\\]*$", 1)


def parent(path: Column | str) -> Column:
    """The last part but one, empty where there is none."""
    return F.regexp_extract(col(path), r"([^/\\]+)[/\\]+[^/\\]*[/\\]*$", 1)


def suffix(name: Column | str) -> Column:
    """The last extension in lower case without its dot; none for names that only begin with dots."""
    return F.lower(F.regexp_extract(col(name), r"^\.*[^.].*\.([^.]+)$", 1))


def slug(label: Column | str) -> Column:
    """Lower case, runs of anything but ASCII letters and digits as one hyphen, 'cluster' where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(label)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "cluster").otherwise(s)


def is_temp(name: Column | str) -> Column:
    low, out = F.lower(col(name)), F.lit(False)
    for s in TEMP_SUFFIXES:
        out = out | low.endswith(s)
    return out


def age_days(mtime: Column | str, now: float) -> Column:
    return (F.lit(float(now)) - col(mtime)) / 86400.0


def age_band(mtime: Column | str, now: float) -> Column:
    """The first band under 30 days (future times too), the second under 180, else the third; null for null."""
    d = age_days(mtime, now)
    return F.when(d < 30, AGES[0]).when(d < 180, AGES[1]).when(d.isNotNull(), AGES[2])


def gigabytes(size: Column | str) -> Column:
    return F.bround(col(size) / F.lit(1024.0**3), 4)


def monthly_cost(size: Column | str, rate: float) -> Column:
    """From the gigabytes before rounding."""
    return F.bround(col(size) / F.lit(1024.0**3) * F.lit(float(rate)), 4)


def human_bytes(n: Column | str) -> Column:
    """B as a whole number, larger units with one decimal."""
    x, out = col(n), F.when(col(n) < 1024, F.format_string("%d B", col(n).cast("long")))
    for i, unit in enumerate(["KB", "MB", "GB", "TB", "PB"], 1):
        v = x / F.lit(1024.0**i)
        shown = F.format_string(f"%.1f {unit}", F.bround(v, 1))
        out = out.when((v < 1024) | F.lit(unit == "PB"), shown)
    return out


def words(text: Column | str) -> Column:
    """Runs of ASCII letters, digits and underscores, in lower case; letters that only become ASCII in lower case are none."""
    return F.transform(F.regexp_extract_all(col(text), F.lit("([A-Za-z0-9_]+)"), F.lit(1)), F.lower)


def shingles(tokens: Column, k: int = 3) -> Column:
    """Each k consecutive words joined by blanks; fewer words make one shingle, no word an empty one."""
    n = F.size(tokens)
    run = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.when(n >= k, run).otherwise(F.array(F.array_join(tokens, " ")))


def descriptor(name: Column | str, parent_: Column | str, mime: Column | str, ext: Column | str, snippet: Column | str) -> Column:
    """Words of name, folder, MIME top, extension and up to 2000 characters of text, joined by blanks."""
    parts = [F.nullif(col(c), F.lit("")) for c in (name, parent_)] + [F.nullif(F.substring_index(col(mime), "/", 1), F.lit("")), F.nullif(col(ext), F.lit("")), F.nullif(F.substring(col(snippet), 1, 2000), F.lit(""))]
    return F.array_join(F.regexp_extract_all(F.lower(F.concat_ws(" ", *parts)), F.lit("([a-z0-9_]+)"), F.lit(1)), " ")  # here lower case comes first


def rationale(kind: Column | str, n: Column | str) -> Column:
    """struct(rationale, confidence) of a node kind over n members."""
    k, count = col(kind), col(n).cast("string")
    text = (
        F.when(k == "duplicate_cluster", F.concat(count, F.lit(" files with the same sha256 digest.")))
        .when(k == "type_cluster", F.concat(count, F.lit(" files of one MIME family.")))
        .when(k == "age_bucket", F.concat(count, F.lit(" files of one age band.")))
        .otherwise(F.concat(count, F.lit(" files grouped by heuristics.")))
    )
    conf = F.when(k == "duplicate_cluster", 0.95).when(k == "type_cluster", 0.7).when(k == "age_bucket", 0.6).otherwise(0.5)
    return F.struct(text.alias("rationale"), conf.alias("confidence"))


def split_label(label: Column | str, bucket_: Column | str) -> Column:
    """struct(top, sub): around the first arrow, else the bucket (or Category) and the whole label."""
    p = F.split(col(label), "→", 2)
    has = F.size(p) > 1
    return F.struct(F.when(has, strip(p[0])).otherwise(F.coalesce(col(bucket_), F.lit("Category"))).alias("top"), F.when(has, strip(p[1])).otherwise(col(label)).alias("sub"))


def tidy_label(label: Column | str) -> Column:
    """At most 40 characters; longer ones are cut to 37 and an ellipsis."""
    return F.when(F.length(col(label)) > 40, F.concat(F.substring(col(label), 1, 37), F.lit("…"))).otherwise(col(label))


def strip_tags(markup: Column | str) -> Column:
    """Markup tags to blanks, white space collapsed, at most 20,000 characters."""
    return F.substring(strip(F.regexp_replace(F.regexp_replace(col(markup), "<[^>]+>", " "), r"(?U)\s+", " ")), 1, 20000)


def cluster_key(bucket_: Column | str, sub: Column | str) -> Column:
    return F.concat_ws(":", col(bucket_), col(sub))


def chat_endpoint(url: str) -> str:
    """The chat-completions address of a server given with or without its path."""
    base = url.rstrip("/")
    if base.endswith("/chat/completions"):
        return base
    return base + ("/chat/completions" if base.endswith("/v1") else "/v1/chat/completions")
