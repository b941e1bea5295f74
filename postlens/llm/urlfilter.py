"""URL filtering: a blocked Bloom filter of listed canonical URLs, then an exact join.

Rules are canonical ``host/path`` prefixes. The keys of a URL are its host
and each parent domain, with each listed length of path prefix. Each key is
probed in a blocked Bloom filter (one 64-bit word per block, so a probe
touches one row); only possible hits reach the exact hash join with the list,
which removes the false ones. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, PROBES = 16, 4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_after(url), "/", 1)).otherwise(F.lit(""))
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, _after(url)).otherwise(F.lit(""))
    clean = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    at = F.instr(clean, "/")
    return F.coalesce(F.when(at > 0, clean.substr(at, F.length(clean))).otherwise(F.lit("")), F.lit(""))


def _after(url: Column) -> Column:
    return url.substr(F.instr(url, "://") + 3, F.length(url))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, probes: int = PROBES) -> Column:
    h = F.xxhash64(F.lit(11), key)
    out = F.lit(0).cast("long")
    for i in range(probes):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The blocked filter as a table ``_block, _word`` (one row per non-empty block)."""
    return listed.groupBy(_block(F.col(key), blocks).alias("_block")).agg(F.bit_or(_mask(F.col(key))).alias("_word"))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``rule`` (host, then a path that starts with ``/``) and
    ``verdict``. A rule fits its host and all subdomains where the path starts
    with the rule's; of several the longest wins (longest host first cannot
    differ: ties of length go to the smaller text). Without a rule ``rule`` is
    null and the verdict ``default``. Null urls and urls without ``://`` have
    empty host and path, which no rule fits. Rules of a null text are
    ignored, of equal rules the smallest verdict holds. Repeated rows and
    null ids are judged row by row; no rules leave every verdict
    at ``default``; an empty table gives no rows; other columns are ignored.
    """
    listed = (rules.select(F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"))
              .where(F.instr("_rule", "/") > 1)
              .groupBy("_rule").agg(F.min("_verdict").alias("_verdict")))
    size = listed.agg(F.count("*").alias("n"), F.collect_set(
        F.length("_rule") - F.instr("_rule", "/") + 1).alias("lengths")).first()
    lengths = sorted(size["lengths"])  # distinct path lengths: at most the length of the longest path
    blocks = max(1, -(-size["n"] * BITS_PER_KEY // 64))
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # the verdict depends on host and path alone: judge distinct pairs
    pairs = base.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_distinct(F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)]), lambda n: (n > 0) & (n <= F.length("path"))),
        lambda n: F.substring(F.col("path"), F.lit(1), n)))
    keys = (pairs.select("host", "path", F.explode(hosts).alias("_h"))
            .select("host", "path", "_h", F.explode(prefixes).alias("_p"))
            .select("host", "path", F.concat("_h", "_p").alias("_key")))
    filt = bloom(listed, "_rule", blocks)
    possible = (keys.withColumn("_b", _block(F.col("_key"), blocks))
                .join(filt, (F.col("_b") == F.col("_block")) & (F.col("_word").bitwiseAND(_mask(F.col("_key"))) == _mask(F.col("_key"))))
                .select("host", "path", "_key"))
    hits = possible.join(listed, F.col("_key") == F.col("_rule"))
    best = hits.groupBy("host", "path").agg(
        F.min(F.struct((-F.length("_rule")).alias("n"), "_rule", "_verdict")).alias("_best"))
    return (base.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("_best._rule").alias("rule"),
                    F.coalesce("_best._verdict", F.lit(default)).alias("verdict")))
