"""Benchmark decontamination: a prefix-filtered set join of word shingles.

A window is ``ngram`` consecutive item words (a shorter item is one window).
Its set is its 5-word shingles (fewer words: the window itself). Shingles
are ordered by rarity, counted over all documents. A window lies in a
document only if all its shingles do, so its necessary prefix is its rarest
shingle. Windows join document shingles on that token; the position of the
shingle fixes where the window would start, which must leave room for all of it
(length and positional bounds); then the words themselves are compared.

A Bloom filter of fixed size over the items' shingles is all that is sent to
the tasks that read the documents; the exact join removes its false hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import cut, id_text, row_key, slices
from postlens.llm.kernels import ALNUM, U64, Words

NGRAM, SHINGLE = 13, 5
BLOOM_BITS = 24  # 2 ** 24 bits = 2 MiB, whatever the size of the benchmark


def _bits(h, bits: int = BLOOM_BITS):
    """The two Bloom positions of a hash (numpy)."""
    return (h >> U64(64 - bits)).astype(np.int64), ((h >> U64(8)) & U64((1 << bits) - 1)).astype(np.int64)


def item_windows(items: DataFrame, id_col: str, text_col: str, ngram: int, shingle: int) -> DataFrame:
    """``item_id, words, len, tokens``: every window and the hash of its shingle at each offset."""

    def run(batches):
        for b in slices(batches, "text"):
            w, ids = Words(b.column(1), ALNUM, True), b.column(0).to_pylist()
            rows = []
            for i, item in enumerate(ids):
                lo, hi = int(w.first[i]), int(w.first[i + 1])
                text = [w.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(w.start[lo:hi], w.end[lo:hi], strict=True)]
                n = min(ngram, hi - lo)
                if not n:
                    continue
                k = min(shingle, n)
                part = Words.__new__(Words)
                part.hash = w.hash[lo:hi]
                grams = part.grams(k).view(np.int64)
                rows += [(item, " ".join(text[j: j + n]), n, k, grams[j: j + n - k + 1].tolist())
                         for j in range(hi - lo - n + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()),
                 pa.array([r[4] for r in rows], pa.list_(pa.int64()))], names=["item_id", "words", "len", "k", "tokens"])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, words string, len int, k int, tokens array<long>")


def _bloom(tokens: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """The filter's bit words; at most 2 ** (bits - 6) rows reach the driver."""
    t = F.col("token")
    at = F.explode(F.array(F.shiftrightunsigned(t, 64 - bits), F.shiftrightunsigned(t, 8).bitwiseAND(F.lit((1 << bits) - 1))))
    rows = (tokens.select(at.alias("at"))
            .select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("m"))
            .groupBy("w").agg(F.bit_or("m").alias("m")).collect())
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in rows:
        out[r["w"]] = r["m"]
    return out.view(U64)


def postings(docs: DataFrame, bloom: np.ndarray, lengths: list[int], ngram: int) -> DataFrame:
    """One row per document: ``doc_id, _h1, _h2, n_words`` and its possible shingle hits with their context."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom)
    posting = pa.struct([("token", pa.int64()), ("pos", pa.int64()), ("lo", pa.int64()), ("ctx", pa.string())])

    def run(batches):
        filt = sent.value
        has = lambda at: (filt[at >> 6] >> (at & 63).astype(U64)) & U64(1) > 0
        for b in slices(batches, "text"):
            w = Words(b.column(1), ALNUM, True)
            tok, pos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in lengths:
                g = w.grams(k)
                first, second = _bits(g)
                ok = has(first)
                ok &= has(second)
                ok &= w.doc[: len(g)] == w.doc[k - 1: k - 1 + len(g)]
                hit = np.flatnonzero(ok)
                tok.append(g[hit].view(np.int64))
                pos.append(hit)
            tok, pos = np.concatenate(tok), np.concatenate(pos)
            order = np.argsort(pos, kind="stable")
            tok, pos = tok[order], pos[order]
            doc = w.doc[pos]
            lo = np.maximum(w.first[doc], pos - ngram + 1)
            hi = np.minimum(w.first[doc + 1], pos + ngram)
            raw = w.data.tobytes()
            start, end = w.start, w.end
            ctx = [b" ".join([raw[s:e] for s, e in zip(start[x:y], end[x:y], strict=True)]).decode("utf-8", "replace")
                   for x, y in zip(lo, hi, strict=True)]
            base = w.first[doc]
            values = pa.StructArray.from_arrays(
                [pa.array(tok), pa.array(pos - base), pa.array(lo - base), pa.array(ctx, pa.string())],
                fields=list(posting))
            offs = np.searchsorted(doc, np.arange(len(w.off)), "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(np.diff(w.first)),
                 pa.ListArray.from_arrays(pa.array(offs, pa.int32()), values)],
                names=["doc_id", "_h1", "_h2", "n_words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text"))).mapInArrow(
        run, f"doc_id {kind}, _h1 long, _h2 long, n_words long, "
             "hits array<struct<token:long,pos:long,lo:long,ctx:string>>")


def union_length(spans: Column) -> Column:
    """Positions covered by an array of ``(start, end)`` structs."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"),
        F.greatest(acc["upto"], s["end"]).alias("upto"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM,
                  shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id, _h1, _h2, n_words, n_hit, items``.

    A document word inside any occurrence of an item window is hit;
    ``items`` are the ids of the items with occurring windows, sorted
    as strings. Words are runs of a-z, 0-9 and non-ASCII characters after
    A-Z is lower-cased. Null and empty texts have no words and no hits; a null
    item id hits words but is not listed; equal items are all listed;
    repeated documents are judged once per row; empty tables on either
    side give documents without hits; other columns are ignored.
    """
    windows = cut(item_windows(items, item_id_col, item_text_col, ngram, shingle))
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most `shingle` values
    bloom = _bloom(windows.select(F.explode("tokens").alias("token")))
    found = cut(postings(id_text(docs, id_col, text_col), bloom, lengths, ngram))
    key = ["doc_id", "_h1", "_h2"]
    hits = found.where(F.size("hits") > 0).select(*key, "n_words", F.explode("hits").alias("h")).select(*key, "n_words", "h.*")
    rarity = hits.groupBy("token").agg(F.count("*").alias("n"))
    distinct = windows.groupBy("words", "len", "tokens").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    ranked = (distinct.select("words", "len", "items", F.posexplode("tokens").alias("off", "token"))
              .join(rarity, "token", "left")
              .groupBy("words", "len", "items")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("p"))
              .where("p.n > 0")
              .select("words", "len", "items", F.col("p.token").alias("token"), F.col("p.off").alias("off")))
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("ctx", " "), (start - F.col("lo") + 1).cast("int"), F.col("len")), " ") == F.col("words")
    d, p = hits.alias("d"), ranked.alias("p")
    matched = (d.join(p, (F.col("d.token") == F.col("p.token")) & fits)
               .where(F.when(fits, same).otherwise(F.lit(False)))
               .select(*key, start.alias("start"), (start + F.col("len")).alias("end"), "items"))
    per_doc = matched.groupBy("_h1", "_h2").agg(
        F.collect_set(F.struct("start", "end")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    per_doc = per_doc.select("_h1", "_h2", union_length(F.col("spans")).alias("hit"), "items")
    out = found.select(*key, "n_words").join(per_doc, ["_h1", "_h2"], "left")
    return out.select(*key, "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """The rule of the decontamination contract: hit words are at least a twentieth."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)
