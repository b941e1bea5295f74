"""The training-data operators against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from brute import groups, similar_pairs
from postlens.llm import common, decontam, kernels, license, linededup, packing, quality, simhash, substring, suffix, topk, urlfilter
from postlens.llm.queries import URL_RULES, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, fingerprint string, _h1 string, score string"


def lower(s):
    return (s or "").translate({c: c + 32 for c in range(65, 91)})


def texts(seed=3):
    """Shared passages, copies, near copies, periodic texts, odd characters."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "É", "naïve", "x\u00a0y", "日本"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, other = prose(60), prose(40)
    out = []
    for i in range(24):
        parts = [prose(rng.randint(3, 40))]
        if i % 3 == 0:
            parts.append(passage)
        if i % 4 == 1:
            parts.append(" ".join(other.split()[i % 7:]))
        parts.append(prose(rng.randint(3, 40)))
        out.append(rng.choice([" ", "\n", "  \t"]).join(parts))
    whole = prose(120)
    out += [whole, whole, whole.replace("w1", "w2", 1), whole + " end", "a " * 400, "b c " * 300, "ab" * 500, "x" * 900]
    out += ["", None, " \n\t ", "One", "one two", passage, passage.upper(), other]
    return out


def rows():
    out = [(i, t) for i, t in enumerate(texts())]
    out += [(5, out[5][1]), (None, out[0][1]), (None, None), (7, "clash " + out[0][1])]
    random.Random(1).shuffle(out)
    return out


@pytest.fixture(scope="module")
def table():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame([(*r, "f", "h", "s") for r in table], DOC).repartition(5)


def order(i):
    return (i is not None, i or 0)


def digest(b):
    return hashlib.sha256(b).hexdigest()


def test_substring_dedup(docs, table):
    first = {}
    seq = [(i, WORD.findall(t or "")) for i, t in table]
    for i, w in seq:
        for k in range(len(w) - 12):
            g = tuple(w[k:k + 13])
            first[g] = min(first.get(g, order(i)), order(i))
    want = Counter()
    for i, w in seq:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < order(i):
                gone |= set(range(k, k + 13))
        want[(i, len(w), len(gone), digest(" ".join(x for k, x in enumerate(w) if k not in gone).encode()))] += 1
    for kw in ({}, {"batch_bytes": 2000, "hot": 3}, {"batch_bytes": 500, "hot": 1}):
        out = substring.dedup_substrings(docs, **kw).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
        assert Counter(tuple(r) for r in out.collect()) == want


def test_suffix_array_dedup(docs, table):
    seq = [(i, (t or "").encode()) for i, t in table]
    count = Counter(b[k:k + 200] for _, b in seq for k in range(len(b) - 199))
    want = Counter()
    for i, b in seq:
        gone = [False] * len(b)
        for k in range(len(b) - 199):
            if count[b[k:k + 200]] > 1:
                gone[k:k + 200] = [True] * 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[(i, len(b), sum(gone), spans, digest(bytes(x for x, g in zip(b, gone, strict=True) if not g)))] += 1
    for kw in ({}, {"batch_bytes": 2000, "hot": 3}, {"batch_bytes": 500, "hot": 1}):
        out = suffix.dedup_bytes(docs, **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        assert Counter(tuple(r) for r in out.collect()) == want


def brute_fingerprint(text, k=3):
    w = WORD.findall(lower(text))
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, table):
    prints = [(i, brute_fingerprint(t)) for i, t in table]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(prints)):
        for y in range(x):
            if bin(prints[x][1] ^ prints[y][1]).count("1") <= 2:
                root[find(x)] = find(y)
    low = {}
    for x, (i, _) in enumerate(prints):
        r = find(x)
        known = [v for v in (low.get(r), i) if v is not None]
        low[r] = min(known) if known else None
    want = Counter((i, f"{fp:016x}", low[find(x)]) for x, (i, fp) in enumerate(prints))
    got = simhash.near_duplicates(docs)
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({find(x) for x in range(len(prints))})


@pytest.mark.parametrize("distance,segments", [(2, 2), (2, 3), (3, 2), (4, 2), (1, 4)])
def test_links_find_every_pair(spark, distance, segments):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) for b in base for _ in range(25)}
    signed = [p - (1 << 64) if p >> 63 else p for p in (x % (1 << 64) for x in prints)]
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), distance, segments)
    mask = (1 << 64) - 1
    want = {(a, b) for a in set(signed) for b in set(signed) if a < b and bin((a ^ b) & mask).count("1") <= distance}
    assert {tuple(r) for r in got.collect()} == want


def test_decontamination(spark, docs, table):
    items = [(1, table[0][1]), (10, None), (2, "One!"), (11, " ".join((texts()[0] or "").split()[:20])), (3, "THE"),
             (12, " ".join(texts()[37].split()[5:40])), (4, ""), (None, "one two"), (5, "w1 w2"), (5, "w1 w2")]
    got = decontam.decontaminate(docs, spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, token string"))
    windows = set()
    for i, t in items:
        w = ITEM_WORD.findall(lower(t))
        n = min(13, len(w))
        windows |= {(tuple(w[k:k + n]), i) for k in range(len(w) - n + 1) if n}
    want = Counter()
    for i, t in table:
        w = ITEM_WORD.findall(lower(t))
        hit, found = set(), set()
        for g, item in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= {str(item)} if item is not None else set()
        want[(i, len(w), len(hit), ",".join(sorted(found)))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got.collect()) == want


def test_packing_round_trip(spark, docs, table):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    odd = [(100, "<|endoftext|> Don't, I'll\u0085go\tÇÀ!! 1234 ﬁ İstanbul e\u0301"), (101, "word " * 6000), (102, "x" * 20000)]
    all_rows = table + odd
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    for kw in ({}, {"open_windows": 2, "window": 256, "fan_in": 2}):
        window = kw.get("window", 4096)
        pieces = packing.pack(frame, tokenizer_path(), **kw).collect()
        tokens = defaultdict(list)
        for i, t in all_rows:
            tokens[i].append(tok.encode(t or "", add_special_tokens=False).ids + [2])
        by_seq, by_doc = defaultdict(list), defaultdict(list)
        for p in pieces:
            by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
            by_doc[(p["doc_id"], p["doc_tokens"])].append(p)
        for spans in by_seq.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
            assert spans[-1][0] + spans[-1][1] <= window
        assert sum(s[-1][0] + s[-1][1] < window for s in by_seq.values()) <= 1
        crc = Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"]) for p in pieces)
        want_total = sum(len(t) for ts in tokens.values() for t in ts)
        assert sum(p["length"] for p in pieces) == want_total
        for i, ts in tokens.items():
            for ids in ts:
                data = b"".join(x.to_bytes(4, "little") for x in ids)
                own = [p for p in by_doc[(i, len(ids))] if zlib.crc32(data[4 * p["start"]: 4 * (p["start"] + p["length"])]) == p["ids_crc32"]]
                covered = {k for p in own for k in range(p["start"], p["start"] + p["length"])}
                assert covered == set(range(len(ids)))
        assert sum(crc.values()) == len(pieces)


def test_url_filter(spark):
    urls = ["http://a.example.net/en/1", "https://example.net/de/", "http://net/x", "http://Xnet/", "http://EXAMPLE.com/de/?q#x",
            "http://example.org/fr/#f", "http://b.c.example.org/fr/a?x=/y", "no scheme", None, "", "://", "http://example.net?x/en/",
            "http://example.net", "x://y.net/http://example.net/en/", "http://a..net/en/", "http://example.com:80/de/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate([*urls, urls[0]])] + [(None, urls[1], "h", "r")],
                                  "page_id long, url string, host string, rule string")
    rules = [(*r.split("/", 1), r, v) for r, v in URL_RULES]
    want = Counter()
    for i, u in [*enumerate([*urls, urls[0]]), (None, urls[1])]:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fit = [(len(r), r, v) for h, p, r, v in rules if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fit, default=(0, None, "allow"))
        want[(i, host, path, best[1], best[2])] += 1
    got = urlfilter.url_filter(pages, spark.createDataFrame(URL_RULES, "rule string, verdict string"))
    assert Counter(tuple(r) for r in got.collect()) == want
    many = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit(".net/p/")).alias("rule"), F.lit("block").alias("verdict"))
    hit = urlfilter.url_filter(spark.createDataFrame([(1, "http://q.h77.net/p/z"), (2, "http://h5001.net/p/")], "page_id long, url string"), many)
    assert {tuple(r)[3:] for r in hit.collect()} == {("h77.net/p/", "block"), (None, "allow")}
    none = urlfilter.url_filter(pages, rules=many.limit(0))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


def test_topk(spark):
    rng = random.Random(4)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(8)], "x") for i in range(300)]
    vecs += [(i, vecs[7][1], "x") for i in range(300, 360)]
    vecs += [(400, None, "x"), (450, [1.0, None] * 4, "x"), (500, [float("nan")] * 8, "x"), (550, [float("inf")] * 8, "x"),
             (None, vecs[0][1], "x"), (600, [], "x"), vecs[50], (650, [1.0, 2.0], "x"), (651, [3.0, 1.0], "x")]
    frame = spark.createDataFrame(vecs, "vec_id long, embedding array<double>, score string").repartition(3)
    import math
    good = {i: [math.floor(256 * x) for x in v] for i, v, _ in vecs
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q, v in good.items():
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good.items() if i != q and len(w) == len(v))[:5]
            want |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s)}
    for kw in ({}, {"row_block": 50, "query_block": 2, "pivots": 3}):
        assert {tuple(r) for r in topk.top_k(frame, **kw).collect()} == want


def brute_lines(table):
    """Kept lines per row key: the same links, found pair by pair."""
    split = re.compile(linededup.NOT_WORD)
    occ = defaultdict(list)
    for i, t in set(table):
        for k, s in enumerate((t or "").split("\n") if t is not None else []):
            norm = " ".join(w for w in split.split(s.lower()) if w)
            if norm:
                occ[norm].append((order(i), i, t, k))
    return occ


def test_line_dedup(spark):
    a = "the quick brown fox jumps over the lazy dog and runs away into the deep dark forest tonight"
    table = [(1, f"{a}\nunique one here"), (2, f"{a.upper()}!!\n\nother line of text"), (3, a.replace("quick", "quikc") + "\n---\n"),
             (4, "other line of text\nother line of text"), (5, None), (6, ""), (None, "unique one here\nnew"), (7, "---"),
             (4, "other line of text\nother line of text")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in table], "doc_id long, text string, line string, gone string")
    got = linededup.dedup_lines(frame).select("row.doc_id", "text", "n_lines", "n_removed", "row.gone")
    out = defaultdict(list)
    for r in got.collect():
        out[r["doc_id"]].append((r["text"], r["n_lines"], r["n_removed"]))
        assert r["gone"] == "y"
    assert out[1] == [(a, 2, 1)]  # "unique one here" stays with the null id, which comes first
    assert out[None] == [("unique one here\nnew", 2, 0)]
    assert out[2] == [("\nother line of text", 3, 1)]
    assert out[4] == [("", 2, 2)] * 2
    assert out[5] == [(None, 0, 0)] and out[6] == [("", 1, 0)] and out[7] == [("---", 1, 0)]


def test_line_links_match_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 60))] for _ in range(30)]
    lines = set()
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] += rng.choice(["", "x", "yz"])
            lines.add(" ".join(c))
    lines = sorted(lines)
    lines = [*lines, " ".join(rng.choice(vocabulary) for _ in range(400)), "q " * 200 + "r " * 201, "a b", "z"]
    frame = spark.createDataFrame([(i, s, i) for i, s in enumerate(lines)], "did long, text string, th long")
    prints = {r["did"]: (r["l1"], r["l2"], r["fp"] & ((1 << 64) - 1)) for r in linededup.fingerprinted(frame).collect()}
    spark_hash = {r["w"]: r["h"] & ((1 << 64) - 1) for r in spark.createDataFrame(
        [(w,) for s in lines for w in s.split()], "w string").select("w", F.xxhash64("w").alias("h")).distinct().collect()}
    for i, s in enumerate(lines):
        hs = [spark_hash[w] for w in s.split()]
        assert prints[i][2] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    name = {v[0]: i for i, v in prints.items()}
    got = {tuple(sorted((name[r["a1"]], name[r["b1"]])))
           for r in linededup.candidates(linededup.fingerprinted(frame)).collect()}
    words = lambda i: len(lines[i].split())
    want = {(x, y) for x in range(len(lines)) for y in range(x + 1, len(lines))
            if bin(prints[x][2] ^ prints[y][2]).count("1") <= 3
            and min(words(x), words(y)) >= 0.8 * max(words(x), words(y))}
    assert got == want and want


def test_fuzzy_lines_are_linked(spark):
    """Groups of lines against the edit similarity of all pairs."""
    rng = random.Random(12)
    vocabulary = [f"t{i}" for i in range(500)]
    lines = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(80, 160))]
        for _ in range(5):
            c = list(base)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(c))
                c[k:k + 1] = rng.choice([[], [rng.choice(vocabulary)], [c[k], "new"]])
            lines.append(" ".join(c))
        lines.append(" ".join(rng.sample(base, len(base))))  # the same words in another order: no link
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    pairs = similar_pairs([s.split() for s in lines])
    root = groups(len(lines), pairs)
    got = {r["doc_id"] for r in linededup.dedup_lines(frame).where("n_removed = 0").select("row.doc_id").collect()}
    assert got == set(root) and sum(lines[a] != lines[b] for a, b in pairs) > 20


def test_license_scan(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.txt", "some words"), (3, "a/b/y.txt", f"one two\n{gpl}\nthree " + "w " * 40),
             (4, "a/b/z.txt", None), (5, "q/z.txt", "nothing here"), (6, None, "nothing"), (7, None, "Licensed under CC BY-NC 4.0."),
             (8, "a/b/c/COPYING.md", "intro text. Licensed under the Apache License, Version 2.0. more"), (9, "a/b/c/d/e.txt", ""), (10, "top.txt", "x"),
             (2, "a/x.txt", "some words")]
    frame = spark.createDataFrame([(*f, "l") for f in files], "file_id long, path string, text string, license string")
    got = Counter((r["file_id"], r["license"], r["origin"], r["licensed_by"]) for r in license.scan(frame, license.templates(spark)).collect())
    assert got == Counter({(1, "MIT", "notice", None): 1, (2, "MIT", "inherited", "a"): 2, (3, "GPL-3.0-only", "notice", None): 1,
                           (4, "MIT", "inherited", "a"): 1, (5, None, None, None): 1, (6, None, None, None): 1,
                           (7, "CC-BY-NC-4.0", "notice", None): 1, (8, "Apache-2.0", "notice", None): 1,
                           (9, "Apache-2.0", "inherited", "a/b/c"): 1, (10, None, None, None): 1})


def test_quality(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("th", "er", "in", "an") for b in ("on", "at", "es", "ly")]
    good = lambda: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(60)).capitalize()
    bad = lambda: " ".join([rng.choice(words).upper() + "!!"] * 3 + [rng.choice(words) + "$$$" for _ in range(50)])
    table = [(i, good() if i % 3 else bad()) for i in range(400)]
    odd = [(None, good()), (900, None), (901, ""), (902, "word " * 300_000), (3, table[3][1])]
    frame = spark.createDataFrame([(*r, "x") for r in table + odd], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    model = quality.fit(frame, labels)
    got = quality.score(frame, model).collect()
    assert len(got) == 405 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 0.95 * len(held)
    # held-out labels change nothing
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(frame, flipped)
    assert (again.weights == model.weights).all() and again.slope == model.slope
    kept = quality.accepted(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(r["predicted"] for r in got)
    assert {r["score"] for r in quality.score(frame, quality.fit(frame, labels.limit(0))).collect()} == {1.0}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring.dedup_substrings(docs).count() == 0
    assert suffix.dedup_bytes(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert packing.pack(docs, tokenizer_path()).count() == 0
    assert linededup.dedup_lines(docs).count() == 0
    assert decontam.decontaminate(docs, docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert quality.score(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert urlfilter.url_filter(spark.createDataFrame([], "page_id long, url string"),
                                spark.createDataFrame(URL_RULES, "rule string, verdict string")).count() == 0
    assert license.scan(spark.createDataFrame([], "file_id long, path string, text string"), license.templates(spark)).count() == 0


def test_anchors_are_the_last_smallest():
    import numpy as np

    rng = random.Random(5)
    h = np.array([rng.randrange(6) << 40 for _ in range(200)], np.uint64)
    got = kernels.anchors(h, 7)
    for i in range(len(h) - 6):
        low = min(h[i:i + 7])
        assert got[i] == max(k for k in range(i, i + 7) if h[k] == low)


def test_license_cosine_matches_brute_force(spark):
    """Every notice of random mixtures of template terms, against cosines of all pairs: true counts and frequencies."""
    import math

    rng = random.Random(6)
    vocabulary = sorted({w for _, t in license.TEMPLATES for w in re.findall("[a-z0-9]+", t.lower())}) + [f"x{i}" for i in range(15)]
    files = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 4)):
            t = re.findall("[a-z0-9]+", rng.choice(license.TEMPLATES + license.HEADERS)[1].lower())
            keep = [w for w in t if rng.random() < rng.choice([1, 0.9, 0.7])] + rng.choices(vocabulary, k=rng.randint(0, 4))
            keep += rng.choices(keep or ["x"], k=rng.choice([0, 0, 3]))
            rng.shuffle(keep)
            lines.append(" ".join(keep))
        files.append((i, f"d{i}/f{i}", "\n".join(lines)))
    split = lambda s: Counter(re.findall("[a-z0-9]+", s.lower()))
    units = {i: [split(s) for s in [*t.split("\n"), t]] for i, _, t in files}  # without a blank line the text is a block
    df = Counter(w for us in units.values() for w in us[-1])
    n = len(files)
    known = [(r.license, split(r.text)) for r in license.templates(spark).collect()]
    idf = lambda w: math.log((n + 1) / (df[w] + 1)) + 1
    norm = lambda c: math.sqrt(sum((k * idf(w)) ** 2 for w, k in c.items()))
    cos = lambda a, b: round(sum(k * b[w] * idf(w) ** 2 for w, k in a.items()) / (norm(a) * norm(b)), 6)
    want = {}
    for i, us in units.items():
        best = min(((-cos(u, t), name) for u in us if u for name, t in known), default=(0, None))
        want[i] = (best[1], -best[0]) if -best[0] >= 0.8 else (None, None)
    got = {r.file_id: (r.license, r.similarity) for r in license.scan(
        spark.createDataFrame(files, "file_id long, path string, text string"), license.templates(spark)).collect()
        if r.origin != "inherited"}
    inherited = set(want) - set(got)
    assert all(want[i] == (None, None) for i in inherited)
    for i, (name, found) in got.items():
        assert name == want[i][0] and (found is None or abs(found - want[i][1]) < 2e-6)
    assert sum(name is not None for name, _ in want.values()) > 20


def test_similar_lines_are_found_without_near_fingerprints(spark):
    """Near copies of 5 to 100 words, against the edit similarity alone."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    table, twins = [], []
    for n in (5, 10, 20, 50, 100):
        for m in sorted({max(1, n // 20), max(1, n // 10), n // 5}):
            for _ in range(20):
                a = rng.choices(vocabulary, weights, k=n)
                b = list(a)
                for p in rng.sample(range(n), m):
                    b[p] = rng.choices(vocabulary, weights)[0]
                table += [(len(table), " ".join(a)), (len(table) + 1, " ".join(b))]
                twins.append((len(table) - 2, len(table) - 1))
    gone = {r.doc_id for r in linededup.dedup_lines(spark.createDataFrame(table, "doc_id long, text string"))
            .where("n_removed > 0").select("row.doc_id").collect()}
    missed = [p for p in twins if not gone & set(p)]
    assert len(missed) <= 0.02 * len(twins), missed
    # lines of other pairs are not similar: the first of each pair stays
    assert not gone & {a for a, _ in twins}


def few_word_lines():
    """Distinct lines of a small vocabulary, in which every word is frequent, with near copies and near copies of those."""
    rng = random.Random(11)
    vocabulary = [f"u{i}" for i in range(24)]
    lines = []
    for _ in range(120):
        c = [rng.choice(vocabulary) for _ in range(rng.choice([4, 5, 6, 9, 10, 11, 12, 14, 15, 20, 30]))]
        for _ in range(rng.randint(1, 5)):
            lines.append(" ".join(c))
            for _ in range(rng.randint(1, max(1, len(c) // 6))):
                k = rng.randrange(len(c))
                c[k:k + 1] = rng.choice([[], [rng.choice(vocabulary)], [c[k], rng.choice(vocabulary)]])
    lines += ["q " * n + "r " * m for n, m in ((9, 1), (8, 2), (12, 1), (1, 9), (2, 12))]
    return sorted({" ".join(s.split()) for s in lines})


@pytest.mark.parametrize("sizes", [{}, {"DIRECT": 12, "FINER": 1000}, {"DIRECT": 4, "FINER": 9}])
def test_lines_of_frequent_words_lose_no_link(spark, monkeypatch, sizes):
    """All groups against the edit similarity of all pairs, whatever the size at which a word's lines are dealt otherwise."""
    for name, n in sizes.items():
        monkeypatch.setattr(linededup, name, n)
    lines = few_word_lines()
    random.Random(5).shuffle(lines)
    root = groups(len(lines), similar_pairs([s.split() for s in lines]))
    got = {r.doc_id for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
           .where("n_removed = 0").select("row.doc_id").collect()}
    assert got == set(root) and len(got) < len(lines) - 100


def test_line_dedup_leaves_no_shuffle_files(spark):
    """What a stored frame shuffled is gone as its write ends, and the setting is as before; words go in parts."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    held = lambda: sum(f.stat().st_size for f in local.rglob("shuffle_*.data"))
    size = held()
    rows = spark.range(200_000).select((F.col("id") % 100_003).alias("k"), F.xxhash64("id").alias("v"))
    out = common.stored(rows.groupBy("k").agg(F.max("v").alias("v")), "cleaned")
    for _ in range(50):  # files are removed in the background
        if held() <= size:
            break
        time.sleep(0.1)
    assert held() <= size and out.count() == 100_003 and spark.conf.get(name, None) == before
    # no pair is lost or found twice between the parts
    lines = few_word_lines()[:60]
    docs = spark.createDataFrame(list(enumerate(lines)), "did long, text string").withColumn("th", F.xxhash64("text"))
    distinct = linededup.fingerprinted(docs).dropDuplicates(["l1", "l2"])
    rare = common.stored(linededup.rare_words(docs, distinct), "rare")
    pairs = lambda *part: {(r.a1, r.b1) for r in linededup.word_candidates(rare, 0.8, *part).collect()}
    assert set().union(*[pairs(k, 3) for k in range(3)]) == pairs() and pairs()


def test_repeated_rows_keep_their_fingerprints(spark):
    """Rows that repeat do not add up in the lanes (two copies of such a line ran over a long)."""
    line = " ".join(f"w{i % 3}" for i in range(120))
    table = [(1, line)] * 5 + [(2, f"{line}\nanother line here")]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    keyed = frame.select(F.col("doc_id").alias("did"), F.xxhash64("text").alias("th"), "text")
    assert len({r.fp for r in linededup.fingerprinted(keyed).where("len = 120").collect()}) == 1
    got = sorted((r.row.doc_id, r.n_removed) for r in linededup.dedup_lines(frame).collect())
    assert got == [(1, 0)] * 5 + [(2, 1)]


def test_common_words_beside_a_notice_weigh_little(spark):
    """A word of most files before a notice, at its true document frequency."""
    files = [(i, f"d{i}/f.txt", f"also word{i} and others" if i % 3 else f"word{i}") for i in range(1000)]
    files.append((1000, "x/f.txt", "also Released under the MIT License."))
    got = {r.file_id: (r.license, r.similarity) for r in license.scan(
        spark.createDataFrame(files, "file_id long, path string, text string"), license.templates(spark)).collect()}
    assert got[1000][0] == "MIT" and got[1000][1] > 0.95
    assert got[1] == (None, None)


def test_license_headers_anywhere(spark):
    """A header is found behind any number of paragraphs, and over several of them."""
    head = dict(license.HEADERS)["GPL-3.0-or-later"]
    cut = head.index("This program is distributed")
    other = "\n\n".join(f"paragraph {i} of something else, in some words{i}" for i in range(9))
    files = [(1, "a/x.txt", other + "\n\n" + head), (2, "b/x.txt", other + "\n\n" + head[:cut] + "\n \n" + head[cut:] + "\n\n" + other),
             (3, "c/x.txt", other), (4, "d/x.txt", "")]
    got = {r.file_id: r.license for r in license.scan(
        spark.createDataFrame(files, "file_id long, path string, text string"), license.templates(spark)).collect()}
    assert got == {1: "GPL-3.0-or-later", 2: "GPL-3.0-or-later", 3: None, 4: None}


def test_license_headers_and_whole_texts(spark):
    """Headers over several lines and whole licence files, which pass their licence on."""
    whole = {r.license: r.text for r in license.templates(spark).collect() if len(r.text) > 1000}
    gpl = dict(license.HEADERS)["GPL-3.0-or-later"]
    comment = "#!/bin/sh\n# Copyright 2020 A. Author\n#\n" + "\n".join("# " + s for s in gpl.split("\n"))
    files = [(i, f"{name}/LICENSE", text) for i, (name, text) in enumerate(sorted(whole.items()))]
    files += [(20 + i, f"{name}/src/a.py", "x = 1") for i, name in enumerate(sorted(whole))]
    files += [(40, "q/a.sh", comment + "\n" + "echo one\n" * 200), (41, "q/b.sh", "echo one")]
    got = {r.file_id: (r.license, r.origin) for r in license.scan(
        spark.createDataFrame(files, "file_id long, path string, text string"), license.templates(spark)).collect()}
    for i, name in enumerate(sorted(whole)):
        assert got[i] == (name, "notice") and got[20 + i] == (name, "inherited")
    assert got[40] == ("GPL-3.0-or-later", "notice") and got[41] == (None, None)


def test_very_long_near_copies_are_found(spark):
    rng = random.Random(9)
    a = [f"w{rng.randrange(50000)}" for _ in range(17_000)]
    b = [w + "x" if i % 4000 == 7 else w for i, w in enumerate(a)]
    frame = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, "one two")], "doc_id long, text string")
    assert {r.row.doc_id: r.n_removed for r in linededup.dedup_lines(frame).collect()} == {1: 0, 2: 1, 3: 0}


def test_word_frequencies_are_counted_in_every_text(spark):
    """All texts count, also those whose hash is not divisible by eight, and the words on both sides of a newline."""
    rows = [(i, 8 * i + 1 + i % 7, "Alpha beta\nalpha") for i in range(20)] + [(20, 8, "gamma")]
    got = linededup.frequency_classes(spark.createDataFrame(rows, "did long, th long, text string"))
    at = {r.w: r.c for r in spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "w string").select(
        "w", F.pmod(F.xxhash64("w"), F.lit(linededup.CLASSES)).alias("c")).collect()}
    assert {w: got[c] for w, c in at.items()} == {"alpha": 21, "beta": 17, "gamma": 4} and sum(got) == 42


def test_fingerprints_are_compiled(spark):
    """No generated method over 8,000 bytes: the JVM would interpret it for every line."""
    docs = spark.createDataFrame([(1, 1, "one two")], "did long, th long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else there is no code before it runs
    try:
        plan = linededup.fingerprinted(docs)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) < 8000
