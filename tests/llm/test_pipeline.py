"""The corpus pipeline stage by stage, the SQL of the queries, and the entry point without the subpackage."""

from __future__ import annotations

import re
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline as P
from brute import groups, similar_pairs
from postlens.llm import decontam, linededup
from postlens.llm.oracle import SQL
from postlens.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
TABLES = ["documents", "benchmark", "embeddings", "pages", "labels"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents, and what every stage made of the ones before."""
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(None, None, "en", None, None), (1, "", None, "s", 0), (90001, "one line\none line", "en", "s", 17)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{base}/{i}")
        out.append(spark.read.parquet(f"{base}/{i}"))
    return out


def test_stages_keep_the_columns(stages):
    for made in stages[1:-1]:
        assert made.columns == stages[0].columns
        assert made.schema == stages[0].schema


def test_quality_stage(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i in bad) <= 0.3 * len(bad)  # a few dozen rows of that class teach it here
    before = {r.doc_id: r for r in stages[0].collect()}
    assert all(before[r.doc_id] == r for r in stages[1].collect() if r.doc_id not in (None, 1))


def test_line_stage(stages):
    """Each kept line is of the input, in order; a line that is the first of its text stays; no equal lines are left."""
    split = re.compile(linededup.NOT_WORD)
    norm = lambda s: " ".join(w for w in split.split(s.lower()) if w)
    rows = stages[1].collect()
    first = {}
    for r in sorted((r for r in rows if r.text is not None), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        for k, s in enumerate(r.text.split("\n")):
            first.setdefault(norm(s), (r.doc_id, k))
    by_text = defaultdict(list)
    for r in stages[2].collect():
        by_text[r.doc_id].append(r)
    assert len(rows) == stages[2].count()
    seen = defaultdict(int)
    for r in rows:
        if r.text is None:
            continue
        if len([x for x in rows if x.doc_id == r.doc_id]) > 1:
            continue
        after = by_text[r.doc_id][0]
        lines, left = r.text.split("\n"), after.text.split("\n")
        it = iter(lines)
        assert after.text == "" or all(any(s == x for x in it) for s in left)
        assert after.n_chars == len(after.text)
        for s in left:
            if norm(s):
                seen[norm(s)] += 1
        for s in lines:
            if not norm(s) and after.text:
                assert s in left
    assert all(n == 1 for n in seen.values())
    # of each group of similar lines the first occurrence stays, and nothing else goes
    norms = sorted((n for n in first if n), key=lambda n: (first[n][0] is not None, first[n][0] or 0, first[n][1]))
    root = groups(len(norms), similar_pairs([n.split() for n in norms]))
    for i, n in enumerate(norms):
        if first[n][0] not in (None, 1):  # ids of several rows are not looked at above
            assert (n in seen) == (root[i] == i), n
    assert sum(r != i for i, r in enumerate(root)) > 20


def test_near_duplicate_stage(stages):
    from test_contracts import brute_fingerprint

    rows = [(r.doc_id, r.text, brute_fingerprint(r.text)) for r in stages[2].collect()]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if bin(rows[x][2] ^ rows[y][2]).count("1") <= 2:
                root[find(x)] = find(y)
    groups = defaultdict(list)
    for x, r in enumerate(rows):
        groups[find(x)].append(r[0])
    want = sorted(min((i for i in g if i is not None), default=-1) for g in groups.values())
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in stages[3].collect()) == want


def test_decontamination_stage(spark, stages):
    from test_contracts import ITEM_WORD, lower

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = ITEM_WORD.findall(lower(r.text))
        windows |= {tuple(w[k:k + 13]) for k in range(len(w) - 12)} or {tuple(w)}
    want = []
    for r in stages[3].collect():
        w = ITEM_WORD.findall(lower(r.text))
        hit = set()
        for k in range(len(w)):
            for n in {len(g) for g in windows}:
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            want.append(r)
    assert sorted(stages[4].collect(), key=str) == sorted(want, key=str)
    assert len(want) < stages[3].count()


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    every = [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in stages[4].collect()]
    ids = {(i, len(x)): x for i, x in every}
    assert len(ids) == len(every)
    got = defaultdict(int)
    for p in stages[5].collect():
        part = ids[p.doc_id, p.doc_tokens][p.start: p.start + p.length]
        assert len(part) == p.length
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == p.ids_crc32
        got[p.doc_id, p.doc_tokens] += p.length
    assert got == {k: len(x) for k, x in ids.items()}


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in P.run(spark, SF).select("doc_id").collect()} <= {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(SQL[name])
    cols = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want.fetchall()))


def test_contamination_rule(spark):
    df = spark.createDataFrame([(20, 1), (21, 1), (0, 0), (5, 0)], "n long, h long")
    assert [r[0] for r in df.select(decontam.contaminated(df.n, df.h)).collect()] == [True, False, False, False]


def test_entry_without_the_subpackage():
    """The other queries stay when the subpackage and the pipeline are absent."""
    script = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("postlens.llm"):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as E
from postlens.plans.registry import QUERIES
assert set(E.queries()) == set(QUERIES) == set(E.oracle_sql())
print("FINE")
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert "FINE" in out.stdout, out.stderr[-2000:]
