import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from clausework.llm.exact_dedup import OP1_SQL, exact_dedup, exact_groups, op1_exact_dedup

ROWS = [(1, "a b", "x"), (2, "ab", "y"), (3, "a  b", "z"), (None, "a\tb  ", "n"), (5, None, "e"), (6, "", "e2"), (7, " \n", "e3"), (8, "other", "o"), (8, "other", "o"), (8, "oth er", "o2"), (9, "long " * 50_000, "l")]


def plain(rows):
    groups = defaultdict(list)
    for i, (d, t, _) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, i))
    return {k: (min(g), len(g)) for k, g in groups.items()}


@pytest.mark.parametrize("share", [1000, 10**9, 3])
def test_groups(spark, share):
    """Whatever the bound of a heavy digest, the result is the same; at 10^9 every repeated candidate is heavy."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string")
    got = exact_groups(df, share=share).collect()
    want = plain(ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        text = next(k for k in want if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        (_, null, d, _), n = want[text]
        assert (r.keep_id, r.group_size) == (None if null else d, n)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_kept_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string")
    got = exact_dedup(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert len(rows) == len(plain(ROWS))
    assert {r.text for r in rows} >= {"a\tb  ", " \n", "oth er"}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(df).count() == 0 and exact_dedup(df).count() == 0


def test_whole_table(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(OP1_SQL).fetchall()
    got = op1_exact_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
