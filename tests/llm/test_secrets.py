import base64
import hashlib
import random
import re

from clausework.llm.secrets import BASE, find_secrets, op3_secret_scan


def plain(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            if len(m[group]) >= least:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_secret_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))


def test_random_tokens_and_text(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows.append((i, f"see 🙂 {base64.b64encode(rng.randbytes(36)).decode()} here"))
        rows.append((100 + i, f"see {'_'.join(rng.choices(['get', 'user', 'name', 'The', 'value', 'from', 'table2', 'Config'], k=6))} here"))
        rows.append((200 + i, f"id {''.join(rng.choices('0123456789', k=30))} {''.join(rng.choices('abcdefgh', k=30))}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans if s.kind == "random"] for r in find_secrets(df).collect()}
    assert sum(bool(got[i]) for i in range(60)) >= 55
    assert sum(bool(got[i]) for i in range(100, 160)) <= 3
    first = next(s for i in range(60) for s in got[i])
    assert first.start == 6


def test_edges(spark):
    df = spark.createDataFrame(
        [(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "PassWord: 'abcdefghijkl' token=token=abcdefghijkl AKIA" + "A1" * 7 + " " + "0f" * 8, "c"), (3, "x" * 200_000 + " secret=" + "k9" * 6, None)],
        "doc_id long, text string, spans string",
    )
    got = sorted(find_secrets(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [len(r.base) for r in got[:3]] == [0, 0, 0]
    assert [f"{s.kind}:{s.start}:{s.end}" for s in got[3].base] == plain(df.collect()[3].text)
    assert [s.kind for s in got[4].base] == ["assign"]
    assert find_secrets(df.where("false")).count() == 0
    assert find_secrets(df).columns == ["doc_id", "text", "base", "spans"]


def test_thresholds_follow_benjamini_and_hochberg(spark):
    """Per stratum the discoveries are those up to the last ordered p-value that lies under its rank's share of the rate."""
    from clausework.llm.secrets import BINS, RATE, thresholds

    rng = random.Random(11)
    bins = {f"s{k}": [min(120, int(rng.expovariate(1 / (4 + 6 * k)))) for _ in range(40 + 25 * k)] for k in range(6)} | {"none": [0] * 30}
    rows = [([(name, b)],) for name, own in bins.items() for b in own] + [([],), (None,)]
    df = spark.createDataFrame(rows, "candidates array<struct<stratum:string,bin:int>>")
    want = {}
    for name, own in bins.items():
        p = sorted(10 ** (-b / BINS) for b in own)
        last = max((k for k in range(1, len(p) + 1) if p[k - 1] <= RATE * k / len(p)), default=0)
        if last:
            want[name] = min(b for b in own if 10 ** (-b / BINS) <= p[last - 1] + 1e-15)
    assert len(want) > 2 and "none" not in want
    assert {r.stratum: r.least for r in thresholds(df).collect()} == want
