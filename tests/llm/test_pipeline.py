"""Stages of the pipeline against plain Python, row for row, each on what the one before it kept."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def plain_quality(rows):
    """Base failures go; soft failures go with a host whose shrunk failure rate is above one half."""
    judged = []
    for r in rows:
        w = words(r["text"])
        grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in (r["text"] or "").split("\n") if words(x)]
        chars = sum(map(len, w))
        symbols = sum(c in "#*$%&|<>" for x in w for c in x)
        base = len(w) < 10 or 100 * len(again) > 20 * len(w)
        judged.append((r, base, 100 * symbols > 10 * chars or 100 * (len(lines) - len(set(lines))) > 30 * len(lines)))
    hosts = defaultdict(lambda: [0, 0])
    for r, base, soft in judged:
        hosts[r["source"]][0] += 1
        hosts[r["source"]][1] += base or soft
    rates = [f / n for n, f in hosts.values()]
    m = sum(rates) / len(rates)
    v = sum((x - m) ** 2 for x in rates) / len(rates)
    k = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v else 1.0
    bad = {h for h, (n, f) in hosts.items() if round((f + m * k) / (n + k), 9) > 0.5}
    return [r for r, base, soft in judged if not base and not (soft and r["source"] in bad)]


def plain_lines(rows):
    seen, out = [], {}
    for r in sorted((r for r in rows if r["text"] is not None), key=lambda r: r["doc_id"]):
        kept = []
        for line in r["text"].split("\n"):
            s = set(words(line))
            if not s or not any(100 * len(s & e) >= 85 * len(s | e) for e in seen if 100 * min(len(s), len(e)) >= 85 * max(len(s), len(e))):
                kept.append(line)
            if s:
                seen.append(s)
        out[r["doc_id"]] = "\n".join(kept)
    return [r | {"text": out.get(r["doc_id"], r["text"]), "n_chars": r["n_chars"] if out.get(r["doc_id"], r["text"]) == r["text"] else len(out[r["doc_id"]])} for r in rows]


def plain_near(rows):
    sets = {}
    for r in rows:
        w = words((r["text"] or "").translate(LOWER))
        sets[r["doc_id"]] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def plain_benchmark(rows, items):
    split = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = {tuple(w[k:k + 10]) for t in items if (w := split(t)) for k in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in windows}
    return [r for r in rows if not any(tuple(w[k:k + n]) in windows for w in [split(r["text"])] for n in sizes for k in range(len(w) - n + 1))]


@pytest.fixture(scope="module")
def corpus(spark):
    """The smallest documents with planted cases of every stage, ids beyond theirs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = [r["text"] for r in rows if len(words(r["text"])) > 60][:12]
    texts = []
    for k, t in enumerate(long):
        w = words(t)
        texts.append((t, "copy.example"))                                                     # exact copy
        texts.append((" ".join(w[:30] + ["changed"] + w[31:]), "copy.example"))                # near copy
        texts.append((f"own words of page {k} stand here before " + items[k % len(items)] + f" and after it number {k}", "leak.example"))
    texts += [(f"symbols {k} here " + " ".join(f"w{k}x{j} ## ** %% &&" for j in range(8)), "bad.example") for k in range(25)]
    texts += [(f"fine page {k} " + " ".join(f"z{k}y{j}" for j in range(12)), "bad.example") for k in range(3)]
    texts += [(f"lone symbols {k} " + " ".join(f"q{k}x{j} ## ** %%" for j in range(8)), "copy.example") for k in range(2)]
    texts += [("shared menu line of many pages\n" + " ".join(f"page{k}word{j}" for j in range(15)), "copy.example") for k in range(6)]
    texts += [(None, "copy.example"), ("", "copy.example"), ("a few words", None)]
    first = 1 + max(r["doc_id"] for r in rows)
    for k, (t, source) in enumerate(texts):
        rows.append(dict.fromkeys(docs.columns) | {"doc_id": first + k, "text": t, "source": source, "n_chars": len(t or "")})
    return docs.schema, rows, items


def as_rows(rows, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in rows)


def test_stages_equal_plain_python(spark, corpus):
    schema, rows, items = corpus
    plain = [plain_quality, plain_lines, plain_near, lambda r: plain_benchmark(r, items)]
    for (name, stage), rule in zip(corpus_pipeline.STAGES, plain):
        docs = spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema).repartition(3)
        got, want = [r.asDict() for r in stage(spark, docs, SF).collect()], rule(rows)
        assert as_rows(got, schema.names) == as_rows(want, schema.names), name
        assert as_rows(want, schema.names) != as_rows(rows, schema.names), name
        if name == "quality rules":
            gone = {r["doc_id"] for r in rows} - {r["doc_id"] for r in want}
            assert sum(r["source"] == "bad.example" and r["doc_id"] in gone for r in rows) == 25      # its fine pages stay
            assert sum("lone symbols" in (r["text"] or "") for r in want) == 2                       # a soft failure elsewhere stays
        rows = want
    docs = spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == {r["doc_id"] for r in rows} and all(r.round_trip and len(r.ids) == r.n_pieces for r in last)


def test_stages_delete_the_tables_of_the_one_before(spark, corpus):
    schema, rows, _ = corpus
    docs = spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows[:40]], schema)
    corpus_pipeline.STAGES[1][1](spark, docs, SF).collect()
    used = list(corpus_pipeline._used)
    assert used and all(spark.read.parquet(p) is not None for p in used)
    corpus_pipeline.STAGES[4][1](spark, docs, SF)
    for p in used:
        with pytest.raises(Exception):
            spark.read.parquet(p)


def test_run_on_empty_documents(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
