"""The corpus operators against SQL, brute force, exact round trips and held-out accuracy."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from kgloom import llm
from kgloom.llm import (html_extract, line_dedup, minhash_dedup, pii, piece_sampling, quality_rules, seekable,
                        substring_dedup, token_files, warc_bundles)
from kgloom.llm.decontamination import contamination, decontaminate

SF = "/root/testdata/sf0.001"
MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(str(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = llm.queries()[name](spark, SF)
    cur = con.execute(llm.oracle_sql()[name])
    assert as_rows(df.columns, df.collect()) == as_rows([d[0] for d in cur.description], cur.fetchall())


LONG = " ".join(f"w{k % 997}" for k in range(30_000))
ODD = [(1, None, "en", None, 1), (2, "", "en", "s", 0), (3, " \n\t", None, "s", 3), (None, "one two three four five six", "en", "s", 9),
       (4, LONG, "en", "s", len(LONG)), (5, LONG, "en", "s", len(LONG)), (5, LONG, "en", "s", len(LONG)),
       (6, "same id", "en", "s", 7), (6, "other text", "en", "s", 10), (7, "x" * 20_000, "en", None, 20_000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, DOCS)
    # names that the operators use themselves, as columns of the input
    for c in ("id", "rid", "n", "comp", "hits", "line", "w", "_q_host", "found", "start", "seed"):
        rows = rows.selectExpr("*", f"'x' as {c}")
    return rows


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "other text"), (3, None), (4, "")], "item_id long, text string")


JOBS = {
    "substring": lambda d, i: substring_dedup.substring_dedup(d).drop("kept_text"),
    "minhash": lambda d, i: minhash_dedup.near_duplicates(d),
    "keep_one": lambda d, i: minhash_dedup.keep_one(d),
    "pii": lambda d, i: pii.find_pii(d),
    "quality": lambda d, i: quality_rules.quality_verdicts(d, carry=["doc_id"]),
    "contamination": lambda d, i: contamination(d, i),
    "decontaminate": lambda d, i: decontaminate(d, i),
    "lines": lambda d, i: line_dedup.dedup_lines(d),
    "pieces": lambda d, i: piece_sampling.sample_pieces(d, MODEL, with_ids=False),
}


@pytest.mark.parametrize("job", sorted(JOBS))
def test_odd_rows_and_empty_tables(odd, items, job):
    rows = JOBS[job](odd, items).collect()
    many = {"keep_one": 8, "decontaminate": 6, "pieces": 17}
    assert len(rows) == many.get(job, len(ODD)), rows
    assert JOBS[job](odd.where("false"), items.where("false")).count() == 0


def test_odd_rows_have_the_defined_results(odd, items):
    sub = {(r.doc_id, r.n_words): r for r in substring_dedup.substring_dedup(odd).collect()}
    assert sub[(1, 0)].n_removed == 0 and sub[(1, 0)].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert sub[(5, 30_000)].n_removed == 30_000 and sub[(4, 30_000)].n_removed == 0
    near = minhash_dedup.near_duplicates(odd).collect()
    assert [r.kept for r in near if r.id == 5] == [False, False] and all(r.component_id == 4 for r in near if r.id in (4, 5))
    assert all(r.kept for r in near if r.id not in (5,))
    hit = {(r.id, r.n_words): r.n_hit for r in contamination(odd, items).collect()}
    assert hit[(6, 2)] in (0, 2) and hit[(4, 30_000)] > 11 and hit[(1, 0)] == 0
    kept = {r.doc_id for r in decontaminate(odd, items).collect()}
    assert {1, 2, 3, 7, None} <= kept and not {4, 5} & kept


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh"])
def test_substring_dedup_by_brute_force(spark, alphabet):
    rng, window = random.Random(len(alphabet)), 7
    docs = []
    for k in range(60):
        words = [rng.choice(alphabet) for _ in range(rng.randint(0, 40))]
        if docs and rng.random() < 0.6:
            other = rng.choice(docs)[1].split()
            lo = rng.randint(0, len(other))
            words[rng.randint(0, len(words)):0] = other[lo:lo + rng.randint(0, 30)]
        docs.append((k, " ".join(words)))
    got = {r.doc_id: r.kept_text for r in substring_dedup.substring_dedup(
        spark.createDataFrame(docs, "doc_id long, text string"), window=window).collect()}
    seen: set = set()
    for k, text in docs:
        w = text.split()
        mine = [tuple(w[i:i + window]) for i in range(len(w) - window + 1)]
        gone = {i + j for i, x in enumerate(mine) if x in seen for j in range(window)}
        assert got[k] == " ".join(x for i, x in enumerate(w) if i not in gone), k
        seen |= set(mine)


@pytest.mark.parametrize("common", [1, line_dedup.COMMON])
def test_line_dedup_by_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(line_dedup, "COMMON", common)
    rng, vocabulary = random.Random(5), [f"v{k}" for k in range(60)]
    base = [rng.sample(vocabulary, rng.randint(1, 25)) for _ in range(12)]
    docs = []
    for k in range(50):
        lines = []
        for _ in range(rng.randint(1, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(" ".join(line))
        docs.append((k, "\n".join(lines)))
    got = {(r.id, r.line) for r in line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    earlier, want = [], set()
    for k, text in docs:
        for i, line in enumerate(text.split("\n")):
            s = set(line.split())
            if not s:
                continue
            if any(100 * len(s & e) >= line_dedup.PERCENT * len(s | e) for e in earlier):
                want.add((k, i))
            earlier.append(s)
    assert want and got == want


@pytest.mark.parametrize("percent", [line_dedup.PERCENT, 60])
def test_line_dedup_of_short_lines_by_brute_force(spark, percent):
    rng, vocabulary = random.Random(6), ["读者留言版", "https://a.example/" + "x" * 300, *[f"v{k}" for k in range(7)]]
    docs = [(k, "\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(0, 7))) for _ in range(rng.randint(1, 4)))) for k in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent).collect()}
    earlier, sizes = [], set()
    for k, text in docs:
        left = []
        for line in text.split("\n"):
            s = set(line.split())
            if s and any(100 * len(s & e) >= percent * len(s | e) for e in earlier):
                sizes.add(len(s))
            else:
                left.append(line)
            earlier.append(s)
        assert got[k] == "\n".join(left), k
    assert {1, 2, 3, 4} <= sizes


@pytest.mark.parametrize("percent", [50, 85])
def test_line_dedup_on_two_tokens_by_brute_force(spark, monkeypatch, percent):
    """Every token is common: pairs that share one token only, and sets that share many, meet by their keys."""
    monkeypatch.setattr(line_dedup, "COMMON", 0)
    rng = random.Random(percent)
    docs = [(k, " ".join(rng.sample([f"v{i}" for i in range(24)], rng.choice([1, 2, 2, 3, 20, 21])))) for k in range(90)]
    got = {r.id for r in line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent).collect()}
    sets = [set(text.split()) for _, text in docs]
    want = {k for k, s in enumerate(sets) if any(100 * len(s & e) >= percent * len(s | e) for e in sets[:k])}
    assert want and got == want


def test_lines_of_a_common_token_meet_once_on_two_tokens(spark):
    """Lines with one token in common never meet; two that share many meet on one key."""
    rows = [(k, 0, 20, 0, 0, 7, [7, 1000 + k, 2000 + k], [1000 + k, 2000 + k]) for k in range(50)]
    alike = [(100 + k, 0, 20, 0, at, t, [7, 8, 9, 10], [7, 8, 9, 10][at + 1:]) for k in range(2) for at, t in enumerate([7, 8, 9])]
    entries = spark.createDataFrame(rows + alike, "id long, line int, n int, bits long, at int, token int, prefix array<int>, later array<int>")
    pairs = line_dedup._on_two_tokens(entries, entries, 85).collect()
    assert [(r.xd, r.yd) for r in pairs] == [(100, 101)]


def test_lines_are_cut_into_tokens_once(spark, monkeypatch):
    plans, write = {}, line_dedup.staged

    def planned(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(line_dedup, "staged", planned)
    line_dedup.removed_lines(spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string"))
    assert plans["lines"].count("array_distinct") == 1


def test_minhash_by_brute_force(spark):
    rng = random.Random(9)
    docs, base = [], [[f"{c}{rng.randrange(500)}" for _ in range(120)] for c in "abc"]
    for k in range(160):
        words = list(base[k % 3])
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in range(len(docs))}


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    parts = [" ", "\n", "\t", "the", "é", "'s", "1", ",", "  ", "<|endoftext|>", "漢", "word"]
    docs = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for k in range(300)]
    docs += [(300, None), (301, LONG)]
    files = token_files.write_tokens(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path), BPE)
    got = {r.doc_id: r for r in token_files.read_tokens(files).collect()}
    t, start = Tokenizer.from_file(BPE), 0
    want = {k: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for k, x in docs}
    for k, _ in docs:
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(want[k]), zlib.crc32(want[k].tobytes()))
        start += len(want[k])
    for f in files.collect():
        with seekable.Reader(f.path) as reader:
            for doc, first, count in token_files.documents_of(reader)[::37]:
                assert (token_files.tokens_at(reader, first, count) == want[doc]).all()
    with open(f.path, "r+b") as raw:        # a damaged frame is noticed
        raw.seek(12)
        raw.write(b"\0\0\0\0")
    with pytest.raises(Exception):
        with seekable.Reader(f.path) as reader:
            reader.frame(0)


def test_pii_base_spans_by_plain_patterns():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
             "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15,
                "ip": kind == "ip" and all(int(p) <= 255 for p in s.split("."))}[kind]

    rng = random.Random(3)
    for _ in range(20_000):
        s = "".join(rng.choice("a1@.+- (9%0\né") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(s) == {k: [m.span() for m in re.finditer(p, s) if good(k, m[0])] for k, p in plain.items()}
    assert pii.base_spans("4111 1111 1111 1111")["card"] == [(0, 19)] and not pii.base_spans("4111 1111 1111 1112")["card"]
    kinds = [s[0] for s in pii.find("IBAN GB82 WEST 1234 5698 7654 32; tel 030 1234 5678, ssn 123-45-6789; 123-45-6789x" + " " * 60 + "987-65-4321")]
    assert kinds == ["iban", "national_id", "local_phone"] or kinds == ["iban", "national_id", "national_id", "local_phone"]


def test_html_extraction_on_held_out_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    model = html_extract.train(pages[:100])

    def article(page):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<b>", "").replace("</b>", "")
        return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())

    got = html_extract.main_texts(pages[100:], model)
    assert sum(g == article(p) for g, p in zip(got, pages[100:])) >= 0.97 * len(got)
    page = ("<header class='site'><h1>Site</h1></header><main><h2>Big title</h2><p>First part of the text, long enough.</p>"
            "<div class='cookie-notice'>We use cookies.</div><p>Second &amp; last.</p><section class='comments'><p>Nice!</p></section></main>")
    assert html_extract.main_texts([page], model)[0].startswith("Big title First part of the text, long enough.")
    assert html_extract.main_texts(["", "<script>x", "<!-- open", "<p", "a < b"], model)[:3] == ["", "", ""]
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in html_extract.extract(odd).collect()] == [("", 0)] * 3
    assert html_extract.extract(odd.where("false")).count() == 0


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>T</title><meta charset=utf-8><body><p>One</p></body></html>", ["One"]),
    ("<head><title>T</title><p>One</p><p>Two</p>", ["One", "Two"]),
    ("<head><title>T</title>One", ["One"]),
    ("<head><noscript><link href=x></noscript><style>x</style></head><body>One", ["One"]),
    ("<div><select><option>x<p>One</p></div>", ["One"]),
    *((f"<div><{t}><p>One</p></div><p>Two</p>", ["One", "Two"]) for t in "svg iframe object noscript template".split()),
    ("<div><svg><text>x</text></svg><p>One</p></div>", ["One"]),
])
def test_html_hidden_elements_without_an_end_tag(page, want):
    assert [t for _, t, _ in html_extract.leaves(page)] == want


def test_html_main_text_in_a_plain_div(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    model = html_extract.train(pages[:100])
    for holder in ("div class='story'", "section id='post-body'", "div"):
        tag = holder.split()[0]
        other = [re.sub(r"<(/?)(article|main)\b[^>]*>", lambda m: f"</{tag}>" if m[1] else f"<{holder}>", p) for p in pages[100:]]
        want, got = html_extract.main_texts(pages[100:], model), html_extract.main_texts(other, model)
        assert sum(a == b for a, b in zip(want, got)) >= 0.9 * len(want), holder
    plain = html_extract.train([f"<div><p>Some text number {k}.</p><nav>menu</nav></div>" for k in range(40)])
    assert "Some text number 50." in html_extract.main_texts(["<div><p>Some text number 50.</p><nav>menu</nav></div>"], plain)[0]


def test_pieces_are_a_sample_without_replacement():
    v = piece_sampling.vocabulary(MODEL)
    index = {v.text[i].decode().replace(" ", "▁"): i for i in range(259, len(v.text)) if v.text[i]}

    def every(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in index:
                for rest, w in every(s[k:]):
                    yield (index[s[:k]], *rest), v.weight[index[s[:k]]] + w

    all_ = dict(every("▁then"))
    z = sum(map(math.exp, all_.values()))
    p = {k: math.exp(w) / z for k, w in all_.items()}
    n, first, either = 6000, dict.fromkeys(p, 0), dict.fromkeys(p, 0)
    for rows in piece_sampling.sample_texts(v, ["then"] * n, [7919 * k + 1 for k in range(n)], 2):
        a, b = (tuple(r[0].tolist()) for r in rows)
        assert a != b and rows[0][2] >= rows[1][2] and abs(rows[0][1] - math.log(p[a])) < 1e-9
        first[a], either[a], either[b] = first[a] + 1, either[a] + 1, either[b] + 1
    for k in p:
        both = p[k] + sum(p[a] * p[k] / (1 - p[a]) for a in p if a != k)
        assert abs(first[k] / n - p[k]) < 0.03 and abs(either[k] / n - both) < 0.03
    few = piece_sampling.sample_texts(v, ["then"], [5], 100)[0]
    assert {tuple(r[0].tolist()) for r in few} == set(p) and all(r[3] == 0 for r in few)


def test_pieces_of_long_units_and_blank_runs_are_exact():
    v = piece_sampling.vocabulary(MODEL)
    index = {v.text[i].decode().replace(" ", "▁"): i for i in range(259, len(v.text)) if v.text[i]}

    def total(s):
        mass = [0.0] + [-math.inf] * len(s)
        for k in range(1, len(s) + 1):
            mass[k] = np.logaddexp.reduce([mass[j] + v.weight[index[s[j:k]]] for j in range(max(0, k - 16), k) if s[j:k] in index] or [-math.inf])
        return mass[-1]

    long = "thenotherstation" * 19                       # 304 characters, and 65,600 below
    for text in (long, long * 216, "one    two   " + long):
        for ids, logp, _, _ in piece_sampling.sample_texts(v, [text], [3], 2)[0]:
            assert piece_sampling.decode(v, ids.tolist()) == text
            assert abs(logp - (v.weight[ids].sum() - total("▁" + text.replace(" ", "▁")))) < 1e-6 * len(text)
    crossed = 0
    for k in range(40):
        ends = np.cumsum([len(v.text[i]) for i in piece_sampling.sample_texts(v, [long], [k], 1)[0][0][0]])
        crossed += 64 not in ends
    assert crossed
    runs = {tuple(v.text[i] for i in r[0]) for r in piece_sampling.sample_texts(v, ["a    b"], [5], 100)[0]}
    assert (b" a", b"   ", b" b") in runs and (b" a", b"  ", b"  ", b"b") in runs


def test_pieces_join_the_blank_before_a_text_with_its_own():
    v = piece_sampling.vocabulary(MODEL)
    draw = lambda t: piece_sampling.sample_texts(v, [t], [5], 100, join_lead=True)[0]
    seen = {t: {tuple(v.text[i] for i in r[0]) for r in draw(t)} for t in (" ", "  ", " a", "a")}
    assert seen[" "] == {(b"  ",), (b" ", b" ")}
    assert seen["  "] == {(b"   ",), (b"  ", b" "), (b" ", b"  "), (b" ", b" ", b" ")}
    assert seen[" a"] == {(b" ", b" a"), (b"  ", b"a"), (b" ", b" ", b"a")} and seen["a"] == {(b" a",), (b" ", b"a")}
    for t in seen:
        assert abs(sum(math.exp(r[1]) for r in draw(t)) - 1) < 1e-9
        assert all(piece_sampling.decode(v, r[0].tolist()) == t for r in draw(t))


def test_query_draws_every_segmentation_of_leading_blanks(spark, tmp_path):
    spark.createDataFrame([(1, " "), (2, "   x"), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = llm.queries()["op6_piece_sampling"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 2, 2, 3] and all(r.round_trip for r in rows)


def test_pieces_hold_few_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    held, sample = [], piece_sampling.sample_texts
    monkeypatch.setattr(piece_sampling, "sample_texts", lambda v, texts, *rest: held.append(sum(map(len, texts))) or sample(v, texts, *rest))
    texts = [None, "", *["the cat é " * 15_000] * 9, "the dog " * 100_000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(12)), pa.array(range(12))], names=["text", "id", "seed"])
    rows = pa.Table.from_batches(piece_sampling._run(MODEL, 1, 1.0, True)([batch])).to_pylist()
    assert [r["doc_id"] for r in rows] == list(range(12)) and all(r["round_trip"] for r in rows)
    assert max(held[:-1]) <= 500_000 and held[-1] == len(texts[-1]) and sum(held) == sum(len(t or "") for t in texts)


def test_pieces_give_texts_back_in_any_batch():
    import sentencepiece

    v, sp = piece_sampling.vocabulary(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["", " ", "ab\n\tc  d ", "漢字 \U0001F600 zz é", " lead", "x" * 300, "the cat", "▁x ▁"]
    together = piece_sampling.sample_texts(v, texts, list(range(len(texts))))
    for k, t in enumerate(texts):
        alone = piece_sampling.sample_texts(v, [t], [k])[0]
        assert [r[0].tolist() for r in alone] == [r[0].tolist() for r in together[k]]
        for ids, *_ in alone:
            assert piece_sampling.decode(v, ids.tolist()) == t
            assert "▁" in t or sp.decode(ids.tolist()) == t


def test_warc_records_by_offset(spark, tmp_path):
    rows = [(1, "u1", "same"), (2, "u 2\r\n", "same"), (3, None, None), (4, "u4", ""), (None, "u5", "same"), (6, "u6", "é" * 300_000), (2, "u2", "same")]
    index = warc_bundles.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path))
    got = {(r.page_id, r.payload_bytes): r for r in warc_bundles.read_warc(index).collect()}
    assert got[(1, 4)].record_type == "revisit" and got[(1, 4)].refers_to == 2 and got[(None, 4)].refers_to == 2
    assert got[(2, 4)].record_type == "response" and got[(3, 0)].refers_to == 4 and got[(6, 600_000)].refers_to is None
    for r in index.collect():
        headers, payload = warc_bundles.fetch(r.path, r.frame, r.offset)
        assert headers["WARC-Record-ID"] == f"<urn:page:{'none' if r.page_id is None else r.page_id}>"
        if r.page_id == 6:
            assert payload.decode() == "é" * 300_000
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_bundles.read_warc(warc_bundles.write_warc(empty, str(tmp_path))).count() == 0
