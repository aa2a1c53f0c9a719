"""Quality rules, toxicity and secrets against plain versions."""

import hashlib
import random
import re
from collections import Counter

from cohortlab.llm import quality, secrets, toxicity
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def plain_statistics(text):
    words = WORD.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    cover = set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i:i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover))


def test_statistics(spark, docs, texts):
    more = [(900, "a b c a b c\na b c a b c\n\n \nx <y> $ # $"), (901, "a a a a"), (902, "a a"), (903, "a b c d a b c")]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                 for r in quality.text_statistics(frame).collect())
    assert got == sorted((d or -1, *plain_statistics(t)) for d, t in texts + more)


def test_learned_list_finds_the_bad_rows(spark):
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        words = prose(i, 80).split()
        rows.append((i, " ".join(w + "%%" if bad and j % 2 else w for j, w in enumerate(words)), None))
        if i < 200:
            labels.append((i, 0 if bad else 1))
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    taught = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality.judge(frame, taught).collect()}
    assert all(kept == (i % 4 != 0) for i, kept in out.items())


def test_list_without_labels_keeps_what_the_base_rule_keeps(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.judge(docs, none).collect()
    assert len(out) == docs.count() and all(r.kept == (not r.base_failed) for r in out)
    assert quality.judge(nothing, none).count() == 0


def test_cover_prunes_and_orders():
    cells = [{"grow": g, "y": y, "count": n, "a": a, "b": b} for g in (True, False)
             for y, n, a, b in ((0, 40, 2, 0), (1, 60, 0, 0), (1, 50, 0, 2), (0, 20, 1, 2), (1, 1, 1, 0))]
    rules = quality.cover(cells, [(c, up, k) for c in "ab" for k in (0, 1) for up in (True, False)], 5, 0.9, 5, 3)
    assert rules and all(any(x["y"] == 0 and all((x[c] > k) == up for c, up, k in r) for x in cells) for r in rules)


def toxic_rows(n):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words, bad = prose(i, 120).split(), i % 5 == 0
        if bad:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["blorgh", "zarkit", "zarkon", "zarkas", "idiot"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows(450)
    out = toxicity.report(spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [r for r in out.collect() if r.held_out]
    assert len(held) > 100 and all(r.predicted == int(r.doc_id % 5 == 0) and 0 <= r.score <= 1 for r in held)


def test_disguised_words_and_exceptions():
    machine = toxicity.Lexicon({" idiot ": 3.0, " clown ": 2.0}, toxicity.EXCEPTIONS).automaton()
    texts = ["you idiot", "you 1D10T!", "you іdіоt", "ídiot", "idiotic", "a clown fish", "a clown", "", "!?", "clown", "idiot idiot"]
    hits, words = toxicity.sums(texts, machine)
    assert hits.tolist() == [3, 3, 3, 3, 0, 0, 2, 0, 0, 2, 6]
    # Signs alone read as letters that resemble them; other punctuation is no word.
    assert words.tolist()[:3] == [2, 2, 2] and words[7] == 0


def test_toxicity_of_odd_rows(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.report(docs, none).count() == docs.count()
    assert toxicity.filter_documents(docs, none).columns == docs.columns
    assert toxicity.report(nothing, none).count() == 0


def secret_texts():
    key = "AKIA" + "ABCDEFGH12345678"
    blob = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    return [(0, "password=hunter22 and Token : 'abc' then api_key=\"zz9999\""), (1, f"é日 {key} x"), (2, "f" * 24 + " " + "f" * 23),
            (3, "password=token:abcdef secret==abcdef"), (4, f"id {key}\nvalue {blob}\nhttps://db.example.com/x"), (5, blob), (6, "see https://a.example.com/ only"),
            (7, f"{key} " + "word " * 200 + blob), (8, f"ACCESSKEY12345678 with {blob}"), (9, "API_KEY:'deadbeefdeadbeefdeadbeef'"),
            (10, None), (11, ""), (12, f"{key}{key}"), (13, "\U0001F600 passwd = abcdefg"), (13, "\U0001F600 passwd = abcdefg")]


def test_secrets_base_and_linked(spark):
    rows = secret_texts()
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, base string")
    out = secrets.report(frame).collect()
    assert len(out) == len(rows)
    for r in out:
        text = dict(rows)[r.doc_id] or ""
        spans, n = [], []
        for k, (name, p, g, least) in enumerate(BASE):
            own = [(m.start(), k, m.end(), name) for m in p.finditer(text) if len(m[g]) >= least]
            n.append(len(own))
            spans += own
        named = [f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(spans)]
        assert [r.n_assign, r.n_access, r.n_hex] == n
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r.spans.split(",")) | {""}
    spans = {r.doc_id: r.spans for r in out}
    assert "opaque" in spans[4] and "endpoint" in spans[4]
    assert spans[5] == "" and spans[6] == "" and "opaque" not in spans[7]
    assert "key_id" in spans[8] and "opaque" in spans[8]


def test_redaction(spark, docs, nothing):
    frame = spark.createDataFrame(secret_texts(), "doc_id long, text string")
    rows = {r.doc_id: r.text for r in secrets.redact(frame).collect()}
    assert rows[0] == "[secret] and Token : 'abc' then [secret]\""
    assert rows[1] == "é日 [secret] x" and rows[5] == secret_texts()[5][1] and rows[10] is None and rows[11] == ""
    assert rows[9] == "[secret]'" and rows[13] == "\U0001F600 [secret]"
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).count() == docs.count()
    assert secrets.redact(nothing).count() == 0


def test_native_operators_run_no_python(spark, docs):
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    for out in (quality.judge(docs, labels), secrets.report(docs), secrets.redact(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
