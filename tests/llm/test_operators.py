"""The operators against brute force and worked examples, with nulls, ties, repeats, empty tables and further columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linelake.llm import chat, common, decontaminate, language, mixing, ngram_join, quality, sketch, substrings, suffixes, topk, url_rules

DOCS = "doc_id long, text string, lang string, source string, key string, n long, x int"


def frame(spark, rows):
    """(doc_id, text) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, None, "k", 1, 2) for i, t in rows], DOCS)


def prose(rng, n, words=400):
    vocabulary = ["".join(rng.choices("abdeghilmnorstu", k=rng.randint(2, 8))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) + ("." if rng.random() < 0.1 else "") for _ in range(n))


# quality


def test_quality(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(5, 200)) if i % 3 else "BUY!! NOW!! " * rng.randint(2, 60)) for i in range(400)] + [(900, None), (901, ""), (None, "x"), (0, "again")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(400)] + [(5, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 40 and all(r.predicted == int(r.doc_id % 3 > 0) for r in held if r.doc_id != 0)
    # the textbook: densities from the shrunk covariances themselves
    learned = [(np.array(quality.statistics(t)), int(i % 3 > 0)) for i, t in rows if i is not None and i < 400 and zlib.crc32(str(i).encode()) % 5]
    own = [np.array([x for x, c in learned if c == k]) for k in (0, 1)]
    spread = sum(np.var(o, axis=0) * len(o) for o in own) / len(learned) + 1e-6

    def textbook(text):
        x, density = np.array(quality.statistics(text)), []
        for o in own:
            cov, d = 0.9 * np.cov(o.T, bias=True) + 0.1 * np.diag(spread), x - o.mean(axis=0)
            density.append(np.log(len(o) / len(learned)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * d @ np.linalg.solve(cov, d))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))

    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(textbook(t))
    for r in got:
        assert min(abs(r.score - x) for x in texts[r.doc_id]) < 1e-6
    long = frame(spark, [(7, "word " * 400_000), (8, "x" * 1_000_000)])
    assert all(0 <= r.score <= 1 for r in quality.quality(long, labels).collect())
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and 200 < kept.count() < 280
    assert {r.score for r in quality.quality(docs, labels.where("false")).collect()} == {0.5}
    assert quality.quality(docs.where("false"), labels).count() == 0


# substring dedup


def brute_repeats(rows):
    """What remove_repeats says of (doc_id, text): the sentences that stay."""
    first = {}
    placed = []
    for n, (i, t) in enumerate(rows):
        for h, at, m in substrings.spans(substrings.sentences(t)):
            placed.append(((i is None, i or 0, n), at, m, h))
    for where, at, m, h in sorted(placed):
        first.setdefault(h, (where, at))
    out = []
    for n, (i, t) in enumerate(rows):
        parts = substrings.sentences(t)
        gone = {j for where, at, m, h in placed if where[2] == n and (where, at) > first[h] for j in range(at, at + m)}
        out.append((i, None if t is None else "".join(p for j, p in enumerate(parts) if j not in gone), len(gone)))
    return out


def test_spans():
    parts = substrings.sentences("One two three four five. Six.\nSeven eight nine ten eleven! Twelve?")
    assert "".join(parts) == "One two three four five. Six.\nSeven eight nine ten eleven! Twelve?" and len(parts) == 4
    assert [(a, n) for _, a, n in substrings.spans(parts, words=8)] == [(0, 3), (0, 4)]
    assert list(substrings.spans([])) == list(substrings.spans(parts)) == list(substrings.spans(["word " * 50])) == []


def test_substrings(spark):
    rng = random.Random(2)
    shared = prose(rng, 60)
    rows = [(i, prose(rng, 30) + ". " + (shared + " " if i % 3 == 0 else "") + prose(rng, 30)) for i in range(30)]
    rows += [(40, rows[4][1]), (41, None), (42, ""), (None, rows[5][1]), (43, "Short."), (44, "Short."), (45, shared + " " + shared)]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in substrings.remove_repeats(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(brute_repeats(rows), key=repr)
    assert next(t for i, t, _ in got if i == 40) == "" and sum(n for *_, n in got) > 30
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    long = " ".join(prose(rng, 12) + "." for _ in range(9000))
    huge = {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame(spark, [(1, long), (2, "Begin. " + long)])).collect()}
    assert huge[1] == 0 and huge[2] >= 9000
    same = substrings.remove_repeats(frame(spark, [(1, shared), (1, shared)])).collect()
    assert [r.text for r in same] == [shared, shared]


def test_substrings_combine_equal_spans():
    """Equal spans of some rows are one row, with all their places."""
    text = "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty."
    rows = substrings.pd.DataFrame({"doc_id": range(200), "key": 5, "text": text})
    found = substrings.pd.concat(substrings._spans(2, 20)(iter([rows, rows[:1]])))
    assert found["doc_id"].tolist() == [0, 0] and found["more"].iloc[1] is None
    assert [x["doc_id"] for x in found["more"].iloc[0]] == list(range(1, 200))


def test_substrings_join_places_in_a_text(spark):
    """A line that fills a text is two places of one span, at any length; what is removed is the same."""
    line, other = "One two three four five six seven eight nine ten eleven.\n", "Twelve thirteen fourteen. Fifteen sixteen. Seventeen eighteen.\n"
    texts = [other + line * 300, line * 200 + other * 2 + line * 50 + "End. " + line, line * 3, line * 2, (line + other) * 40, "Begin. " + (other + line) * 7]
    rows = list(enumerate([*texts, *reversed(texts)])) + [(3, texts[3]), (None, texts[0])]
    some = substrings.pd.DataFrame({"doc_id": [0, 1], "key": [5, 6], "text": [line * 300, line * 200 + other + line * 2]})
    found = substrings.pd.concat(substrings._spans(2, 20)(iter([some])))
    frequent = found[found["more"].notna()].iloc[0]
    assert (frequent["doc_id"], frequent["at"], frequent["n"]) == (0, 0, 2)
    assert [tuple(x.values()) for x in frequent["more"]] == [(0, 5, 1, 299), (1, 6, 0, 2), (1, 6, 1, 199), (1, 6, 203, 2)]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in substrings.remove_repeats(frame(spark, rows)).collect()), key=repr)
    unique = dict.fromkeys(rows)  # rows of equal id and text end alike
    want = {(i, t): x for (i, t), x in zip(unique, brute_repeats(list(unique)))}
    assert got == sorted((want[row] for row in rows), key=repr)


def brute_all_runs(rows, least=2, words=20):
    """The sentences that stay, by every run of at least ``least`` sentences and ``words`` words."""
    first, placed = {}, []
    for n, (i, t) in enumerate(rows):
        norm = [" ".join(p.lower().split()) for p in substrings.sentences(t)]
        every = [(a, b) for a in range(len(norm)) for b in range(a + least, len(norm) + 1) if sum(len(x.split()) for x in norm[a:b]) >= words]
        for a, b in every:
            placed.append((n, a, b, tuple(norm[a:b])))
    for n, a, b, run in placed:
        first.setdefault(run, (n, a))
    out = []
    for n, (i, t) in enumerate(rows):
        gone = {j for m, a, b, run in placed if m == n and (n, a) > first[run] for j in range(a, b)}
        out.append((i, "".join(p for j, p in enumerate(substrings.sentences(t)) if j not in gone), len(gone)))
    return out


def test_substrings_all_runs(spark):
    rng = random.Random(22)
    sentence = lambda n: " ".join("".join(rng.choices("abdeghilmnorstu", k=6)) for _ in range(n)) + ". "
    passage = "".join(sentence(n) for n in (16, 54, 13, 16, 9, 5, 2))
    rows = [(i, sentence(12) + passage + sentence(11)) for i in range(2)]
    for i in range(2, 40):
        short = "".join(sentence(rng.choice([1, 1, 2, 3, 5, 9])) for _ in range(rng.randint(2, 8))) + rng.choice(["", "\n\n"])
        rows.append((i, sentence(rng.randint(1, 9)) + short + sentence(rng.randint(1, 9)) + rng.choice(rows)[1] + sentence(2)))
    rows = [(i, t[:4000]) for i, t in rows]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in substrings.remove_repeats(frame(spark, rows)).collect())
    assert next(n for i, _, n in got if i == 1) == 7
    assert got == brute_all_runs(rows)


# url rules


def test_rules(spark):
    urls = {
        1: "HTTP://A.Example.COM/en/1", 2: "http://example.com/en/7x", 3: "https://x.net/de/1#/z", 4: "http://a.example.net/de/8?q=1", 5: "http://q.org/es/", 6: "http://q.org/fr/es/",
        7: None, 8: "nothing", 9: "http://host", 10: "a://b://c/d", 11: "http://notexample.com/fr/", 12: "http://com/en/",
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in urls.items()], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, labels).collect()}
    assert got[1] == ("a.example.com", "/en/1", "com/en/", "block") and got[2] == ("example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[3] == ("x.net", "/de/1", "net/de/", "allow") and got[4] == ("a.example.net", "/de/8", "example.net/de/8", "block")
    assert got[5][2:] == ("org/es/", "block") and got[6] == ("q.org", "/fr/es/", None, "allow") and got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("host", "", None, "allow") and got[10][:2] == ("b:", "//c/d") and got[11][3] == "allow" and got[12][3] == "block"


def test_mined_rules(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        bad = i % 4 == 0
        host = f"{'casino' if bad or i % 7 == 0 else 'news'}-{rng.choice('abc')}.{'win' if bad else 'site'}.io"
        rows.append((i, f"http://{host}/x/{i}?{'pay' if bad else 'id'}=1"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labels, rules=()).collect()}
    # brute force: each subset of each url's tokens, of up to three; larger ones of the same urls imply no more here
    found = pages.select("page_id", url_rules.url_tokens(F.col("url"), url_rules.host(F.col("url")), url_rules.path(F.col("url"))).alias("t")).collect()
    n, hits = {}, {}
    for r in found:
        for k in range(1, 4):
            for c in itertools.combinations(sorted(r.t), k):
                n[c] = n.get(c, 0) + 1
                hits[c] = hits.get(c, 0) + (r.page_id % 4 == 0)
    good = {c for c in n if hits[c] >= url_rules.LEAST and hits[c] / n[c] >= 0.5 and hits[c] >= 0.001 * 300}
    want = {r.page_id: "block" if any(c in good for k in range(1, 4) for c in itertools.combinations(sorted(r.t), k)) else "allow" for r in found}
    assert got == want and set(want.values()) == {"allow", "block"}


def test_rules_of_long_queries(spark):
    """Copies of a url with 30 keys would have 2 ** 30 combinations; equal tokens, repeated pages and odd urls too."""
    query = "&".join(f"k{j}=v{j}" for j in range(30))
    rows = [(i, f"http://a.example.io/x?{query}") for i in range(60)] + [(100 + i, f"http://b{i}.example.io/") for i in range(60)]
    rows += [(500, "http://a.example.io/x?" + "a=b&" * 50_000), (501, ""), (502, None), (503, "http://"), (3, f"http://a.example.io/x?{query}")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, tokens string")
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages, labels).collect()
    assert len(got) == len(rows) and {r.page_id for r in got if r.verdict == "block"} == {*range(60), 500}
    assert url_rules.judge(pages.where("false"), labels).count() == 0


def test_rules_of_tokens_that_tell_nothing_alone(spark):
    """Ten tokens tell more than the two that only together make a rule; a url with one of two tokens that always go together fits, too."""
    rng, rows = random.Random(5), []
    for i in range(400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        bad = a != b and rng.random() < 0.65
        keys = [f"{'' if a else 'n'}aa", f"{'' if b else 'n'}bb", f"{'' if b else 'n'}cc"] + [f"g{j}" for j in range(10) if not bad or i % 10 != j]
        rows.append((i, "http://a.io/x?" + "&".join(f"{k}={i:03d}" for k in keys), bad, a != b))
    rows += [(1000, "http://a.io/x?aa=1&nbb=1", None, True), (1001, "http://a.io/x?aa=1&ncc=1", None, True), (1002, "http://a.io/x?aa=1&cc=1", None, False)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], int(not r[2]), 0) for r in rows if r[2] is not None], "doc_id long, quality int, toxic int")
    # a support at which only the pair is frequent enough among the bad
    got = {r.page_id: r.verdict == "block" for r in url_rules.judge(pages, labels, rules=(), support=0.1).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_url_tokens(spark):
    url = "https://WWW.free-bets.Example.com/en/casino-win/77/cheap_pills.html?q=free-bets&page=2&ref#top"
    u = F.col("u")
    got = spark.createDataFrame([(url,)], "u string").select(url_rules.url_tokens(u, url_rules.host(u), url_rules.path(u)).alias("t"), url_rules.document_of(F.lit("http://x.y/de/12.html?z")).alias("d")).first()
    assert {"word free", "word bets", "top com", "folder en", "folder casino-win", "file cheap", "file pills", "ending html", "key q", "pair q=free-bets", "key page", "key ref", "scheme https"} <= set(got.t)
    assert not any(re.search(r"77|page=2", t) for t in got.t) and got.d == 12


# decontamination


def brute_hits(text, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, whose = words(text), set(), set()
    for i, t in items:
        b = words(t)
        for win in {tuple(b[a : a + size]) for a in range(max(1, len(b) - size + 1))} if b else ():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    whose.add(str(i))
    return len(w), len(hit), sorted(whose)


def test_decontaminate(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(8, 30), 40)) for i in range(12)] + [(50, "Two words"), (51, ""), (52, None), (53, items_text := prose(rng, 12)), (None, items_text)]
    rows = [(i, prose(rng, 80, 40)) for i in range(10)]
    rows += [(20 + i, prose(rng, 20) + ", " + (items[i][1] or "").upper() + " -- " + prose(rng, 9)) for i in range(16)] + [(60, None), (61, ""), (62, "two-words! two"), (62, "two-words! two"), (None, items_text)]
    # clean rows that share their id, or the lack of one, with bad ones
    rows += [(None, prose(rng, 30, 40)), (None, prose(rng, 30, 40)), (None, None), (21, prose(rng, 30, 40)), (53, items_text), (22, "x " * 200_000 + items_text), (63, "only")]
    table = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(frame(spark, rows), table).collect()), key=repr)
    want = []
    for i, t in rows:
        n, hit, whose = brute_hits(t, items)
        want.append((i, n, hit, len([x for x in whose if x != "None"])))
    assert got == sorted(want, key=repr) and sum(x[2] for x in want) > 100
    kept = decontaminate.decontaminate(frame(spark, rows), table)
    assert kept.columns == frame(spark, []).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((i, t) for i, t in rows if not brute_hits(t, items)[1]), key=repr)
    assert decontaminate.contamination(frame(spark, []), table).count() == 0
    assert decontaminate.contamination(frame(spark, rows[:3]), table.where("false")).where("contaminated").count() == 0


# chat


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|x"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, None, None, None), (2, 0, "system", "alone"), (None, 1, "ann", "lost")]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, block int")
    got = {(r.conv_id, r.participant): r for r in chat.perspectives(turns).where("block is not null").collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "(none)"), (None, "ann")}
    r = got[1, "ann"]
    assert r.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |x<|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n" and r.n_turns == 3
    assert [r.text[s.start : s.end] for s in r["mask"]] == ["hi < |x<|im_end|>\n"] and got[1, "(none)"]["mask"] == []
    long = spark.createDataFrame([(7, i // 40, "abc"[i % 3], f"t{i:03}") for i in range(400)], "conv_id long, turn long, role string, text string")
    parts = chat.perspectives(long, block=4, crowded=50).where("participant = 'a'").collect()
    assert len(parts) > 5 and sum(p.n_turns for p in parts) == 400 and sum(len(p["mask"]) for p in parts) == 134
    assert chat.perspectives(long.where("false")).count() == 0


def test_chat_crowded(spark, tmp_path):
    rng = random.Random(41)
    rows = [(7, rng.choice([None, *range(5)]), rng.choice(["ann", "bob", "system"]), f"t{rng.randrange(10**6)} é") for _ in range(2600)]
    rows += [(7, 3, "ann", f"same turn {i}") for i in range(2300)] + [(8, 0, "ann", "hi"), (8, 70, "bob", "yo")]
    rows += [(None, 1, "cy", f"n{i}") for i in range(1100)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for conv, turn, role, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])):
        for who in {r[2] for r in rows if r[0] == conv} - {"system"} if conv != 7 else ("ann", "bob"):
            n, t, mask = want.get((conv, who, None if turn is None else turn // 64), (0, "", []))
            head = "<|im_start|>" + ("system" if role == "system" else "assistant" if role == who else f"user name={role}") + "\n"
            body = text + "<|im_end|>\n"
            mask = mask + [f"{len(t + head)}-{len(t + head + body)}"] if role == who else mask
            want[conv, who, None if turn is None else turn // 64] = (n + 1, t + head + body, mask)
    got = {(r.conv_id, r.participant, r.block): (r.n_turns, r.text, r["mask"]) for r in chat.op5_chat(spark, str(tmp_path)).collect()}
    assert got == {k: (n, t, ",".join(mask)) for k, (n, t, mask) in want.items()} and len(got) == 9
    parts = chat.perspectives(spark.read.parquet(f"{tmp_path}/conversations.parquet"), crowded=100).where("conv_id = 7 and participant = 'ann' and block = 0").orderBy("part").collect()
    assert "".join(p.text for p in parts) == want[7, "ann", 0][1] and [p.n_turns for p in parts[:-1]] == [100] * (len(parts) - 1)


# n-gram join


def brute_components(rows, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= percent * len(sets[a] | sets[b]) or rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]:
            root[find(a)] = find(b)
    low = {}
    for n, (i, _) in enumerate(rows):
        if sets[n] and i is not None:
            low[find(n)] = min(low.get(find(n), i), i)
    return sorted(((i, len(s), low.get(find(n)) if s else i) for n, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        words = prose(rng, rng.choice([4, 8, 40, 120])).split()
        for _ in range(rng.randint(1, 8)):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "other", "thing"])
            rows.append((len(rows) * 3 % 101, " ".join(copy)))
    common = prose(rng, 100)
    rows += [(200 + i, common + " " + prose(rng, 12 + i)) for i in range(12)] + [(300, None), (301, ""), (302, "a b c"), (303, "A\tb  c"), (None, "a b c"), (300, "x y")]
    options = {} if seed == 1 else {"sig_bits": 3, "stars": 1}  # sets that share their hash; almost all pairs in the last round
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows), **options).collect()), key=repr)
    assert got == brute_components(rows)


def test_ngram_join_shared_passages(spark, monkeypatch):
    """Documents of shared passages, none alike: lists are long, but the pairs whose sets are compared stay in proportion to the documents."""
    rng = random.Random(12)
    passages = [prose(rng, 70) for _ in range(40)]
    compared, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *rest: (compared.append(pairs.count()), verified(pairs, *rest))[1])
    for n in (200, 400):
        rows = [(i, " ".join(passages[j] for j in rng.sample(range(40), 4))) for i in range(n)]
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()), key=repr)
        assert got == brute_components(rows)
        compared.append(-n)
    first, second = sum(x for x in compared[: compared.index(-200)]), sum(x for x in compared[compared.index(-200) + 1 : -1])
    assert second < 3 * first and sum(compared[compared.index(-200) + 4 : -1]) < 40


def test_ngram_join_keeps_one(spark):
    docs = frame(spark, [(3, "a b c d e f"), (1, "a b c d e f"), (2, "q r s"), (None, "q r s"), (4, "")])
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["1", "2", "4", "None"]
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0


# top-k


def test_topk(spark):
    rng = np.random.default_rng(7)
    x = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(3000)]
    x[10] = (10, x[20][1])
    x += [(5000, None), (5001, [None] * 8), (5002, [float("nan")] * 8), (5003, []), (5100, []), (None, [1.0] * 8), (5004, [1.0] * 3), (5005, [2.0] * 3), (5050, [0.0] * 8)]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in x], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0 or vec_id = 5004")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    sound = {i: [int(np.floor(256 * c)) for c in v] for i, v in x if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    for q in [i for i in sound if i % 50 == 0 or i == 5004]:
        best = sorted((-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))[:5]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert len(got) == 63 and got[5100] == [(1, 5003, 0)] and topk.top_k(vectors.where("false"), vectors).count() == 0


# language


def test_automaton():
    rng = random.Random(8)
    text = [rng.randrange(3) for _ in range(200)]
    moves = language.suffix_automaton(text, 3)
    known = {tuple(text[a:b]) for a in range(200) for b in range(a + 1, min(200, a + 8) + 1)}
    for n in range(1, 8):
        for word in itertools.product(range(3), repeat=n) if n < 6 else [tuple(text[5 : 5 + n])]:
            s = 0
            for c in word:
                s = moves[s, c] if s >= 0 else -1
            assert (s >= 0) == (word in known)


def test_language(spark):
    rng = random.Random(9)
    sounds = {"xx": "abcde fgh", "yy": "nopqr stu"}
    rows = [(i, " ".join("".join(rng.choices(sounds["xx" if i % 2 else "yy"], k=5)) for _ in range(30)), "xx" if i % 2 else "yy") for i in range(200)]
    rows += [(500, None, "xx"), (501, "12 34!", "xx"), (502, "", None), (503, "aBcDe fgh", None), (None, "nopqr", "yy")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.languages(docs).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in rows[:200])
    assert got[500].lang_pred == got[501].lang_pred == got[502].lang_pred == "und" and got[503].lang_pred == "xx" and got[None].lang_pred == "yy"
    # greedy longest phrases, from the raw texts
    letters = lambda t: re.sub(" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in t))
    learned = docs.where("lang is not null and text is not null").where("doc_id is null or crc32(cast(doc_id as string)) % 5 != 0").select("doc_id", "text", "lang")
    samples = {k: letters(t) for k, t in language._samples(learned, language.SAMPLE, language.PIECE).items()}
    for i, t, _ in [r for r in rows if r[0] in (1, 2, 7, 130, 503)]:
        cost = {}
        for k, sample in samples.items():
            count, open_phrase = 1, ""
            for c in letters(t):
                if open_phrase + c in sample:
                    open_phrase += c
                else:
                    count, open_phrase = count + 1, c if c in sample else ""
            cost[k] = count * np.log2(len(sample))
        best = min(cost, key=cost.get)
        assert got[i].lang_pred == best and abs(got[i].score - 1 / cost[best] / sum(1 / x for x in cost.values())) < 1e-9
    long = spark.createDataFrame([(900, "abcde fgh " * 100_000, None, 1.0), (900, "abcde fgh " * 100_000, None, 1.0)], docs.schema)
    assert [r.lang_pred for r in language.languages(docs.unionByName(long)).where("doc_id = 900").collect()] == ["xx", "xx"]
    assert language.languages(docs.where("false")).count() == 0
    assert {r.lang_pred for r in language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    model = language.fit(docs.select("doc_id", "text", "lang").where("lang is not null and text is not null"))
    text, parsed = rows[3][1], model.letters(rows[3][1])
    for k in range(2):
        s, count = int(model.starts[k]), 1
        for c in parsed:
            move = int(model.parser[s + int(c)])
            count, s = count + (move & 1), move >> 1
        assert model.phrases([parsed])[k, 0] == count, text


def test_language_letters(spark):
    rng = random.Random(31)
    han, hangul = [chr(0x4E00 + i) for i in range(2000)], [chr(0xAC00 + i) for i in range(600)]
    tongues = {"zh": han, "ko1": hangul[:300], "ko2": hangul[300:]}
    words = {lang: ["".join(rng.choices(letters, k=4)) for _ in range(300)] for lang, letters in tongues.items()}
    rows = []
    for i in range(240):
        lang = list(tongues)[i % 3]
        rows.append((i, "COMMON HEADER " * 80 + " ".join(rng.choices(words[lang], k=1000)), lang))
    # many languages of short texts, each of letters of its own
    rows += [(1000 + 20 * k + j, "".join(rng.choices([chr(0x1400 + 8 * k + x) for x in range(8)], k=9)), f"l{k:02}") for k in range(75) for j in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.names) == 78 and model.width > 600
    for k in (model.names.index("ko1"), model.names.index("l33")):
        for text in (rows[1][1][1200:1800], rows[0][1][1000:1300], rows[-3][1]):
            s, count, parsed = int(model.starts[k]), 1, model.letters(text)
            for c in parsed:
                move = int(model.parser[s + int(c)])
                count, s = count + (move & 1), move >> 1
            assert model.phrases([parsed])[k, 0] == count
    texts = language._samples(docs, 20_000, 1_000)
    assert len(texts["ko1"]) == 20_000 and texts["ko1"].count("HEADER") < 600 and len(texts["l33"]) == 20 * 10
    probe = [(i, " ".join(rng.choices(words[lang], k=40)), None) for i, lang in enumerate(tongues)]
    probe += [(3, rows[-1][1], None), (4, rows[240][1], None)]
    got = dict(enumerate(p for p, _ in model.predict([t for _, t, _ in probe])))
    assert got == {0: "zh", 1: "ko1", 2: "ko2", 3: "l74", 4: "l00"}


def test_transitions():
    rng = random.Random(5)
    texts = [[rng.randrange(2, 40 if k else 900) for _ in range(1500)] for k in range(3)]
    automata = [language._automaton(t) for t in texts]
    moves, starts = language._transitions(automata, 902)
    base = np.cumsum([0] + [len(a) for a in automata])
    for k, a in enumerate(automata):
        for s in range(0, len(a), 7):
            got = moves[((int(base[k]) + s) << moves.shift) + np.arange(902)]
            want = [2 * ((int(base[k]) + a[s].get(c, a[0].get(c, 0))) << moves.shift) + (c not in a[s]) for c in range(902)]
            assert got.tolist() == want


# mixing


def test_water_fill():
    assert mixing.water_fill(10, [1, 1], [100, 100]) == [5, 5] and mixing.water_fill(10, [1, 1, 2], [1, 100, 100]) == [1, 3, 6]
    assert mixing.water_fill(10, [1, 1], [2, 3]) == [2, 3] and mixing.water_fill(7, [1, 1, 1], [9, 9, 9]) == [3, 2, 2] and mixing.water_fill(5, [0, 1], [9, 9]) == [0, 5]


def test_mixing(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s10", "s2", None])) for i in range(300)] + [(400, None, "en", "s1"), (401, " ", "en", "s1"), (7, "one two", "en", "s1"), (7, "one two", "en", "s1")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, lang string, source string, epoch int")
    target = {"domain": {"s": 1.0, "s1": 5.0}, "lang": {"en": 3.0}, "source": {}}
    got = mixing.selection(docs, target=target, share=0.6, epochs=3, seed=5).collect()
    size = {}
    leaf_of = lambda lang, source: (re.sub(r"\d$", "", source) if source else "(none)", lang or "(none)", source or "(none)")
    for i, t, lang, source in rows:
        size[leaf_of(lang, source)] = size.get(leaf_of(lang, source), 0) + len((t or "").split())
    budget = {(): int(0.6 * sum(size.values()))}
    for level in range(3):
        for above in [k for k in budget if len(k) == level]:
            names = sorted({leaf[level] for leaf in size if leaf[:level] == above})
            room = [3 * sum(n for leaf, n in size.items() if leaf[: level + 1] == (*above, x)) for x in names]
            for x, n in zip(names, mixing.water_fill(budget[above], [target[mixing.LEVELS[level]].get(x, 1.0) for x in names], room)):
                budget[*above, x] = n
    taken = {}
    for r in got:
        taken[r.domain, r.lang, r.source] = taken.get((r.domain, r.lang, r.source), 0) + r.n_taken
    assert taken == {k: v for k, v in budget.items() if len(k) == 3 and v} and all(0 < r.n_taken <= r.n_tokens for r in got)
    assert all(sum(r.n_taken < r.n_tokens for r in got if (r.domain, r.lang, r.source) == leaf) <= 1 for leaf in taken) and max(r.epoch for r in got) >= 1
    # which documents: whole passes, then a prefix of the order drawn from seed and epoch
    sizes = docs.select("doc_id", F.xxhash64("text").alias("key"), "lang", "source", mixing.tokens(F.col("text")).alias("n")).where("n > 0").collect()
    want = []
    for leaf in taken:
        own = [r for r in sizes if leaf_of(r.lang, r.source) == leaf]
        full, rest = divmod(budget[leaf], sum(r.n for r in own))
        want += [(r.doc_id, r.key, *leaf, e, r.n, r.n) for r in own for e in range(full)]
        drawn = spark.createDataFrame([(r.doc_id, r.key, r.n) for r in own], "doc_id long, key long, n long").withColumn("o", F.xxhash64(F.lit(5), F.lit(full), "doc_id", "key")).collect()
        for r in sorted(drawn, key=lambda r: (r.o % 2**64, r.doc_id, r.key)):
            if rest > 0:
                want.append((r.doc_id, r.key, *leaf, full, r.n, min(r.n, rest)))
            rest -= r.n
    assert sorted((r.doc_id, r.key, r.domain, r.lang, r.source, r.epoch, r.n_tokens, r.n_taken) for r in got) == sorted(want)
    texts = mixing.mixture(docs, target=target, share=0.6, epochs=3, seed=5).collect()
    words = {(i, w) for i, t, *_ in rows for w in [tuple((t or "").split())]}
    assert all(any(i == r.doc_id and w[: r.n_taken] == tuple(r.text.split()) for i, w in words) for r in texts)
    assert sum(len(r.text.split()) for r in texts) == sum(r.n_taken for r in got)
    assert mixing.selection(docs.where("false")).count() == 0 and mixing.mixture(docs.where("false")).count() == 0
    odd = spark.createDataFrame([(None, "a b c d", None, None, 1), (1, "x " * 300_000, "en", "s1", 1), (1, "", "en", "s1", 1)], docs.schema)
    assert sum(r.n_taken for r in mixing.selection(odd, epochs=1).collect()) == 150_002


# suffixes


@pytest.mark.parametrize(("seed", "name_bits"), [(1, 64), (2, 64), (1, 6)])
def test_suffixes(spark, seed, name_bits):
    """Also with names so short that most of them are those of several strings."""
    rng = random.Random(seed)
    alphabet = "ab" if seed == 2 else "abcdefg é\n"
    text = lambda n: "".join(rng.choices(alphabet, k=n))
    shared = [text(n) for n in (49, 50, 51, 80, 300)]
    rows = [(i, text(rng.randint(0, 200)) + rng.choice(shared) + text(rng.randint(0, 120)) + rng.choice(shared)) for i in rng.sample(range(1000), 30)]
    rows += [(2000, rows[0][1]), (2001, None), (2002, ""), (2003, "x" * 400), (2004, "x" * 60), (None, rows[1][1]), (None, rows[1][1]), (rows[2][0], rows[3][1])]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove_substrings(frame(spark, rows), name_bits).collect()), key=repr)
    least = {}
    data = [(1 << 63 if i is None else i, i, (t or "").encode()) for i, t in rows]
    for order, _, b in data:
        for a in range(len(b) - 49):
            least[b[a : a + 50]] = min(least.get(b[a : a + 50], order), order)
    want = []
    for order, i, b in data:
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if least[b[a : a + 50]] < order:
                gone[a : a + 50] = b"\1" * 50
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    assert got == sorted(want, key=repr) and sum(w[2] for w in want) > 1000
    assert suffixes.remove_substrings(frame(spark, [])).count() == 0


def test_suffixes_frequent_part(spark, monkeypatch):
    """A line shorter than a string, in all documents with other text around it, and a long one that is the same in all."""
    monkeypatch.setattr(suffixes, "GROUP", 500)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdefgh", k=n))
    line, same = text(40), text(70)
    rows = [(i, text(60) + line + text(60) + same + text(5)) for i in range(400)]
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in suffixes.remove_substrings(frame(spark, rows)).collect()}
    least = {}
    for i, t in rows:
        for a in range(len(t) - 49):
            least.setdefault(t[a : a + 50], i)
    for i, t in rows:
        gone = {b for a in range(len(t) - 49) if least[t[a : a + 50]] < i for b in range(a, a + 50)}
        assert got[i][0] == len(gone) and got[i][2] == "".join(c for b, c in enumerate(t) if b not in gone)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.sparkContext.broadcast(suffixes.frequency_maps(docs, suffixes.part_sets, map_bits=suffixes.MAP_BITS)[1])
    batches = [suffixes.pd.DataFrame([(i, i * 7919, 60 - 20, t[40:120].encode()) for i, t in rows[k : k + 50]], columns=["doc_id", "key", "at", "data"]) for k in range(0, 400, 50)]
    names, total = [], 0
    for turn in range(suffixes.ROUNDS):
        found = suffixes.pd.concat(suffixes._packed(turn, 8, often)(iter(batches)))
        names.append(found.groupby("bucket")["names"].agg(lambda x: sum(map(len, x)) // 8))
        total += int(names[-1].sum())
    assert total == 400 * 31 and max(n.max() for n in names) < total / 6


def test_suffixes_forget_shuffles(spark, monkeypatch):
    """From the second round on, none begins with the shuffle files of the counts or of another round."""
    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    seen, write = [], suffixes.staged
    monkeypatch.setattr(suffixes, "staged", lambda df, label, *a: (seen.append(kept()), write(df, label, *a))[1])
    common.forget_shuffles(spark)
    before = kept()
    assert suffixes.remove_substrings(frame(spark, [(i, "the same text of more than fifty bytes in each of them") for i in range(20)])).count() == 20
    assert len(seen) == 1 + suffixes.ROUNDS and max(seen[2:]) <= before


def test_suffixes_rows_of_batches(spark):
    """Small batches send a row to each bucket together, not each of them; a frequent part's names are spread over the rounds, too."""
    rng = random.Random(9)
    rows = [(i, i * 7919, 0, "".join(rng.choices("abcdefgh", k=80)).encode()) for i in range(600)]
    batches = [suffixes.pd.DataFrame(rows[k : k + 10], columns=["doc_id", "key", "at", "data"]) for k in range(0, 600, 10)]
    for bitmap, least in ((bytearray(1 << 21), 1), (bytearray(b"\xff" * (1 << 21)), 1500)):
        often = spark.sparkContext.broadcast(bitmap)
        found = [suffixes.pd.concat(suffixes._packed(turn, 8, often)(iter(batches))) for turn in range(suffixes.ROUNDS)]
        names = [x["names"].map(len).sum() // 8 for x in found]
        assert all(len(x) <= 8 for x in found) and sum(names) == 600 * 31 and min(names) >= least


def test_suffixes_whole_copies(spark, monkeypatch):
    """Texts that have a smaller id go, and none of their strings is dealt out; short ones and those of the same id stay."""
    rng = random.Random(4)
    long, other = ("".join(rng.choices("abcdefgh", k=n)) for n in (200, 90))
    seen, write = {}, suffixes.staged
    monkeypatch.setattr(suffixes, "staged", lambda df, label, *a: seen.setdefault(label, write(df, label, *a)) if label == "fragments" else write(df, label, *a))
    rows = [*((i, long) for i in range(3, 40)), (3, long), (None, long), (5, other), (5, other), (1, "short"), (2, "short"), (41, None), (42, "")]
    got = sorted(((r.doc_id or 99, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in suffixes.remove_substrings(frame(spark, rows)).collect()))
    assert got == sorted((i or 99, len(t or ""), *((200, 1, "") if t == long and i != 3 else (0, 0, t or ""))) for i, t in rows)
    assert seen["fragments"].where("doc_id != 3 and doc_id != 5").count() == 0


def test_suffixes_map_grows():
    """In a large map the three places of a hash are three choices: a fifth of its bits set lets through about a hundredth of the others."""
    rng = np.random.default_rng(1)
    bits = 28
    h = rng.integers(0, 1 << 58, 300_000, dtype=np.uint64)  # the first 64th of the map
    part = np.zeros(1 << (bits - 6), np.uint8)
    for i in sketch._bits(h, bits):
        part[i] = 1
    bitmap = np.packbits(part)
    assert sketch.contains(bitmap, h, bits).all()
    assert sketch.contains(bitmap, rng.integers(0, 1 << 58, 100_000, dtype=np.uint64), bits).mean() < 0.012


def test_frequency_maps_in_parts(spark, monkeypatch):
    """A large map that comes in parts is the one that comes at once, whatever is gathered before it is counted."""
    rng = random.Random(2)
    docs = frame(spark, [(i, "".join(rng.choices("abcdefgh", k=100)) + "a line that stands in all of these texts") for i in range(100)])
    want = sketch.frequency_maps(docs, suffixes.part_sets, map_bits=24, often_bits=23)
    monkeypatch.setattr(sketch, "AT_ONCE_BITS", 0)
    assert sketch.frequency_maps(docs, suffixes.part_sets, map_bits=24, often_bits=23, share=1 << 8, gathered=500) == want
    assert [len(m) for m in want] == [1 << 21, 1 << 20] and all(any(m) for m in want)


def test_suffixes_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 500)
    rng = random.Random(3)
    b = [("".join(rng.choices("abcdefgh", k=3000))).encode() for _ in range(2)]
    places = [(d, at + a) for some in suffixes.pieces([*b, b"short"]) for d, at, part in some for a in range(len(part) - 49)]
    assert sorted(places) == [(d, a) for d in range(2) for a in range(2951)]
    whole = [suffixes._least(suffixes._thrice(np.frombuffer(x, np.uint8))) for x in b]
    assert all((np.unique(w) == s).all() for w, s in zip(whole, suffixes.part_sets([x.decode() for x in b])))
