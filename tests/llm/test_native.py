"""License scans, quality rules, decontamination, URL filters and chats on small fixtures with nulls, ties and odd texts."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from poremetry.llm import chat_quotes, decontaminate, licenses, quality_rules, queries, url_filters

DATA = "/root/testdata/sf0.001"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


LICENSED = [
    (1, None), (2, ""), (3, "CC-BY and cc by; cc\nBy. ccby cc, b"), (4, "GNU General Public License, version 3 " + "word " * 30000 + "general public license"),
    (5, "All rights reserved. all rights reserved all rights. reserved"), (6, "Released under the MIT License."), (6, "Released under the MIT License."),
    (7, "Licensed under the Apache License, Version 2.0"), (8, "license license license"), (9, "ﬀ cc by ñcc by cc byñ \U0001F600cc by"),
    (10, "This work is licensed under the GNU General Public License, version 3.")]


def test_license_scan(spark):
    docs = spark.createDataFrame([(i, t, "w", 0.5) for i, t in LICENSED], "doc_id bigint, text string, word string, weight double")
    got = licenses.scan(docs).collect()
    assert len(got) == len(LICENSED)
    rows = {r.doc_id: r for r in got}
    for i, text in LICENSED:
        words = re.findall(WORDS, ascii_low(text))
        places = sorted((k, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()]
                        for k in range(len(words)) if words[k:k + len(p)] == p)
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(words), len(places)), i
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and 0 <= r.score <= 1
    assert rows[6].labels == "mit" and rows[7].labels == "apache-2.0" and rows[10].labels == "gpl,gpl-3.0" and rows[8].labels == ""
    assert licenses.scan(docs.where("doc_id < 0")).count() == 0


def test_every_copy_of_one_notice(spark):
    for text, label in [("Released under the MIT License.", "mit"), (" ".join(licenses.TEMPLATES[11][1].split()), "isc")]:
        for n in (1, 3):
            got = licenses.scan(spark.createDataFrame([(i, text) for i in range(n)], "doc_id bigint, text string")).collect()
            assert [(r.labels, r.score) for r in got] == [(label, 1.0)] * n


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(None, "en", "s"), ("", "en", "s"), (" \n\t ", None, None), ("a b c a b c\n\na b c a b c\n", "en", None), ("x " * 300, "en", "s"),
            ("a a a a b a a a", "fr", "s"), (prose(5000), "en", "s"), ("## || <>%\U0001F600 é\u00a0b", "en", "s")]
    rows += [(prose(80) + "\nsame line\n" + prose(20) + "\nsame line", "en", "s") for _ in range(20)] + [("!!## " + " ".join(["AB***"] * 3) + prose(90).upper(), "en", "s")]
    docs = spark.createDataFrame([(i, *r, 9) for i, r in enumerate([*rows, rows[-1]])], "doc_id bigint, text string, lang string, source string, n_words int")
    got = sorted(quality_rules.judge(docs).collect())
    for (text, *_), r in zip([*rows, rows[-1]], got):
        assert tuple(r)[1:7] == brute_rules(text), r
    assert all(r.kept for r in got[8:28]) and got[6].kept and not got[28].kept and not any(r.kept for r in got[:6])
    assert quality_rules.judge(docs.where("doc_id < 0")).count() == 0


def test_adaptive_limits_decide(spark):
    """One text is kept in a source where it is ordinary and goes in one where it stands out; no cutoff is fixed and no number of documents switches."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(3, 8)))
    plain = lambda n=80: " ".join(word() for _ in range(n))
    marked = lambda share: " ".join(word() + ("#" if k % share == 0 else "") for k in range(90))
    text = marked(3)
    for n in (99, 100, 101, 400):
        rows = [(k, plain(), "en", "prose") for k in range(n)] + [(1000 + k, marked(rng.randrange(2, 9)), "en", "code") for k in range(n // 9)]
        rows += [(5000, text, "en", "prose"), (5001, text, "en", "code"), (5002, plain() + " # #", "en", "prose")]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
        kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
        assert not kept[5000] and kept[5001] and kept[5002], n
        assert sum(kept[k] for k in range(n)) == n and sum(kept[1000 + k] for k in range(n // 9)) == n // 9


def test_decontamination(spark):
    rng = random.Random(2)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [(k, make(n)) for k, n in enumerate([1, 3, 5, 9, 30, 31, 70, 200])]
    texts = [(100 + k, " ".join(make(3000) + w + make(2000)).upper()) for k, w in items]
    for k, w in items[3:]:
        for cut in range(0, len(w), max(1, len(w) // 12)):
            texts.append((1000 * k + cut, " ".join(make(40) + w[cut:] + make(9))))
    texts += [(1, None), (2, ""), (3, "..."), (4, "same"), texts[5]]
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id bigint, text string, item_id int")
    tests = spark.createDataFrame([(k, ", ".join(w), "x") for k, w in items] + [(50, None, "x"), (51, "!", "x")], "item_id int, text string, shingle string")
    want = set()
    for i, t in texts:
        words = re.findall(WORDS, (t or "").lower())
        for k, w in items:
            n = min(5, len(w))
            grams = {tuple(w[p:p + n]) for p in range(len(w) - n + 1)}
            held = {tuple(words[p:p + n]) for p in range(len(words) - n + 1)}
            if 100 * len(grams & held) >= 80 * len(grams):
                want.add((i, k, len(grams), len(grams & held)))
    got = decontaminate.find(docs, tests).collect()
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
    left = {r.doc_id for r in decontaminate.drop_contaminated(docs, tests).collect()}
    assert left == {i for i, _ in texts} - {w[0] for w in want if len(items[w[1]][1]) >= 5}
    assert decontaminate.find(docs, tests.where("item_id < 0")).count() == 0 and decontaminate.find(docs.where("doc_id < 0"), tests).count() == 0


def test_short_items_drop_nothing(spark):
    """Items of fewer than five words are reported, but nothing goes for them; helper columns never clash."""
    docs = spark.createDataFrame([(1, "yes we can do it", 7, 8), (2, "a b c d e f", 7, 8)], "doc_id bigint, text string, _leak int, _n int")
    items = spark.createDataFrame([(1, "Yes"), (2, "A b c d e")], "item_id int, text string")
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, "yes we can do it", 7, 8)]
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()} == {(1, 1), (2, 2)}


def test_texts_are_decontaminated_one_by_one(spark):
    item = [f"i{k}" for k in range(30)]
    leak, half, rest = " ".join(["x", *item, "y"]), " ".join(item[:17]), " ".join(item[13:])
    rows = [(None, leak), (None, "a clean text"), (9, leak), (9, "another clean text"), (5, half), (5, rest), (None, None), (None, leak)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, place int")
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")
    assert sorted(r.place for r in decontaminate.drop_contaminated(docs, tests).collect()) == [1, 3, 4, 5, 6]
    assert {(r.doc_id, r.item_id, r.n_common) for r in decontaminate.find(docs, tests).collect()} == {(None, 1, 26), (9, 1, 26), (5, 1, 26)}


URLS = ["https://www.Example.com/en/x?y", "http://example.com/en/", "http://notexample.com/en/", "http://a.net/es/1", "http://net/fr/", "http://x.com", "http://x.com/",
        "x.com/en/", None, "", "://", "a://b://c/d", "http://ads-track.example.org/q", "http://h.org/a/adclick/b", "http://h.org/phishing", "http://a.net/.com/",
        "http://h.org/wp-login.php", "http://cheap-pills.org/\x00", "http://é.com/" + "z" * 5000, "http://u:p@x.com:80/en/#f", "http://a.net/es/\nb"]


def naive_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (ascii_low(m.group(1)), m.group(2)) if m else ("", "")
    fits = []
    for verdict, rule in url_filters.BASE_RULES:
        h, _, p = rule.partition("/")
        if ("." + host).endswith("." + h) and path.startswith("/" + p):
            fits.append((len(rule), verdict, rule))
    if fits:
        return host, path, max(fits)[2], max(fits)[1]
    own = [re.escape(g).replace(r"\*\*", "(?s:.*)").replace(r"\*", "[^/]*").replace(r"\?", "[^/]") for g in url_filters.OWN_GLOBS]
    return host, path, None, "block" if any(re.fullmatch(g, f".{host}{path}") for g in own) else "allow"


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate([*URLS, URLS[0]])], "page_id bigint, url string, rule string")
    for r, url in zip(sorted(url_filters.judge(pages).collect()), [*URLS, URLS[0]]):
        assert tuple(r)[1:] == naive_verdict(url), url
    assert url_filters.judge(pages.where("page_id < 0")).count() == 0


def test_automaton_against_patterns():
    rng = random.Random(4)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", "ab"]) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    regexes = [re.compile(re.escape(g).replace(r"\*\*", "(?s:.*)").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")) for g in globs]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randrange(25))) for _ in range(300)]
    fits = url_filters.GlobAutomaton(globs).matches([t.encode() for t in texts])
    for text, row in zip(texts, fits):
        for glob, pattern, fit in zip(globs, regexes, row):
            assert bool(pattern.fullmatch(text)) == fit, (glob, text)


def test_chats(spark):
    first, second = "Hello there, how are you?\nI have a question.", "Fine, thanks!\nAsk away."
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", second), (1, 2, "user", "> fine   THANKS\nGood. Well:"),
        (1, 3, "assistant", "On Monday Ann wrote:\n> > Fine, thanks!\n> Good. Well:\nMy reply\n>unknown line"), (1, 4, "user", None),
        (1, 600, "user", ">I have a question.\n> Ask away.\n> Fine, thanks!\nStill open"), (2, 0, "user", first), (2, 1, "user", "> nobody said this\nok"),
        (2, 2, "user", "> ok\nagain"), (2, 2, "user", "> ok\nagain"), (None, 3, "user", "> ok"), (3, None, None, "> x\ny")]
    chats = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, thread int")
    got = {(r.conv_id, r.turn): r for r in chat_quotes.format_chats(chats).collect()}
    assert chat_quotes.format_chats(chats).count() == len(rows)
    replies = {k: r.reply_to for k, r in got.items() if r.reply_to is not None}
    assert replies == {(1, 2): 1, (1, 3): 2, (1, 600): 1, (2, 2): 1}
    assert [got[1, t].thread for t in (0, 1, 2, 3, 4, 600)] == [0, 1, 1, 1, 4, 1] and got[2, 2].thread == 1
    assert got[1, 3].text == "My reply\n>unknown line" and got[1, 3].max_level == 2 and got[1, 600].n_linked == 3 and got[1, 4].chat == "<|user|>\n\n<|end|>"
    assert chat_quotes.format_chats(chats.where("turn > 1000")).count() == 0


def plain_chats(rows):
    """{(conv, turn): (reply_to, thread, place, text)} message by message; turns are unique."""
    level = lambda line: re.match(r"(?:[ \t]*>)*", line).group().count(">")
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))

    def passages(lines):
        out, part, start = [], [], 0
        for i, line in enumerate([*lines, None]):
            blank = line is None or not norm(line)
            if part and (blank or level(line) != level(lines[start])):
                bodies = [re.sub(r"^((?:[ \t]*>)*)[ \t]?", "", x) for x in part]
                pieces = {norm(x) for x in [*bodies, *re.split(r"(?<=[.!?…])\s+", " ".join(bodies))]} - {""}
                out += [(level(lines[start]), start, x) for x in pieces]
                part = []
            if not blank:
                start = start if part else i
                part.append(line)
        return out

    result, reply = {}, {}
    known = {k: (t or "").split("\n") for k, t in rows.items()}
    for (conv, turn), lines in known.items():
        hits = []
        for lev, at, x in passages(lines):
            if lev:
                old = [t for (c, t), ls in known.items() if c == conv and t < turn and any(p[0] == 0 and p[2] == x for p in passages(ls))]
                hits += [(lev, at, max(old))] if old else []
        low = [h[2] for h in hits if h[0] == min(hits)[0]]
        reply[conv, turn] = max(low, key=lambda t: (low.count(t), t)) if low else None
        gone, i = set(), 0
        while i < len(lines):
            j = i
            while j < len(lines) and level(lines[j]):
                j += 1
            if j > i:
                said = i and re.search(r"(wrote|writes).*:$", lines[i - 1])
                if said or any(i <= h[1] < j for h in hits):
                    gone |= set(range(i - 1 if said else i, j))
            i = max(j, i + 1)
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        result[conv, turn] = (re.sub(r"\n{3,}", "\n\n", text) if gone else text).strip(" \n")
    place = {}

    def visit(conv, turn, root):
        place[conv, turn] = (root, sum(1 for r, _ in [v for k, v in place.items() if k[0] == conv] if r == root))
        for c, t in sorted(rows):
            if c == conv and reply[c, t] == turn:
                visit(conv, t, root)

    for c, t in sorted(rows):
        if reply[c, t] is None:
            visit(c, t, t)
    return {k: (reply[k], *place[k], result[k]) for k in rows}


def test_quotes_wrapped_partial_and_in_reply_order(spark):
    rng = random.Random(4)
    sentence = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(3, 14))).capitalize() + rng.choice(".!?")

    def wrapped(text, width, marks):
        lines, line = [], ""
        for word in text.split():
            if len(line) + len(word) > width:
                lines, line = [*lines, line], ""
            line = f"{line} {word}".strip()
        return "\n".join(f"{marks}{x}" for x in [*lines, line])

    rows, said = {}, {}
    for conv, turns in ((1, 40), (2, 7)):
        for turn in range(turns):
            said[conv, turn] = [sentence() for _ in range(rng.randrange(1, 5))]
            own, text = " ".join(said[conv, turn]), ""
            if turn and rng.random() < 0.8:
                of = rng.randrange(turn)
                part = " ".join(said[conv, of][rng.randrange(len(said[conv, of])):])
                text = rng.choice(["", "On Friday somebody wrote:\n"]) + wrapped(part, rng.choice([20, 35, 72]), rng.choice(["> ", ">"])) + "\n\n"
            turn = turn * 100
            rows[conv, turn] = text + (own if rng.random() < 0.5 else wrapped(own, 50, "")) + rng.choice(["", "\n>>> print(1)\n\n\n\nend", "\n"])
    rows[2, 5000], rows[2, 6000], rows[2, 7000] = None, "long " * 40000, "> nobody said that\n>> x\n\n\n\nreally"
    chats = spark.createDataFrame([(*k, t, "user", 7, 1) for k, t in rows.items()], "conv_id bigint, turn bigint, text string, role string, lines int, place int")
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.place, r.text) for r in chat_quotes.format_chats(chats).collect()}
    want = plain_chats(rows)
    assert got == want
    assert sum(v[0] is not None for v in got.values()) > 25 and max(v[2] for v in got.values()) > 5
    assert got[2, 7000][3] == "> nobody said that\n>> x\n\n\n\nreally"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    want = db.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    key = lambda row: [str(v) for v in row]
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(want.select(*columns).fetchall(), key=key)
