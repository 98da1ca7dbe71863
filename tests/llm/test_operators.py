"""Each operator against a brute-force version on small tables with awkward rows."""

import collections
import hashlib
import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrix.llm import chat, common, embedding, html_text, language, mixing, near_copies, packing, quality, simhash, suffix, url_filter

WORD = re.compile("[^\x20\x09-\x0d]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, lang="en"):
    stems = {"en": ["the", "of", "and", "tion", "ing", "her", "wh"], "fr": ["de", "la", "le", "eau", "é", "ment", "que"], "de": ["der", "und", "ung", "sch", "ein", "ü", "keit"]}[lang]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(60):
        lang = ["en", "fr", "de"][i % 3]
        out.append((i, prose(rng, rng.randint(60, 400), lang), lang, f"s{min(i % 7, 3)}", 0))
    passage = prose(rng, 40)
    for i in range(60, 75):  # exact copies, near copies, a shared passage
        kind, base = i % 3, out[i - 60][1]
        words = base.split(" ")
        if kind == 1:
            words[5] = "CHANGED"
        out.append((i, base if kind == 0 else " ".join(words) if kind == 1 else f"{prose(rng, 30)} {passage} {prose(rng, 30)}", "en" if kind == 2 else out[i - 60][2], "s0", 0))
    out += [
        (75, None, "en", None, None), (76, "", None, "s0", 0), (77, " \t\n\x0b\x0c\r ", "en", "s1", 7), (78, "a b c a b c a b c", "en", "s1", 0), (79, "x " * 5000, "fr", "s2", 0),
        (80, "line one\nline one\n\n  \nline two\nline one # $ | <", "en", "s2", 0), (81, "Ünïcode\u00a0text \u2003with \U0001f600 emoji " * 30, "de", "s3", 0), (81, "second row of one id " * 10, "de", "s3", 0),
        (82, "\x1c\x1d control \x85 marks <|endoftext|> İΣ ΑΣ don't we'll 12345 ¿qué?", "en", "s3", 0), (83, "ab" * 400, "en", "s1", 0),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).withColumn("component_id", F.lit("clash")).withColumn("fp", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def find(p, x):
    while p[x] != x:
        x = p[x]
    return x


# packing ------------------------------------------------------------------------------------------

def check_plan(histogram, capacity):
    places, n = packing.plan(histogram, capacity)
    fill = collections.defaultdict(list)
    ranks = collections.defaultdict(list)
    for length, rank, count, first, offset in places:
        ranks[length] += range(rank, rank + count)
        for s in range(first, first + count):
            fill[s].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items() if v}
    for s in fill.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(fill) == list(range(n))
    return n


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=14))
def test_plan_is_a_packing(histogram):
    n = check_plan(histogram, 64)
    total = sum(k * v for k, v in histogram.items())
    assert n >= math.ceil(total / 64)
    bins = []  # never worse than best fit, longest first
    for k in sorted(histogram, reverse=True):
        for _ in range(histogram[k]):
            fit = [i for i, b in enumerate(bins) if b >= k]
            if fit:
                i = min(fit, key=lambda i: bins[i])
                bins[i] -= k
            else:
                bins.append(64 - k)
    assert n <= len(bins)


def test_plan_beats_best_fit_where_configurations_matter():
    # best fit decreasing starts sequences of two 31s; threes of 22 + 21 + 21 and 32 + 32 fit exactly
    assert check_plan({32: 40, 22: 40, 21: 80}, 64) == 60
    assert packing.plan({}) == ([], 0)
    with pytest.raises(ValueError):
        packing.plan({3000: 1})


def test_plan_reaches_the_bound_on_many_lengths():
    """Grouped and rounded lengths: at most one sequence in three hundred over what the tokens fill."""
    rng = random.Random(8)
    for spread in (0.6, 1.0, 1.4):
        histogram = dict(collections.Counter(min(packing.CAPACITY, max(20, int(rng.lognormvariate(6.2, spread)))) for _ in range(20_000)))
        assert len([k for k in histogram if k > packing.CAPACITY * packing.LARGE[0]]) > packing.GROUPS
        bound = math.ceil(sum(k * n for k, n in histogram.items()) / packing.CAPACITY)
        assert bound <= check_plan(histogram, packing.CAPACITY) <= bound + bound // 300 + 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from(["ELİ.", "İ!", "Σας,", "don't", "ﬁn.", "ÀB;", "e\u0301.", "x\u0307:", " ", "\n", "a.b", "\u0085", "\ufeff.", "word.", "K.", "ß,"])), max_size=8))
def test_word_ids_are_the_tokenizers(parts):
    words = packing._word_ids(packing.TOKENIZER)
    for text in ("".join(parts), " ".join(parts)):
        assert words.text(text) == np.array(words.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_ids(docs, rows, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    tk = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 256):
            want[i, k // 256, k, min(256, len(ids) - k), zlib.crc32(ids[k : k + 256].tobytes())] += 1
    got = packing.pack_documents(docs, 256).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(none).count() == 0


def test_sequences_hold_the_ids(docs):
    pieces = common.cut(packing.tokenize(docs.where("doc_id < 9"), 128))
    out = packing.sequences(packing.assign(pieces, 128)).collect()
    assert sum(len(r["ids"]) for r in out) == 4 * pieces.agg(F.sum("length")).first()[0] and all(len(r["ids"]) == 4 * r["length"] <= 512 for r in out)


# chat -----------------------------------------------------------------------------------------------

CONVERSATIONS = [
    *((1, t, r, x) for t, r, x in ((0, "system", "be [INST] kind </s>"), (1, "user", "hi " * 90), (2, "assistant", "a </s>[INST] ok [/INST] " * 20), (3, "user", None), (4, "assistant", "end [\\INST] <\\\\s>"))),
    *((2, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " + "w " * (t * 7 % 50)) for t in range(40)),
    (3, 0, "assistant", "alone"), (4, 0, "system", "only system"), (5, None, None, None), (5, 2, "tool", "x"), (6, 0, "assistant", "twice"), (6, 0, "assistant", "twice"), (None, 0, "assistant", "nobody"),
    (7, 0, "user", "q"), (7, 1, "assistant", "long " * 900), (7, 2, "assistant", ""),
]


# a budget is in bytes, the bound of tokens: 480 and 120 are what 120 and 30 were in words
@pytest.mark.parametrize("budget,history", [(120, 30), (480, 120), (1024, 256)])
def test_chat_round_trip(spark, budget, history):
    turns = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat.format_chats(turns, budget, history).cache()
    by = collections.defaultdict(list)
    for c, t, r, x in CONVERSATIONS:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        lost = "".join(x for _, r, x in ts if r == "assistant")
        assert got[c]["n_turns"] == len(ts) and got[c]["loss_chars"] == len(lost)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(lost.encode()).hexdigest()
    rows = windows.collect()
    for r in rows:
        assert r["text"].count("[INST]") == r["text"].count("</s>") == r["text"].count("[/INST]")  # texts hold no control string
    if budget == 480:
        many = [r for r in rows if r["conv_id"] == 2]
        assert len(many) > 3 and any(r["n_repeated"] for r in many)
        assert all(r["text"].startswith("<s>[INST]system[/INST]") for r in rows if r["conv_id"] == 1)
    empty = turns.where("false")
    assert chat.read_back(chat.format_chats(empty)).count() == 0


def chat_turns(rng, n, first=0):
    """Conversations of all lengths: of one block, of several, with null and negative turns, long system turns."""
    out = []
    for c in range(n):
        turns = rng.sample(range(-70, 400), rng.choice([1, 3, 9, 150])) if c % 3 else list(range(rng.choice([2, 30, 130])))
        if c % 4 == 0:
            out.append((first + c, min(turns), "system", prose(rng, rng.choice([1, 20, 40]))))
            turns.remove(min(turns))
        out += [(first + c, t, rng.choice(["user", "assistant", "tool"]), prose(rng, rng.randint(0, 12), rng.choice(["en", "fr", "de"])) + rng.choice(["", " </s>", "[INST]", "\u0958\u0130\u0344" * 3])) for t in turns]
        if c % 5 == 0:
            out += [(first + c, None, "user", f"null {i}") for i in range(c % 7)]
    return out


@pytest.mark.parametrize("wide", [True, False])
def test_chat_windows_keep_the_budget(spark, monkeypatch, wide):
    """Every window against a reconstruction from the ordered turns, and the tokenizer's count against the budget."""
    from tokenizers import Tokenizer
    import public_tokenizers

    monkeypatch.setattr(chat, "BROADCAST_BLOCKS", 100 if wide else 0)
    tk, rng = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), random.Random(3)
    budget, history = 700, 150
    turns = chat_turns(rng, 24)
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    ties = {(r["conv_id"], r["turn"], r["role"], r["text"]): r["h"] for r in table.withColumn("h", F.shiftrightunsigned(F.xxhash64("role", "text"), 1)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in sorted(turns, key=lambda v: (v[0], v[1] is not None, v[1] or 0, ties[v])):
        by[c].append((r, x))
    windows = collections.defaultdict(list)
    for w in sorted(chat.format_chats(table, budget, history).collect(), key=lambda w: (w["conv_id"], tuple(w["window"]))):
        windows[w["conv_id"]].append(w)
    plain = lambda t: re.sub(r"([<\[])\\(\\*)(/?(?:s>|INST\]))", r"\1\2\3", t)
    assert set(windows) == set(by)
    for c, ws in windows.items():
        has_system, at = by[c][0][0] == "system", 0
        for k, w in enumerate(ws):
            said = [tuple(map(plain, t[6:].split("[/INST]", 1))) for t in w["text"][3:].split("</s>")[:-1]]
            cost = lambda t: len(f"[INST][/INST]</s>{t}".encode()) + 40
            new, old = said[w["n_repeated"] :], said[: w["n_repeated"]]
            assert new == by[c][at : at + len(new)]
            if has_system and k:
                assert old[0] == by[c][0]
                old = old[1:]
            assert old == by[c][at - len(old) : at] and sum(len(f"[INST]{r}[/INST]{x}</s>".encode()) for r, x in old) <= history
            at += len(new)
            shown = [plain(w["text"][s["start"] : s["start"] + s["length"]]) for s in w["loss"]]
            assert shown == [x for r, x in new if r == "assistant"]
            system_and_one = len(f"{by[c][0][1]}".encode()) * has_system + max(len(x.encode()) for _, x in new) + 250
            assert len(tk.encode(w["text"], add_special_tokens=False).ids) <= budget or len(new) == 1 and system_and_one > budget
        assert at == len(by[c])
    assert any(w["n_repeated"] > 1 for ws in windows.values() for w in ws) and any(len(ws) > 9 for ws in windows.values())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_chat_tokens_are_bounded(text):
    """The bytes and what is added for letters that grow, in Python; Spark's count is the same expression."""
    words = packing._word_ids(packing.TOKENIZER)
    grown = len(re.findall("[\u0130\u023A\u023E\u0300-\u036F\u0900-\u0FFF\u2ADC\uFB1D-\uFB4F\U0001D100-\U0001D1FF]", text))
    assert len(words.full.encode(text, add_special_tokens=False).ids) <= len(text.encode("utf-8", "replace")) + chat.MORE * grown


# html ---------------------------------------------------------------------------------------------

LONG = "This is the text of the article and it is about all of the things that we have seen in the town, with the people who were there and what they said of it to us. "


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<p>", ""), ("plain words", ""),
    (f"<nav><a href=x>Menu</a></nav><article><h1>Head &amp; line</h1><p>{LONG}<br>more\n  text<p>Short.</article><aside>{LONG}</aside><footer>{LONG}</footer>", None),
    (f"<div class='cookie-notice'>{LONG}</div><div><p>{LONG}{LONG}</p><p>Short end.</p></div><div id=comments><p>{LONG}</p></div><form><p>{LONG}</p></form>", None),
    (f"<main><header><h1>Head</h1></header><script>var a = '</p><p>' </script><style>p{{}}</style><!-- {LONG} --><p>{LONG}</p><div class=ad>{LONG}</div></main>", None),
])
def test_html_pages(page, want):
    got = html_text.main_text(page)
    if want is not None:
        assert got == want
        return
    whole = " ".join(LONG.split())
    assert whole in got and "Menu" not in got and "var" not in got and got.count(whole) == page.count("<p>" + LONG) - page.count("id=comments") - page.count("<form>") + page.count(LONG + LONG)
    assert "&amp;" not in got and all(" ".join(b.split()) == b for b in got.split("\n\n"))


def test_html_broken_markup_is_linear():
    for page in ("<" * 50_000, '<a "' * 20_000, "<div>" * 30_000 + "x", "<script>" + "a" * 100_000, "<p a='" + "b" * 100_000):
        html_text.main_text(page)


def test_html_templates(spark):
    table = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>", 9), (2, None, None, 9)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_text.extract(table).collect()}
    assert got[1]["text"] == LONG.strip() and got[1]["n_chars"] == len(LONG.strip()) and got[2]["text"] == "" and got[2]["n_chars"] == 0


def test_html_articles_whole():
    rng = random.Random(1)
    for _ in range(30):
        blocks = [prose(rng, rng.randint(1, 80)) + " | 50% & <" for _ in range(rng.randint(1, 9))]
        page = "<nav><ul><li><a href='/a'>a</a></ul></nav><div class=\"ad\">buy</div><article>" + "".join(f"<p>{html.escape(b)}" for b in blocks) + "</article><footer>&copy; x</footer>"
        assert html_text.main_text(page) == "\n\n".join(" ".join(b.split()) for b in blocks)


def test_html_marked_paragraphs_end():
    text = LONG.strip()
    for mark in ("class='author'", 'class="share"', "class=ad", 'id="notice"', "hidden"):
        for end in ("</p>", ""):
            assert html_text.main_text(f"<article><p {mark}>By X{end}<p>{text}</p><div>{text}</div></article>") == f"{text}\n\n{text}"
            assert html_text.main_text(f"<div><p {mark}>{text}{end}<article><p class=lead>{text}<p>{text}</article></div>") == f"{text}\n\n{text}"
            assert html_text.main_text(f"<article><p {mark}>By X{end}<ul><li>{text}</ul><p>{text}</article>") == f"{text}\n\n{text}"


TEXT = LONG.strip()


@pytest.mark.parametrize("page", [
    f'<body class="single no-sidebar"><nav>x</nav><article><p>{TEXT}<p>{TEXT}</article></body>', f'<body class="search-page"><div><p>{TEXT}<p>{TEXT}</div></body>',
    f'<html class="comments-open"><article><p>{TEXT}<p>{TEXT}</article>', f'<article class="post related"><p>{TEXT}</p><p>{TEXT}</p></article>',
    f'<div class="post author-smith"><p>{TEXT}<p>{TEXT}</div><footer>{TEXT * 5}</footer>', f'<form id="login"><h1></h1><p>{TEXT}<p>{TEXT}</form>',
    f"<article><p title='a > b'>{TEXT}<p>{TEXT}</article>", f'<article><p title="x > {"y" * 9000}">{TEXT}</p><p data-x=\'"\'>{TEXT}</article>',
    f"<article><p class='ad'>Buy now<p>{TEXT}<p>{TEXT}</article>", f"<article><ul><li class=share>Buy now<li>{TEXT}<li>{TEXT}</ul></article>",
    f"<article><table><tr><td class=ad>Buy<td>{TEXT}<tr><td>{TEXT}</table><dl><dt hidden>x<dd class=promo>y</dl></article>",
    f"<div data-class=ad><p>{TEXT}<p>{TEXT}</div><div class=comments><article><p>{TEXT}</article></div>",
    "<article>" + "<p class=x>" * 3000 + f"<p>{TEXT}</p></article><article><p>{TEXT}</article><p>Short outside.",
    f"<article><svg><svg></svg><p>no</svg><p>{TEXT}<button>b</button><select><option>one<option>two</select><p>{TEXT}</article>",
])
def test_html_marks_and_tags(page):
    assert html_text.main_text(page) == f"{TEXT}\n\n{TEXT}"


def test_html_blocks_are_decided_by_their_text():
    def labels(*texts, linked=0, article=False):
        return [b.label for b in html_text.classify([html_text.Block(t, linked, article=article) for t in texts])]

    dense, middling, low = TEXT * 2, "The report of the year: " + "figures numbers tables charts " * 3, "Alpha beta gamma delta epsilon zeta eta theta " * 5
    assert html_text.density(dense) > 0.28 > html_text.density(middling) > 0.15 > html_text.density(low)
    assert labels(dense) == ["good"] and labels(low) == ["bad"] and labels("Short.") == ["bad"] and labels(low, article=True) == ["good"]
    assert labels(dense, middling, low) == ["good", "good", "bad"] and labels(low, middling, low) == ["bad"] * 3
    assert labels(dense, "Short.", dense, low, "Short.", low) == ["good", "good", "good", "bad", "bad", "bad"]
    assert labels(dense, linked=len(dense)) == ["bad"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["good", "bad", "frame", "short", "near"]), max_size=14), st.integers(0, 1 << 14))
def test_html_nearest_neighbours(kinds, headings):
    """Against a search outward from every block."""
    found = [html_text.Block("x" * 80, heading=bool(headings >> i & 1), label="bad" if k == "frame" else k) for i, k in enumerate(kinds)]
    decided = [k if k in ("good", "bad") else None for k in kinds]
    want = []
    for i, (k, b) in enumerate(zip(kinds, found)):
        if k in ("good", "bad", "frame"):
            want.append(b.label)
            continue
        left, right = ([(abs(j - i), decided[j]) for j in side if decided[j]] for side in (range(i - 1, -1, -1), range(i + 1, len(kinds))))
        near = [side[0] for side in (left, right) if side]
        names = {x for _, x in near}
        if not names:
            want.append("good" if k == "near" else "bad")
        elif len(names) == 1:
            want.append(names.pop())
        elif b.heading:
            want.append(near[1][1])
        elif near[0][0] != near[1][0]:
            want.append(min(near)[1])
        else:
            want.append("good" if k == "near" else "bad")
    assert html_text.inherited(decided, found, False) == want


# quality --------------------------------------------------------------------------------------------

def counts(t):
    t = t or ""
    w = WORD.findall(t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_quality_counts(docs, rows, none, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        c = counts(t)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert collections.Counter(tuple(r)[:7] for r in got) == want and all(not (r["base_failed"] and r["kept"]) for r in got)
    assert quality.quality(none, labels).count() == 0 and quality.quality(docs, labels.where("false")).where("kept = base_failed").count() == 0
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_long_texts_take_the_same_count(spark, monkeypatch):
    monkeypatch.setattr(quality, "PACKED_WORDS", 2)
    t = "a b c d a b c x y z " * 3
    r = quality.features(spark.createDataFrame([(t,)], "text string")).first()[quality.FEATURES]
    assert r["n_repeat_words"] == counts(t)[4]


def test_binomial_tail(spark):
    cases = [(0, 100, 0.01), (3, 1000, 0.01), (120, 40_000, 0.005), (0, 5000, 0.005), (7, 10, 0.9), (60_000, 10_000_000, 0.0062)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(max(0, k - 20_000), k + 1)]
        assert math.isclose(got, math.fsum(map(math.exp, terms)), rel_tol=1e-6), (k, n, p, got)


def test_thresholds_are_certified(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 80) + (" #" * 120 if i % 4 == 0 else ""), "en") for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    bad = [r for r in got if r["doc_id"] % 4 == 0 and r["kept"]]
    good = [r for r in got if r["doc_id"] % 4 and not r["base_failed"]]
    assert not bad and sum(not r["kept"] for r in good) <= quality.RISK * len(good)


# urls ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("url,want", [
    (None, ("", "", None, "allow")), ("no scheme", ("", "", None, "allow")), ("https://A.Example.COM/en/x?q#f", ("a.example.com", "/en/x", "example.com/en/", "block")),
    ("http://www.example.com/en/", ("www.example.com", "/en/", "www.example.com/en/", "allow")), ("x://m.www.example.com/en/a", ("m.www.example.com", "/en/a", "www.example.com/en/", "allow")),
    ("http://notexample.com/en/", ("notexample.com", "/en/", "com/", "allow")), ("http://a.net/es/1", ("a.net", "/es/1", "net/es/", "block")), ("http://a.net/ES/1", ("a.net", "/ES/1", None, "allow")),
    ("http://com?x", ("com", "", None, "allow")), ("http://spam-farm.example.org/fr", ("spam-farm.example.org", "/fr", None, "block")), ("a://b://c/d", ("b:", "//c/d", None, "allow")),
    ("http://ÄB.com/é#", ("Äb.com", "/é", "com/", "allow")),
])
def test_urls(spark, url, want):
    df = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    assert tuple(url_filter.judge_urls(df).first())[1:] == want


def test_digest_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s))
    d = url_filter.DigestArray(url_filter.DigestArray.write(str(tmp_path), {"ab": 1, "cd": 0, "x": 1}))
    assert d.find([b"ab", b"cd", b"ef", b"x", b"y", b"abc"]).tolist() == [1, 0, -1, 1, -1, -1] and d.find([]).tolist() == []


# suffixes -------------------------------------------------------------------------------------------

def brute_suffix(texts):
    seen, out = set(), []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - 99):
            w = t[i : i + 100]
            if w in seen:
                cover[i : i + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for i in range(len(t)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((len(t), sum(cover), runs, hashlib.sha256(bytes(c for c, x in zip(t, cover) if not x)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix(docs, rows, hot, monkeypatch, none):
    monkeypatch.setattr(suffix, "HOT", hot)
    ordered = sorted(((i, (t or "").encode()) for i, t, *_ in rows), key=lambda r: (r[0], r[1]))
    want = collections.Counter((i, *r) for (i, _), r in zip(ordered, brute_suffix([t for _, t in ordered])))
    assert collections.Counter(tuple(r)[:5] for r in suffix.dedup_substrings(docs).collect()) == want
    assert suffix.dedup_substrings(none).count() == 0


@pytest.mark.parametrize("sampled", [1, 2, 1000])
def test_suffix_common_lines(spark, monkeypatch, sampled):
    """A very common line, alone and inside texts, with all, some or none of its anchors known from the sample."""
    monkeypatch.setattr(suffix, "HOT", 6)
    monkeypatch.setattr(suffix, "SAMPLED", sampled)
    rng = random.Random(21)
    line = prose(rng, 60)
    texts = [f"{prose(rng, rng.randint(0, 9))} {line} {prose(rng, rng.randint(0, 30))}" for _ in range(60)] + [f"{line} {line}", line, line[:150], line[50:170]] + [prose(rng, 40) for _ in range(9)]
    texts += [f"{line[-99:]}{k % 3} {prose(rng, 3)}" for k in range(30)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = collections.Counter((k, *r) for k, r in enumerate(brute_suffix([t.encode() for t in texts])))
    assert collections.Counter(tuple(r)[:5] for r in suffix.dedup_substrings(df).collect()) == want


def test_multikey_order():
    """Groups in order of their words, against Python's sort."""
    rng = np.random.default_rng(4)
    group, words = rng.integers(0, 3, 300), rng.integers(0, 2, (300, 4)).astype(np.uint64)
    items, number = suffix.multikey(group, lambda i, d: words[i, d], [0, 1, 2, 3])
    key = [(group[i], *words[i].tolist()) for i in range(300)]
    many = collections.Counter(key)
    assert items.tolist() == sorted((i for i in range(300) if many[key[i]] > 1), key=lambda i: (key[i], i)) and (np.diff(number) >= 0).all()


def test_suffix_slices_and_chunks(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE", 700)
    monkeypatch.setattr(suffix, "CHUNK", 40)
    ordered = sorted(((i, (t or "").encode()) for i, t, *_ in rows), key=lambda r: (r[0], r[1]))
    want = collections.Counter((i, *r) for (i, _), r in zip(ordered, brute_suffix([t for _, t in ordered])))
    assert collections.Counter(tuple(r)[:5] for r in suffix.dedup_substrings(docs).collect()) == want


def test_removed_text_keeps_whole_characters(spark):
    a = "é" * 200
    df = spark.createDataFrame([(1, "x" + a, "p"), (2, a + "tail", None), (3, None, "q")], "doc_id long, text string, n_chars string").withColumn("n_chars", F.lit(0).cast("long"))
    got = {r["doc_id"]: r for r in suffix.remove_repeats(df).collect()}
    assert got[3]["text"] is None and got[2]["text"] == "tail" and got[2]["n_chars"] == 4 and "\ufffd" not in got[1]["text"]


# embeddings -------------------------------------------------------------------------------------------

def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 25)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(150):
        v = (base[i % 12] + rng.normal(size=16) * 0.17).astype(np.float32)
        rows.append((i, [float(x) for x in v], i % 3 if i % 11 else None))
    rows += [(200 + k, rows[5][1], rows[5][2]) for k in range(6)]  # equal vectors
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, [], 1), (305, [1.0, 2.0], 1), (306, [float("inf")] * 16, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    p, n = {r[0]: r[0] for r in rows}, collections.Counter()
    ok = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) and r[2] is not None]
    for a in range(len(ok)):
        for b in range(a):
            x, y = np.array(ok[a][1]), np.array(ok[b][1])
            if ok[a][2] == ok[b][2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                n[ok[a][0]] += 1
                n[ok[b][0]] += 1
                s, t = find(p, ok[a][0]), find(p, ok[b][0])
                p[max(s, t)] = min(s, t)
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding.link_embeddings(df).collect()}
    assert got == {i: (n[i], find(p, i), find(p, i) == i) for i in p} and sum(n.values()) > 100
    assert embedding.link_embeddings(df.where("false")).count() == 0


def test_embedding_classes_of_one_id(spark):
    """One vec_id with two vectors counts each class for itself; vectors of null ids link like others."""
    a, b, c = [1.0, 0.0], [0.99, 0.1], [0.0, 1.0]
    rows = [(1, a, 1), (2, b, 1), (1, c, 1), (None, c, 1), (None, c, 2), (None, None, 2)]
    got = collections.Counter(map(tuple, embedding.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == collections.Counter([(1, 1, 1, True), (2, 1, 1, False), (1, 1, 1, True), (None, 1, 1, True), (None, 0, None, True), (None, 0, None, True)])


def test_quantisation_bound():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 40))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    c, s, e, a = embedding.quantise(u)
    rough = (c.astype(float) @ c.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(u @ u.T - rough) <= a[:, None] * e[None, :] + e[:, None] + 1e-9).all()


# simhash ------------------------------------------------------------------------------------------------

def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams)) if grams else 0


def test_fingerprints_against_spark_and_plain(spark, rows):
    for _, t, *_ in rows:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    h = spark.range(1).select(F.xxhash64(F.lit("the of and tion"))).first()[0]
    assert simhash.fingerprint("The OF and tion") == h & (1 << 64) - 1


@pytest.mark.parametrize("block", [4096, 6])
def test_simhash_components(spark, rows, docs, none, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = {}
    for i, t, *_ in rows:
        fps.setdefault(i, []).append(plain_fingerprint(t))
    nodes = sorted({f for v in fps.values() for f in v})
    p = {f: f for f in nodes}
    for a in nodes:
        for b in nodes:
            if a < b and (a ^ b).bit_count() <= 4:
                s, t = find(p, a), find(p, b)
                p[max(s, t)] = min(s, t)
    low = collections.defaultdict(lambda: 1 << 60)
    for i, v in fps.items():
        for f in v:
            low[find(p, f)] = min(low[find(p, f)], i)
    # two texts of one id tie their components together
    want = collections.Counter((i, f"{f:016x}") for i, v in fps.items() for f in v)
    got = simhash.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["fingerprint"]) for r in got) == want
    for r in got:
        if r["doc_id"] != 81:
            assert r["component_id"] == low[find(p, int(r["fingerprint"], 16))]
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == kept.select("doc_id").distinct().count()


def test_links_of_random_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 50)
    monkeypatch.setattr(simhash, "LINKS", 40)
    rng = random.Random(8)
    fps = []
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.append(f)
            for _ in range(rng.randint(1, 6)):
                f ^= 1 << rng.randrange(64)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, rep long")
    p = {k: k for k in range(len(fps))}
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                s, t = find(p, a), find(p, b)
                p[max(s, t)] = min(s, t)
    got = {r["node"]: r["component"] for r in common.components(simhash.links(df)).collect()}
    assert all(got.get(k, k) == find(p, k) for k in p)


def similar_texts(rng, n, j):
    """A text of n five-word shingles and a copy with words changed until their Jaccard similarity is about j."""
    a = [f"w{rng.getrandbits(40)}" for _ in range(n + 4)]
    b = list(a)
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    now, steps = 1.0, 0
    while now > j and steps < 10 * n:
        before, k, steps = list(b), rng.randrange(n + 4), steps + 1
        b[k] = f"v{rng.getrandbits(40)}"
        got = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        if got < j:
            b = before
            if now - j < 0.012 or steps > 3 * n:
                break
        else:
            now = got
    return " ".join(a), " ".join(b), now


@pytest.mark.parametrize("block", [2048, 7])
def test_drop_near_duplicates_of_similarity(spark, block, monkeypatch):
    from kestrix.llm import near_copies

    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng, texts, pairs = random.Random(3), [], []
    for k in range(80):
        a, b, j = similar_texts(rng, 200, 0.8 + 0.002 * k)
        pairs.append((len(texts), j))
        texts += [a, b]
    assert all(j >= 0.8 for _, j in pairs)
    far = []
    for _ in range(20):
        a, b, j = similar_texts(rng, 200, 0.7)
        if j < 0.8:
            far.append(len(texts))
            texts += [a, b]
    base = texts[0].split()
    texts += [" ".join([*base[:150], *(f"u{c}x{k}" for k in range(8)), *base[158:]]) for c in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert far and kept == {i for i, _ in pairs} | set(far) | {i + 1 for i in far}


def plain_ring(found):
    """Bits of a shingle set's ring, shingle by shingle."""
    mask, total = (1 << 64) - 1, np.zeros((2, near_copies.SEGMENTS * near_copies.WIDTH // 2), int)
    for h in found:
        z = [int(h) * int(f) & mask for f in near_copies._FACTORS[0]]
        z = [(v ^ v >> 32) * int(f) & mask for v, f in zip(z, near_copies._FACTORS[1])]
        weights = np.array([list((v ^ v >> 29).to_bytes(8, "little")) for v in z])
        total += np.stack([weights[:, ::2].reshape(-1), weights[:, 1::2].reshape(-1)])
    return (2 * total > 255 * len(found)).reshape(-1)


@pytest.mark.parametrize("n", [1, 5, 128, 300])
def test_ring_against_plain(n):
    found = near_copies.shingles(" ".join(f"w{k}" for k in range(n + 4)))
    assert len(found) == n
    assert (np.unpackbits(near_copies.fingerprint(found)) == plain_ring(found)).all()


@pytest.mark.parametrize("block", [2048, 2])
def test_chains_of_rings(spark, block, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    rng = np.random.default_rng(4)
    bits = near_copies.SEGMENTS * near_copies.WIDTH
    rings = []
    for _ in range(12):
        ring = rng.integers(0, 2, bits, np.uint8)
        for p in (0, 0.05, 0.15, 0.2, 0.25, 0.3):
            rings.append(ring ^ (rng.random(bits) < p))
    rings = np.packbits(np.array(rings), axis=1).view(np.uint16)
    apart = np.bitwise_count(rings[:, None] ^ rings[None]).astype(int)
    want = {k: k for k in range(len(rings))}
    for a in range(len(rings)):
        for b in range(a):
            for s in range(near_copies.SEGMENTS):
                chain = np.cumsum(np.roll(apart[a, b], -s)[: near_copies.LINKS_AHEAD + 1])
                if chain[0] == 0 and all(chain[k] <= near_copies.BUDGET * (k + 1) for k in range(1, len(chain))):
                    x, y = find(want, a), find(want, b)
                    want[max(x, y)] = min(x, y)
    classes = spark.createDataFrame([(k, 1, bytearray(r.tobytes())) for k, r in enumerate(rings)], "id long, n long, ring binary")
    got = {r["node"]: r["component"] for r in common.components(near_copies.candidates(classes)).collect()}
    assert 1 < len({find(want, k) for k in want}) < len(rings)
    assert all(got.get(k, k) == find(want, k) for k in want)


def test_hooked_edges_keep_components(spark):
    rng = random.Random(9)
    edges = [(k, lead) for k in range(20, 200) for lead in sorted(rng.sample(range(10 * (k % 2), 10 * (k % 2) + 10), 6))]
    df = spark.createDataFrame([*edges, (300, 299), (301, 300)], "a long, b long")
    few = near_copies._hooked(near_copies._hooked(df))
    assert few.count() < 2 * 202 < len(edges)
    named = lambda e: {(r["node"], r["component"]) for r in common.components(e).collect()}
    assert named(few) == named(df)


def test_chains_miss_few_similar_sets():
    rng, missed = np.random.default_rng(5), 0
    for both, one, other in [(4, 1, 0), (20, 3, 2), (80, 10, 10), (240, 60, 0)] * 100:
        found = rng.integers(0, 1 << 63, both + one + other, np.uint64) * np.uint64(2)
        a, b = found[: both + one], np.concatenate([found[:both], found[both + one :]])
        x, y = (near_copies._chains(near_copies.fingerprint(f).view(np.uint16)[None]) for f in (a, b))
        assert near_copies.similar(np.sort(a), np.sort(b))
        equal = x[0] == y[0]
        missed += not len(near_copies._chained((x[1] ^ y[1])[equal], None))
    assert missed <= 1


def test_drop_near_duplicates_null_and_repeated_ids(spark):
    rng = random.Random(6)
    a, b, c, d = (prose(rng, 100) for _ in range(4))
    rows = [(1, a), (7, a), (7, b), (None, c), (None, c), (None, d), (None, a)]
    for n in (1, 3):
        kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        assert collections.Counter((r["doc_id"], r["text"]) for r in kept) == collections.Counter([(1, a), (7, b), (None, c), (None, d)])


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 9), (None, 4), (20, 10)] + [(i, i + 1) for i in range(100, 160)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 8, 8: 8, 20: 10, 10: 10} | {i: 100 for i in range(100, 161)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# mixing ---------------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=20))
def test_solved_weights(tokens):
    t = np.array(tokens, float)
    a, w = mixing.solve(t, t.sum())
    own = mixing.entropy(t / t.sum())
    goal = own + mixing.ENTROPY * (math.log(len(t)) - own)
    assert 0 <= a <= 1 and math.isclose(w.sum(), 1) and mixing.entropy(w) <= goal + 1e-6 and (w * t.sum() / t).max() <= mixing.REPETITION + 1e-6


def test_mix(docs, rows, monkeypatch, none):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 800)
    out = mixing.mix(docs).collect()
    tokens = collections.Counter()
    for _, t, _, s, _ in rows:
        tokens[s] += len(WORD.findall(t or "")) + 1
    names = list(tokens)
    _, w = mixing.solve(np.array([tokens[s] for s in names], float), sum(tokens.values()))
    for s, share in zip(names, w):
        mine = [r for r in out if r["source"] == s]
        got, largest = sum(r["n_tokens"] for r in mine), max(r["n_tokens"] for r in mine)
        assert 0 <= got - share * sum(tokens.values()) < max(largest, 1) + 1, s
        each = collections.Counter((r["doc_id"], r["text"]) for r in mine)
        assert max(each.values()) - min(each.values()) <= 1  # whole passes and a part of one
    assert mixing.mix(none).count() == 0 and mixing.mix_documents(docs).columns == docs.columns
    again = mixing.mix(docs.repartition(5)).collect()
    assert collections.Counter((r["doc_id"], r["epoch"]) for r in again) == collections.Counter((r["doc_id"], r["epoch"]) for r in out)


def test_mix_of_many_sources(spark, docs, monkeypatch):
    """The exponent from aggregates equals the driver's, and so does the mixture."""
    rng = np.random.default_rng(2)
    for budget, target, limit in ((None, 0.5, 4.0), (3e6, None, 3.0), (None, 0.2, None), (None, 0.5, 1e9)):
        tokens = np.maximum(1, rng.lognormal(6, 2, 300)).astype(int)
        budget = float(tokens.sum()) if budget is None else budget
        exponent, w = mixing.solve(tokens.astype(float), budget, target, limit)
        got, log_norm, whole = mixing.solve_table(spark.createDataFrame([(int(t),) for t in tokens], "n long"), budget, target, limit)
        assert abs(got - exponent) < 1e-9 and np.allclose(np.exp(got * np.log(tokens / whole) - log_norm), w, rtol=1e-6)
    key = lambda r: (r["doc_id"], r["text"], r["epoch"], r["block"])
    want = collections.Counter(map(key, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 1)
    assert collections.Counter(map(key, mixing.mix(docs.withColumn("position", F.lit("clash")).withColumn("total", F.lit(1)).withColumn("size", F.lit(2)).withColumn("epoch", F.lit(9))).collect())) == want
    assert {r["position"] for r in mixing.mix_documents(docs.withColumn("position", F.lit("own"))).collect()} == {"own"}
    assert mixing.mix(docs.where("false")).count() == 0


# language -------------------------------------------------------------------------------------------------

def test_language(docs, rows, none):
    got = language.identify_documents(docs).collect()
    true = {i: (t, lang) for i, t, lang, *_ in rows}
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        t, lang = true[i]
        if t is None or not any(map(str.isalpha, t)):
            assert r["lang_pred"] == "und"
        elif i < 75:
            assert r["lang_pred"] == lang
    assert language.identify_documents(none).count() == 0
    unlabelled = language.identify_documents(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_language_sets_are_the_best_of_all(docs):
    """The chosen set against the likelihood of every set of languages, each fitted for long."""
    langs, logp = language.fit(docs.select("doc_id", "text", "lang"))
    rng = random.Random(12)
    for parts in ((("en", 200),), (("en", 150), ("de", 120)), (("fr", 90), ("en", 200), ("de", 130)), (("de", 30), ("fr", 300))):
        text = " ".join(prose(rng, n, x) for x, n in parts)
        _, k, n = language.counts_of([text])
        best = None
        for m in range(1, len(langs) + 1):
            for chosen in itertools.combinations(range(len(langs)), m):
                like, pi = np.exp(logp[k][:, chosen]), np.full(m, 1 / m)
                for _ in range(200):
                    pi = pi * (like * (n / (like @ pi))[:, None]).sum(axis=0) / n.sum()
                value = (np.log(like @ pi) * n).sum() - 0.5 * np.log(n.sum()) * m
                best = max(best or (-math.inf,), (value, chosen, float(pi.max()), langs[chosen[int(pi.argmax())]]))
        found, share = language.infer([text], logp)
        assert langs[found[0]] == best[3] and abs(share[0] - best[2]) < 0.02 and set(np.array(langs)[list(best[1])]) == {x for x, _ in parts}


def test_mixture_proportions(docs):
    langs, logp = language.fit(docs.select("doc_id", "text", "lang"))
    rng = random.Random(6)
    texts = [prose(rng, 300, "en") + " " + prose(rng, 150, "fr"), prose(rng, 400, "de")]
    best, share = language.infer(texts, logp)
    assert langs[best[0]] == "en" and 0.5 < share[0] < 0.8 and langs[best[1]] == "de" and share[1] == 1.0
    whole = language.infer([" ".join(texts)], logp)
    monkey, language.CHUNK = language.CHUNK, 500
    try:
        assert np.allclose(language.infer([" ".join(texts)], logp)[1], whole[1])
    finally:
        language.CHUNK = monkey


# pipeline ---------------------------------------------------------------------------------------------------

def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as c

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(c.STAGES[:-1]):
        before, now = now, common.cut(stage(spark, now, str(tmp_path)))
        assert now.columns == plain.columns and now.count() > 0
        if k < 2:
            assert now.join(before, ["doc_id", "text"], "left_semi").count() == now.count()
    assert now.where("doc_id in (75, 76, 77)").count() == 0
    out = c.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in now.collect()}
