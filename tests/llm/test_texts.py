"""Pages, lines, labels, conversations, urls, mixtures, pipeline."""

import html as markup
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tamis.llm import chat, html_text, lines, mixture, quality, toxicity, url_filter
from tamis.llm.queries import RULES
from tamis.llm.tables import fold
from tests.conftest import SF

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, places string, kept string, block int, size string, draws string, toxicity string"


def docs(spark, texts, source=lambda i: "s"):
    return spark.createDataFrame([(i, t, "en", source(i), 0, "p", "k", 1, "z", "d", "x") for i, t in texts], DOCS)


# pages

def test_article_of_the_given_pages(spark):
    rows = html_text.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    given = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", given[r["page_id"]], re.S)[1]
        blocks = [" ".join(markup.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<", "<"), ("a < b", "a < b"), ("<!-- open <p>x", ""), ("<p>x", "x"), ("<script>var a='<p>no</p>'", ""),
    ("<main><p>a&amp;b &lt;c&gt; &#233;\n\t d<br>e</p></main>", "a&b <c> é d e"),
    ("<article><h1>T</h1><p>one<p>two<aside>no</aside><ul><li>three<li>four</ul></article><footer>no</footer>", "T\none\ntwo\nthree\nfour"),
    ("<nav><a href='/'>Home</a></nav><article class='post has-sidebar'><p>x</p><div class='share'>no</div><p>y</p></article>", "x\ny"),
    ("<div class='cookie-notice'>" + "cookies " * 90 + "</div><article><p>short</p></article>", "short"),
    ("<a title='x>y' href=\"u>v\">link</a> text that is not a link", "link text that is not a link"),
    ("<article><p>in</p></article><div id=comments><p>" + "reader " * 99 + "</p></div>", "in"),
])
def test_article(page, text):
    assert html_text.extract(page) == text


def test_article_without_article_element():
    page = ("<html><body><div class='top'><a href=1>Home</a> <a href=2>About</a></div><div id=c><h1>Big title</h1><p>" + "word " * 30 + "</p><div class='ad'>buy</div><p>"
            + "more " * 20 + "</p><p>end.</p></div><div class='comments'><p>" + "reader " * 100 + "</p></div><div>tiny</div></body></html>")
    assert html_text.extract(page).split("\n") == ["Big title", ("word " * 30).strip(), ("more " * 20).strip(), "end."]


@pytest.mark.parametrize("page", [
    "<div><p>{0}</p><p>{1}</p><article><p>card</p></article></div>",  # one stretch, mostly outside the article element
    "<section><p>{0}</p></section><section><p>{1}</p></section><nav>menu</nav><article><p>card</p></article>",  # a stretch of its own
])
def test_short_article_overrides_no_heavier_stretch(page):
    body = ["first " * 60, "second " * 60]
    assert html_text.extract(page.format(*body)).split("\n")[:2] == [b.strip() for b in body]


def article_of(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(markup.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", article)]
    return "\n".join(b for b in blocks if b)


def test_the_distribution_finds_articles_in_plain_elements(monkeypatch):
    import duckdb
    given = [h for h, in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    divs = [h.replace("<article>", "<div>").replace("</article>", "</div>") for h in given]
    assert [html_text.extract(h) for h in divs] == [article_of(h) for h in given]
    # no telling element or name at all: menus, adverts and footers are plain blocks beside the article's
    plain = [re.sub(r"<(/?)(?:nav|article|footer|header|aside|main|section|form)\b[^>]*>", r"<\1div>", re.sub(r"\s(?:class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", h))
             for h in given]
    found = sum(html_text.extract(p) == article_of(h) for p, h in zip(plain, given, strict=True))
    assert found >= 0.95 * len(given)
    monkeypatch.setattr(html_text, "SURGE", 10**9)  # nothing surges, and so there is no text
    monkeypatch.setattr(html_text, "SURGE_SHARE", 1)
    assert {html_text.extract(h) for h in given} == {""}


def test_surge_dive_and_window_decide(monkeypatch):
    gap = "<nav>menu</nav>"
    page = f"<div><p>{'long ' * 40}</p>{gap}<p>twelve chars</p>{gap}<p>{'more ' * 30}</p></div><div><p>{'else ' * 5}</p></div>"
    long, more = ("long " * 40).strip(), ("more " * 30).strip()
    assert html_text.extract(page) == f"{long}\n{more}"  # the short line does not surge
    monkeypatch.setattr(html_text, "SURGE", 5)
    assert html_text.extract(page) == f"{long}\ntwelve chars\n{more}"
    monkeypatch.setattr(html_text, "SURGE", 180)
    monkeypatch.setattr(html_text, "SURGE_SHARE", 0.9)
    assert html_text.extract(page) == long


def test_stretches():
    lengths = np.array([0, 50, 0, 0, 0, 10, 60, 5, 0, 0, 0, 0, 8])
    assert html_text.stretches_of(lengths) == [(1, 1), (5, 7)]
    rng = np.random.default_rng(7)
    for _ in range(200):  # every stretch starts over the threshold and ends where a window is empty
        length = np.where(rng.random(40) < 0.5, 0, rng.integers(1, 100, 40))
        padded = np.append(length, [0] * html_text.WINDOW)
        sums = [int(padded[i:i + html_text.WINDOW].sum()) for i in range(40)]
        surge = min(html_text.SURGE, max(sums) / 2)
        inside = np.zeros(40, dtype=bool)
        for a, b in html_text.stretches_of(length):
            assert length[a] and sums[a] > surge and all(sums[a:b + 1]) and (b == 39 or sums[b + 1] == 0)
            inside[a:b + 1] = True
        assert all(inside[i] for i in range(40) if length[i] and sums[i] > surge)


def test_unclosed_inline_elements_nest_nothing():
    page = "<div><h1>title here</h1><p><b>one<p>two<p>three</div><div>" + "x" * 30 + "</div>"
    assert [len(x.box) for x in html_text.lines_of(page)] == [3, 3, 3, 3, 2]


def test_sibling_articles_are_kept():
    posts = [f"post {i} " * (10 + i) for i in range(3)]
    page = "<div><article><p>{}</p></article><nav>menu</nav><article><p>{}</p></article><article><p>{}</p></article></div><p>tail</p>"
    assert html_text.extract(page.format(*posts)).split("\n") == [p.strip() for p in posts]


def test_hostile_pages_take_linear_time():
    for page in ("<b>" * 50_000 + "x", "<a '" * 50_000, "<p><i></p>" * 30_000, "<!--" * 50_000, "<" * 100_000, "</div>" * 50_000):
        html_text.extract(page)


def test_pages_keep_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, "t", 5), (None, "<p>x</p>", "t", 5), (None, "<p>x</p>", "t", 5)], "page_id bigint, html string, text string, n_chars int")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.main_text(df).collect()) == [(0, "x", 1), (0, "x", 1), (1, "", 0)]
    assert html_text.main_text(df.limit(0)).collect() == []


# lines

def test_line_dedup(spark):
    long_line = "This line is longer than forty characters, it is."
    texts = [(i, f"own {i}\n  {long_line.upper()}\t\n{long_line}\nshort") for i in range(6)] + [(10, None), (11, ""), (12, "\n"), (None, long_line), (20, "short\n" * 20_000 + "x")]
    out = {r["doc_id"]: r for r in lines.dedup(docs(spark, texts)).collect()}
    assert len(out) == len(texts) and out[5]["n_dropped"] == 0 and out[5]["kept"] == texts[5][1]
    for i in range(5):
        assert (out[i]["n_lines"], out[i]["n_dropped"], out[i]["kept"]) == (4, 2, f"own {i}\nshort")
    assert [out[i]["n_lines"] for i in (10, 11, 12, 20)] == [1, 1, 2, 20_001]
    assert out[10]["kept"] == out[11]["kept"] == "" and out[12]["kept"] == "\n" and out[None]["kept"] == long_line
    assert out[0]["places"] == "p" and lines.dedup(docs(spark, [])).collect() == []


def test_line_dedup_counts_documents_not_rows(spark):
    line = "x" * 40
    four = [(i, f"{line}\n{line}") for i in range(4)] + [(0, line)]
    assert {r["n_dropped"] for r in lines.dedup(docs(spark, four)).collect()} == {0}
    assert sorted(r["n_dropped"] for r in lines.dedup(docs(spark, [*four, (9, "x" * 41), (8, f" {line}")])).collect()) == [0, 0, 1, 2, 2, 2, 2]


def test_runs_are_compacted(spark):
    runs = lines.Runs(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([("h", b), ("h", b + 1), (f"h{b}", b)], "hash string, doc_id bigint"))
    assert [len(level) for level in runs.levels] == [1, 0, 1] and runs.compactions == 3
    assert {r["hash"]: (r["n_docs"], r["keeper"]) for r in runs.all().collect()} == {"h": (10, 5), **{f"h{b}": (1, b) for b in range(5)}}


# labels

def made(n, toxic_words=("vile", "nasty", "rotten")):
    """Prose, junk and toxic documents with labels."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), size=rng.integers(2, 9))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, size=60))
        good, toxic = i % 4 != 0, i % 3 == 0
        if toxic:
            for j in rng.integers(0, 60, size=4):
                w[j] = str(rng.choice(toxic_words))
        t = " ".join(w).capitalize() + "."
        texts.append((i, t if good else " ".join(x + "%%% ###" for x in w)))
        if i % 2:
            labels.append((i, int(good), int(toxic)))
        elif i % 8 in (0, 2):
            labels.append((i, int(good), int(toxic)))
    return texts, labels


ODD = [(5000, None), (5001, ""), (5002, " \n "), (5003, "vile " * 50_000), (None, "vile"), (None, None), (5004, "x"), (5004, "x")]
LABELS = "doc_id bigint, quality int, toxic int, text string"


def test_quality(spark):
    texts, labels = made(800)
    table = spark.createDataFrame([(*x, "") for x in labels] + [(1, None, None, ""), (None, 1, 1, ""), (1, 1, 0, "")], LABELS)
    model = quality.train(docs(spark, texts), table)
    assert 0.5 < model.prior < 0.95  # three of four are good
    out = quality.score(docs(spark, texts + ODD), model).collect()
    assert len(out) == len(texts) + len(ODD) and all(0 <= r["quality_score"] <= 1 for r in out)
    right = np.mean([(r["quality_score"] >= 0.3) == (r["doc_id"] % 4 != 0) for r in out if r["doc_id"] is not None and r["doc_id"] < 800])
    assert right > 0.97
    empty = {r["quality_score"] for r in out if not (r["text"] or "").strip() and r["text"] != " \n "}
    assert len(empty) == 1
    assert quality.score(docs(spark, []), model).collect() == []


def test_quality_without_labels(spark):
    model = quality.train(docs(spark, [(1, "a b"), (2, "c")]), spark.createDataFrame([], LABELS))
    assert {r["quality_score"] for r in quality.score(docs(spark, [(1, "a b")]), model).collect()} == {0.5}


def test_quality_learns_from_its_folds_only(spark):
    texts, labels = made(400)
    flipped = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q, t, "") for i, q, t in labels]
    a, b = (quality.train(docs(spark, texts), spark.createDataFrame(x, LABELS)) for x in ([(*x, "") for x in labels], flipped))
    assert np.array_equal(a.weights, b.weights)


def test_best_bin_prior():
    rng = np.random.default_rng(7)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    assert abs(quality.best_bin_prior(p, np.concatenate([p[:3000] + 0.01, n[:1000]])) - 0.75) < 0.06


def test_nonnegative_risk_beats_positive_against_unlabelled():
    rng = np.random.default_rng(8)
    good, bad = rng.normal(1, 1, (3000, 2)), rng.normal(-1, 1, (3000, 2))
    unlabelled = np.vstack([good[1000:2800], bad[:600]])
    s = quality.Quality().fit(good[:1000], unlabelled, prior=0.75)
    assert np.mean(s.scores(good[2800:]) > 0.5) > 0.85 and np.mean(s.scores(bad[2000:]) > 0.5) < 0.25


def test_toxicity(spark):
    texts, labels = made(900)
    table = spark.createDataFrame([(*x, "") for x in labels] + [(1, None, None, ""), (None, 1, 1, "")], LABELS)
    field = toxicity.train(docs(spark, texts), table, steps=40)
    assert {"vile", "nasty", "rotten"} <= set(field.words)
    out = toxicity.tag(docs(spark, texts + ODD), field).collect()
    assert len(out) == len(texts) + len(ODD) and all(0 <= r["toxicity"] <= 1 for r in out)
    assert np.mean([(r["toxicity"] >= 0.7) == (r["doc_id"] % 3 == 0) for r in out if r["doc_id"] is not None and r["doc_id"] < 900]) > 0.97
    for r in out:
        for s in r["toxic_spans"]:
            found = r["text"][s["start"]:s["end"]].lower()
            assert r["doc_id"] is None or r["doc_id"] >= 900 or any(w in found for w in ("vile", "nasty", "rotten"))
    assert toxicity.tag(docs(spark, []), field).collect() == []


def test_long_texts_displace_no_others_from_the_fit(spark):
    texts, labels = made(300)
    table = spark.createDataFrame([(*x, "") for x in labels], LABELS)
    # the first two toxic documents in the order of the hash are longer than what is fitted on
    first = table.where((F.col("toxic") == 1) & (fold("doc_id", 3) != 1)).orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id").limit(2)
    long_ones = {r["doc_id"] for r in first.collect()}
    texts = [(i, " ".join([t] * 100) if i in long_ones else t) for i, t in texts]
    field = toxicity.train(docs(spark, texts), table, steps=40, most_bytes=40_000)
    assert {"vile", "nasty", "rotten"} <= set(field.words)
    out = toxicity.tag(docs(spark, texts), field).collect()
    assert np.mean([(r["toxicity"] >= 0.7) == (r["doc_id"] % 3 == 0) for r in out]) > 0.97


def test_window_with_most_marks(spark):
    field = toxicity.Field(["vile"], [])
    rows = [(1, "ä word " * 50 + "vile so vile " + "word " * 50, 1), (2, "short", 1), (3, None, 0), (4, "x" * 90, 0), (5, "plain words " * 9, 0)]
    sample = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    out = {r["doc_id"]: r["text"] for r in toxicity._windows(sample, field, {1: 24, 0: 20}).collect()}
    assert "vile so vile" in out[1] and len(out[1]) <= 24
    assert (out[2], out[3], out[4], out[5]) == ("short", None, "x" * 20, "plain words plain")


def test_common_length():
    for lengths, room, most in (([5, 1, 9], 15, 9), ([5, 1, 9], 14, 8), ([100, 100, 1], 11, 5), ([0, 0], 3, 1), ([10**9], 7, 7)):
        assert toxicity._common_length(np.array(lengths), room) == most


def test_toxicity_without_labels(spark):
    field = toxicity.train(docs(spark, [(1, "a b")]), spark.createDataFrame([], LABELS))
    assert len({r["toxicity"] for r in toxicity.tag(docs(spark, [(1, "a b c"), (2, None)]), field).collect()}) <= 2


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(9)
    field = toxicity.Field(["w"], [])
    field.bias, field.transition, field.start = 0.3, rng.normal(size=(2, 2)), rng.normal(size=2)
    field.weights[:] = rng.normal(size=len(field.weights))
    of = np.array([0, 4, 4, 5, 12])
    features = np.full((12, 6), -1)
    features[:, 0] = np.where(rng.random(12) < 0.5, 0, -1)
    toxic, joint = field.marginals(features, of)
    for a, b in itertools.pairwise(of):
        e = field.bias + np.append(field.weights, 0.0)[features[a:b]].sum(axis=1)
        total, sums = 0.0, np.zeros(b - a)
        for path in itertools.product((0, 1), repeat=b - a):
            if path:
                w = np.exp(field.start[path[0]] + sum(field.transition[x, y] for x, y in itertools.pairwise(path)) + sum(e[i] for i, s in enumerate(path) if s))
                total += w
                sums += w * np.array(path)
        assert b == a or np.allclose(toxic[a:b], sums / total)
    assert np.allclose(joint[1].sum(), 1) and joint[4].sum() == 0


# conversations

def cheapest(roles, costs=chat.Costs()):
    """The cost of the best repair, by searching all of them in the order of cost."""
    import heapq
    queue, done = [(0.0, 0, "start")], set()
    while True:
        c, i, s = heapq.heappop(queue)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(roles) and s in chat.LAST:
            return c
        label = {r: 0 if i < len(roles) and roles[i] == r else costs.name if i < len(roles) and roles[i] == chat.UNKNOWN else costs.relabel for r in chat.ROLES}
        for b in chat.NEXT[s]:
            heapq.heappush(queue, (c + costs.insert, i, b))
            if i < len(roles):
                heapq.heappush(queue, (c + label[b], i + 1, b))
        if i < len(roles) and s != "start":
            heapq.heappush(queue, (c + costs.merge + label[s], i + 1, s))


def legal(steps, closing):
    s = "start"
    for x in [r for kind, role, inserted, _ in steps for r in (inserted + [role] if not kind.endswith("merge") else [])] + closing:
        if x not in chat.NEXT[s]:
            return False
        s = x
    return s in chat.LAST


def test_cheapest_repair():
    repair = chat.Repair()
    for n in range(1, 5):
        for roles in map(list, itertools.product((*chat.ROLES, chat.UNKNOWN), repeat=n)):
            states, total = repair.borders([repair.product(roles[:n // 2]), repair.product(roles[n // 2:])])
            steps = repair.run(roles[:n // 2], states[0], states[1]) + repair.run(roles[n // 2:], states[1], states[2])
            closing = repair.closed(states[2])
            assert total == cheapest(roles) == sum(x[3] for x in steps) + repair.costs.insert * len(closing) and legal(steps, closing)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "<|im_end|>"), (None, 0, None, None), (None, None, "bot", "x"), (2, 1, "GPT", "a"), (2, 0, " Human", "q"), (3, 0, "x", "y"), (3, 0, "x", "y")]
    rows += [(9, i, ("user", "assistant")[i % 3 % 2], f"t{i}") for i in range(400)]  # spans several partitions
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id bigint, turn int, role string, text string, rendered string")
    out = chat.formatted(df).collect()
    assert len(out) == len(rows)
    whole = {c: "".join(r["rendered"] for r in sorted(out, key=lambda r: r["place"]) if r["conv_id"] == c) for c in (None, 1, 2, 3, 9)}
    assert whole[1] == "<|im_start|>user\nhi\n<| im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert whole[2] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert re.findall(r"<\|im_start\|>(\w+)", whole[9]) == ["user", "assistant"] * (len(re.findall("im_start", whole[9])) // 2)
    assert sum(r["cost"] for r in out if r["conv_id"] == 9) == cheapest([r[2] for r in rows if r[0] == 9])
    assert sum(r["cost"] for r in out if r["conv_id"] is None) == cheapest(["assistant", chat.UNKNOWN])
    assert chat.formatted(df.limit(0)).collect() == []


# urls

def test_urls(spark):
    rows = [(1, "http://A.org/x?y", '<a href="http://c.net/">'), (2, "https://b.com/de/1", "<A class=q HREF=//d.net/q>x</a>"), (3, "http://c.net", "<p>"),
            (4, "http://d.net/z", '<a href="http://b.com/">'), (5, None, None), (6, "nope", ""), (7, "ftp://q.example.org/es/1#f", ""), (8, "http://example.org/en/12", ""),
            (9, "http://x.org", None), (10, "http://notexample.org/es/", ""), (11, "://h?://i", ""), (11, "://h?://i", "")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id int, url string, html string, host string")
    out = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, RULES).fillna("", ["rule"]).collect())
    assert out == [(1, "a.org", "/x", "org/", "allow"), (2, "b.com", "/de/1", "com/de/", "block"), (3, "c.net", "", "", "allow"), (4, "d.net", "/z", "", "block"), (5, "", "", "", "allow"),
                   (6, "", "", "", "allow"), (7, "q.example.org", "/es/1", "example.org/es/", "block"), (8, "example.org", "/en/12", "example.org/en/1", "block"),
                   (9, "x.org", "", "", "allow"), (10, "notexample.org", "/es/", "org/", "allow"), (11, "h", "", "", "allow"), (11, "h", "", "", "allow")]
    assert url_filter.judge(df.limit(0), RULES).collect() == []


def test_distrust_reaches_the_whole_chain(spark):
    n = 25
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">') for i in range(n)] + [(n, f"http://h{n}.net/", "")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    out = {r["page_id"]: r for r in url_filter.judge(df, [url_filter.Rule("block", f"h{n}.net", "/")], damping=0.3).collect()}
    assert {r["verdict"] for r in out.values()} == {"block"} and out[0]["distrust"] > 0


def test_propagation_that_does_not_converge_raises(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_ROUNDS", 1)
    links = spark.createDataFrame([("allow", "a", "b", 1), ("allow", "b", "c", 1)], "kind string, source string, target string, n bigint")
    with pytest.raises(RuntimeError):
        url_filter.propagate(links, spark.createDataFrame([("allow", "a", 1)], "kind string, host string, pages bigint"))


def test_propagation_against_matrix(spark):
    rng = np.random.default_rng(10)
    n = 12
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (30, 2)) if a != b}
    links = spark.createDataFrame([("allow", str(a), str(b), 1 + a) for a, b in pairs], "kind string, source string, target string, n bigint")
    seeds = spark.createDataFrame([("allow", "0", 3), ("allow", "1", 1)], "kind string, host string, pages bigint")
    m = np.zeros((n, n))
    for a, b in pairs:
        m[a, b] = 1 + a
    out = m.sum(axis=1, keepdims=True)
    m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
    seed = np.zeros(n)
    seed[:2] = 0.75, 0.25
    r = seed
    for _ in range(100):
        flow = r @ m
        r = 0.85 * flow + (1 - 0.85 * flow.sum()) * seed
    got = {int(x["host"]): x["rank"] for x in url_filter.propagate(links, seeds, iterations=60, tolerance=1e-9).collect()}
    assert np.allclose([got.get(i, 0.0) for i in range(n)], r, atol=1e-6)


# mixtures

def test_mixture(spark):
    rng = np.random.default_rng(11)
    sources = [None, "a", "b", "c", "dé", "e"]
    texts = [(i, " ".join(["w"] * int(rng.integers(0, 30)))) for i in range(600)] + [(700, None), (701, ""), (None, "x y"), (None, "x y"), (702, "w " * 500), (703, "a b c")]
    of = lambda i: sources[(i or 0) % 6] if (i or 0) % 3 else "a"
    df = docs(spark, texts, of)
    out = mixture.mix(df, block_words=128, shard_words=2048).collect()
    assert len(out) == len(texts)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts}
    total, taken, target = {}, {}, {}
    for r in out:
        assert r["size"] == size[r["doc_id"]] and len(r["draws"]) <= 2
        total[r["source"]] = total.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * len(r["draws"])
        target[r["source"]] = r["target"]
    names = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, want = 1.5 * sum(total.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * total[s]]
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        for s in over:
            want[s] = 2.0 * total[s]
            left -= want[s]
            free.discard(s)
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 250
    again = mixture.mix(df.repartition(7), block_words=128, shard_words=2048).collect()
    key = lambda rows: sorted(str((r["doc_id"], r["text"], r["draws"])) for r in rows)
    assert key(again) == key(out)
    rows = mixture.mixed_rows(mixture.mix(df, block_words=128, shard_words=2048))
    assert rows.count() == sum(len(r["draws"]) for r in out) and {"pass", "shard", "text", "lang"} <= set(rows.columns)


def test_mixture_of_nothing(spark):
    assert mixture.mix(docs(spark, [])).collect() == []
    assert [len(r["draws"]) for r in mixture.mix(docs(spark, [(1, ""), (2, None)])).collect()] == [0, 0]


def test_quotas_are_exact(spark):
    quotas = {0: 17, 1: 3, 2: 100}
    out = mixture.split_quotas(spark.createDataFrame(list(quotas.items()), "nth int, quota bigint"), 7, 1).collect()
    assert {n: sum(r["quota"] for r in out if r["nth"] == n) for n in quotas} == quotas
    shards = [sum(r["quota"] for r in out if r["shard"] == s) for s in range(7)]
    assert sum(shards) == 120 and max(shards) - min(shards) <= 1


def test_quotas_follow_the_hypergeometric_law(spark):
    shards, per_shard, ones = 256, 16, 1024  # 4096 blocks, 1024 of them of the second source
    quotas = spark.createDataFrame([(0, shards * per_shard - ones), (1, ones)], "nth int, quota bigint")
    of = {r["shard"]: r["quota"] for r in mixture.split_quotas(quotas, shards, 3).collect() if r["nth"] == 1}
    drawn = np.array([of.get(s, 0) for s in range(shards)])
    assert drawn.sum() == ones
    n, total = per_shard, shards * per_shard
    share = ones / total
    variance = n * share * (1 - share) * (total - n) / (total - 1)
    assert 0.75 * variance < drawn.var() < 1.3 * variance  # in order it would be 48, dealt evenly 0
    pairs = np.corrcoef(drawn[:-1], drawn[1:])[0, 1]
    assert abs(pairs) < 0.2  # neighbours in the tree do not copy each other
    # cells of the exact distribution
    from math import comb
    law = np.array([comb(ones, k) * comb(total - ones, n - k) / comb(total, n) for k in range(n + 1)]) * shards
    cells = [(0, 2), (3, 3), (4, 4), (5, 5), (6, n)]
    chi = sum(((drawn >= a) & (drawn <= b)).sum() ** 2 / law[a:b + 1].sum() for a, b in cells) - shards
    assert chi < 18.5  # 0.999 quantile of 4 degrees of freedom


def test_mixture_tells_its_shards(spark):
    from tamis.llm.queries import op3_mixing_sources
    out = op3_mixing_sources(spark, SF).collect()
    for r in out:
        assert r["taken"] == r["size"] * len(r["in_shards"]) and all(0 <= s < r["shards"] for s in r["in_shards"])


def test_an_id_on_many_rows_counts_once(spark):
    texts, labels = made(160)
    many = docs(spark, texts + [texts[0]] * 3000 + [texts[1]] * 3000)
    assert len(quality._rows(many)) == len(texts)  # what comes to the driver
    lab = spark.createDataFrame([(*r, "t") for r in labels], LABELS)
    once, again = toxicity.train(docs(spark, texts), lab), toxicity.train(many, lab)
    assert once.words == again.words and once.words and np.allclose(once.weights, again.weights)


# pipeline

def test_pipeline(spark):
    at = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = at.columns, at.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == columns, name
        rows = out.count()
        assert 0.75 * before < rows <= before, name
        at, before = spark.createDataFrame(out.collect(), out.schema), rows
    assert {n for n, _ in corpus_pipeline.STAGES} >= {"quality_classifier", "mixing_sources"} and len(corpus_pipeline.STAGES) == 5
    mix = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert set(columns) <= set(mix.columns) and mix.count() > 0


def test_pipeline_drops_near_copies_as_brute_force_does(spark):
    rng = np.random.default_rng(12)
    texts = []
    for i in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, size=int(rng.integers(3, 150)))]
        texts.append((10 * i, " ".join(base)))
        for j in range(1, 4):  # changed ends leave more shingles than changed middles
            near = base + [f"tail{i}"] * j * (len(base) // 20)
            if j == 3:
                near[len(near) // 2] = "x"
            texts.append((10 * i + j, " ".join(near)))

    def sets(words):
        return {i: {tuple(w[k:k + words]) for k in range(max(len(w) - words + 1, 1))} for i, t in texts for w in [t.split()]}

    def groups(words, percent):
        of, root = sets(words), {i: i for i, _ in texts}
        for _ in range(5):
            for a, b in itertools.combinations(of, 2):
                if 100 * len(of[a] & of[b]) >= percent * len(of[a] | of[b]):
                    root[a] = root[b] = min(root[a], root[b])
        return {i for i, r in root.items() if i == r}

    kept = {r["doc_id"] for r in corpus_pipeline.ngram_jaccard_join(spark, docs(spark, texts), SF).collect()}
    assert kept == groups(5, 80) and kept != groups(3, 90)


def test_pipeline_decontaminates_documents_without_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 12").first()["text"]
    texts = [(None, "so " + item), (None, "so " + item), (None, "clean"), (None, "clean"), (None, None), (1, item), (2, "clean")]
    out = corpus_pipeline.benchmark_decontamination(spark, docs(spark, texts), SF)
    assert sorted(str((r["doc_id"], r["text"])) for r in out.collect()) == sorted(str(t) for t in [*texts[2:5], texts[6]])
    assert out.columns == docs(spark, texts).columns


def test_pipeline_on_odd_rows(spark):
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()
        stage(spark, odd.limit(0), SF).collect()


def test_words_beyond_ascii_are_tagged():
    field = toxicity.Field(["böse"], [])
    assert field.tokens(pa.array(["Ganz böse"])).features[:, 0].tolist() == [-1, 0]
