"""Chat windows and page texts."""

import hashlib
import html as entities
import re
import time

import pytest

from gridtide.llm import chat, pages
from gridtide.llm.queries import QUERIES


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_reads_back_every_turn(spark, sf_dir):
    rows = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    rows += [(-7, k, role, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]
    want = {}
    for conv, _, role, text in sorted(rows):
        want.setdefault(conv, []).append((role, text))
    out = {r["conv_id"]: r for r in QUERIES["op8_chat"](spark, sf_dir).collect()}
    assert out.keys() == want.keys()
    for conv, turns in want.items():
        targets = "".join(t for role, t in turns if role == "assistant")
        r = out[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(targets))
        assert r["turns_sha256"] == digest("".join(f"{role}\n{t}\n" for role, t in turns))
        assert r["loss_sha256"] == digest(targets)
        assert r["formatted_chars"] >= sum(len(t) for _, t in turns)


TURNS = [(1, k, role, text) for k, (role, text) in enumerate([("system", "Be brief. <b>"), *[("user", f"q{j} \\l <turn x>" * 8) if j % 2 else ("assistant", f"a{j} </turn>\n" * 9) for j in range(1, 30)]])]


def test_windows_keep_the_system_turn_repeat_history_and_mask_it(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    out = chat.format_windows(df, budget=200, history=60).orderBy("window").collect()
    assert len(out) > 5 and [r["window"] for r in out] == list(range(1, len(out) + 1))
    assert all(r["n_tokens"] <= 200 for r in out)
    assert all(r["text"].startswith("<turn system>Be brief.") for r in out)
    assert all(r["n_context"] >= 1 for r in out[1:]) and any(r["n_context"] >= 2 for r in out[1:])
    assert sum(r["n_turns"] for r in out) == len(TURNS)
    targets = [r["text"][s["start"] : s["end"]].replace("\\g", ">").replace("\\l", "<").replace("\\b", "\\") for r in out for s in r["loss"]]
    assert targets == [t for _, _, role, t in TURNS if role == "assistant"]
    read = chat.read_windows(spark.createDataFrame(out, chat.format_windows(df).schema)).first()
    assert [(t["role"], t["text"]) for t in read["turns"]] == [(role, t) for _, _, role, t in TURNS]
    assert read["targets"] == targets


def test_long_turn_stands_alone(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "x" * 40_000), (1, 2, "user", "ok"), (1, 3, "assistant", "")]
    out = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=100, history=20).orderBy("window").collect()
    assert [r["n_turns"] for r in out] == [1, 1, 2]
    assert [[s["end"] - s["start"] for s in r["loss"]] for r in out] == [[], [40_000], [0]]


def test_chat_nulls_ties_repeats_empty_and_other_columns(spark):
    rows = [(1, None, None, None, 5), (1, 0, "user", "b", 5), (1, 0, "user", "a", 5), (1, 0, "user", "a", 5), (None, 1, "assistant", "n", 5), (2, 0, "r>\\<", "é</turn>\n", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    out = {r["conv_id"]: r for r in chat.read_windows(chat.format_windows(df)).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("r>\\<", "é</turn>\n")]
    assert out[None]["targets"] == ["n"]
    assert chat.format_windows(df.limit(0)).collect() == []


def test_query_extracts_the_articles(spark, sf_dir):
    out = {r["page_id"]: r for r in QUERIES["op9_main_text"](spark, sf_dir).collect()}
    given = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(out) == len(given)
    for r in given:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", inside))
        plain = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        want = "\n".join(p for p in plain if p)
        assert (out[r["page_id"]]["text"], out[r["page_id"]]["n_chars"]) == (want, len(want))


ARTICLE = "<article><header><h1>T &lt;1&gt;</h1><p>by me</p></header><p>a&amp;b <b>c</b>d<br>e<p>f&nbsp; g<div class='user-comments'><p>no</p></div><form>x</form><aside>q</aside></article>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain", ["plain"]),
        (ARTICLE, ["T <1>", "a&b cd e", "f g"]),
        ("<head><title>t</title><style>p{}</style></head><body class='has-sidebar'><header>H</header><main><p>one\n two</p><nav>n</nav></main><footer>f</footer>", ["one two"]),
        ("<script>var t='</p>';</script><article>x<!-- <p>no</p> --><p>y &am", ["x", "y &am"]),
        ("<article><p>x</p><p cl", ["x"]),
        ("<article><p title='a>b'>x</p><ul><li>1<li>2</ul><table><tr><td>3<td>4</table><p hidden>no</p><p style='display: none'>no</p></article>", ["x", "1", "2", "3", "4"]),
        ("<div role='banner'>no</div><div role='main'><p>yes</p></div><div id='cookieNotice'>no</div>", ["yes"]),
        ("<article><p>&#x41;&#66;&euro;&copy</p></article><div class='ad'>no</div>", ["AB€©"]),
        ("<article><p title='a hidden gem'>kept</p><p>too</p><ul class='comment-list'><li>no</ul><div class='ads300x250'>no</div></article>", ["kept", "too"]),
        ("<SCRIPT>x</SCRIPT><ARTICLE><P>Up</ARTICLE><textarea><p>no", ["Up"]),
    ],
)
def test_blocks_of_markup(page, want):
    blocks = pages.blocks_of(page)
    article = pages.kept_kinds(blocks)
    assert [t for kind, t in blocks if kind == (pages.ARTICLE if article else pages.OPEN)] == want


@pytest.mark.parametrize("name", ["class='discussion'", "class='related-work'", "id='social-policy'", "class='notice-period'", "class='search-results'", "class='comment-free'"])
def test_names_that_only_begin_like_boilerplate_stay(spark, name):
    page = f"<nav>menu</nav><article><p>before</p><section {name}><p>said here</p></section><p>after</p></article>"
    out = pages.extract_text(spark.createDataFrame([(1, "http://a.example/1", page)], "page_id long, url string, html string")).first()
    assert (out["text"], out["n_removed"]) == ("before\nsaid here\nafter", 1)


@pytest.mark.parametrize(
    "page",
    ["<div>" * 60_000 + "</p>" * 60_000 + "x", "<div>" * 30_000 + "<header>" + "<article><h2>x</h2></article>" * 30_000, "<a " + "b" * 200_000 + ">x", "<article>" + "<p>y" * 100_000],
)
def test_long_and_deep_pages_take_seconds(page):
    begin = time.perf_counter()
    assert pages.blocks_of(page)
    assert time.perf_counter() - begin < 5


def test_repeated_runs_decide_where_the_markup_does_not(spark):
    top = "Home News Sports Weather Contact us About this site Imprint"
    low = "All rights reserved by the owner of this fine site since 1999"
    own = [" ".join(f"word{k}x{j}" for j in range(30)) for k in range(6)]
    make = lambda k: f"<div>{top}</div><div>{own[k]}</div><div>{low}</div>"
    rows = [(k, f"http://a.example/{k}", make(k), "x") for k in range(5)]
    rows += [(10, "http://b.example/0", make(5), "x")]  # alone on its host: nothing repeats
    rows += [(20 + k, f"http://c.example/{k}", make(5), "x") for k in range(4)]  # one page four times: no distinct pages
    rows += [(30, None, None, "x"), (31, "http://a.example/e", "", "x"), (0, "http://a.example/0", make(0), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    out = [(r["page_id"], r["text"]) for r in pages.extract_text(df).collect()]
    whole = f"{top}\n{own[5]}\n{low}"
    want = [(k, own[k]) for k in range(5)] + [(0, own[0]), (10, whole), *((20 + k, whole) for k in range(4)), (30, ""), (31, "")]
    assert sorted(out) == sorted(want)
    assert pages.extract_text(df.limit(0)).collect() == []


def test_articles_that_others_repeat_stay(spark):
    rows = [(k, f"http://a.example/{k}", f"<nav>menu {k}</nav><article><p>{'same words all over ' * 20}</p></article><div>tail {k}</div>") for k in range(5)]
    out = pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in out} == {("same words all over " * 20).strip()}


def test_runs_decide_inside_articles_where_no_element_vouches(spark):
    share = "Like what you read? Send this story to all of your friends today"
    same = "the house style sentence that every story repeats in its own text"
    own = [" ".join(f"word{k}x{j}" for j in range(30)) for k in range(5)]
    page = lambda k: f"<div>menu {k}</div><article><h1>{own[k][:20]}</h1><p>{same}</p><div class='zq-7'><p>{share}</p></div><div class='zq-8'>{own[k]} {share}</div></article>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(5)]
    # One article under three addresses with other menus is one content.
    rows += [(10 + k, f"http://b.example/{k}", f"<div>menu {k}</div><article><div class='body'>{own[0]}</div></article>") for k in range(3)]
    # Articles that are nothing but repeated runs stay.
    rows += [(20 + k, f"http://c.example/{k}", f"<article><div class='body'>{same} {same} {share if k else ''} {same if k > 1 else ''}</div></article>") for k in range(3)]
    out = {r["page_id"]: (r["text"], r["n_removed"]) for r in pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k] == (f"{own[k][:20].strip()}\n{same}\n{own[k]}", 2) for k in range(5))
    assert all(out[10 + k] == (own[0], 1) for k in range(3))
    assert out[20] == (f"{same} {same}", 0)


def test_covered_spans_go_and_the_rest_of_the_block_stays(spark):
    low = "All rights reserved by the owner of this fine site since 1999"
    own = [" ".join(f"word{k}x{j}" for j in range(9)) for k in range(4)]
    # Runs over the edge of a labelled block are runs of the page, too.
    page = lambda k: f"<div>{own[k]} {low}</div><nav>Home News Sports Weather</nav><div>Contact us About Imprint</div><div>{low} {own[k]} end{k}</div>"
    df = spark.createDataFrame([(k, f"http://a.example/{k}", page(k)) for k in range(4)], "page_id long, url string, html string")
    out = {r["page_id"]: (r["text"], r["n_removed"]) for r in pages.extract_text(df).collect()}
    assert out == {k: (f"{own[k]}\n{own[k]} end{k}", 2) for k in range(4)}


def test_no_run_goes_from_one_copy_of_a_page_into_the_next(spark):
    own = [" ".join(f"word{k}x{j}" for j in range(12)) for k in range(3)]
    # The end of the first page and its beginning make the sentence that two other pages hold.
    texts = [f"five six seven eight {own[0]} one two three four"] * 2 + [f"{own[k]} one two three four five six seven eight end{k}" for k in (1, 2)]
    rows = [(k, f"http://a.example/{k}", f"<div>{t}</div>") for k, t in enumerate(texts)]
    out = pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert {r["page_id"]: r["text"] for r in out} == dict(enumerate(texts))


def test_runs_of_many_contents_in_many_parts_equal_a_plain_count(spark, monkeypatch):
    import random

    monkeypatch.setattr(pages, "PART_TOKENS", 200)
    rng = random.Random(4)
    low = [" ".join(f"low{b}y{j}" for j in range(8)) for b in range(12)]
    held = [rng.sample(range(12), 2) if k % 5 else [0, 1] for k in range(40)]
    rows = [(k, f"http://{k % 3}.example/{k}", f"<div>{low[a]}</div><div>own{k} alone{k}</div><div>{low[b]}</div>") for k, (a, b) in enumerate(held)]
    out = pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    often = lambda k, b: sum(b in held[x] for x in range(40) if x % 3 == k % 3) >= pages.REPEATS
    want = {k: "\n".join([low[a]] * (not often(k, a)) + [f"own{k} alone{k}"] + [low[b]] * (not often(k, b))) for k, (a, b) in enumerate(held)}
    assert {r["page_id"]: r["text"] for r in out} == want


def test_suffix_order_sorts_by_the_first_tokens():
    import numpy as np

    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 3, 200).astype(np.uint64)
    order, rank = pages.suffix_order(tokens, 8)
    keys = [tuple(tokens[i : i + 8].tolist()) for i in range(200)]
    assert [keys[i] for i in order] == sorted(keys)
    assert all((rank[i] == rank[j]) == (keys[i] == keys[j]) for i in range(200) for j in range(i))
